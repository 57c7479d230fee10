"""Word lists, patterns, labels and texts that fix the results.

Everything in this module is a constant that results depend on. Operators take
these as default arguments, so a caller can pass other tables.
"""

# Country code -> label; an unknown code becomes upper case.
COUNTRY_LABELS = {
    "gb": "UK",
    "us": "USA",
    "ca": "Canada",
    "au": "Australia",
    "in": "India",
    "sg": "Singapore",
    "za": "South Africa",
    "fr": "France",
    "de": "Germany",
    "nz": "New Zealand",
    "ie": "Ireland",
}

# Ordered category rules, matched as substrings of lower-cased text.
CATEGORY_RULES = (
    ("IT & Engineering", (
        "software engineer", "developer", "frontend", "backend", "full stack", "devops",
        "data scientist", "data engineer", "machine learning", "ml engineer", "python", "java",
        "golang", "c++", "react", "typescript", "cloud", "aws", "azure", "kubernetes",
    )),
    ("Data & Analytics", (
        "data analyst", "business intelligence", "analytics", "bi analyst", "statistician",
    )),
    ("Finance & Accounting", (
        "accountant", "finance", "financial analyst", "auditor", "tax", "bookkeeper",
        "controller", "fund", "banking",
    )),
    ("Marketing & Content", (
        "marketing", "digital marketing", "seo", "sem", "social media", "content writer",
        "copywriter", "brand", "growth marketer",
    )),
    ("Sales & Business Development", (
        "sales", "account executive", "business development", "bdr", "sdr", "inside sales",
        "sales manager", "sales representative",
    )),
    ("HR & Recruitment", (
        "human resources", "hr manager", "recruiter", "talent acquisition", "people ops",
    )),
    ("Healthcare & Nursing", (
        "nurse", "doctor", "gp", "physician", "medical", "clinical", "hospital", "healthcare",
        "care assistant", "carer",
    )),
    ("Education & Teaching", (
        "teacher", "teaching assistant", "lecturer", "professor", "tutor", "education", "school",
        "academy",
    )),
    ("Design & Creative", (
        "ux", "ui", "designer", "graphic design", "illustrator", "creative", "product design",
        "animation", "3d artist",
    )),
    ("Operations & Logistics", (
        "operations", "logistics", "supply chain", "warehouse", "procurement", "fleet",
    )),
    ("Project & Product Management", (
        "project manager", "programme manager", "product manager", "scrum master",
        "delivery manager",
    )),
)

# Default tag filter of the flat source.
DEFAULT_TAGS = ("python", "react", "javascript", "engineer")

# Collection profiles (name, country, what, category, max_jobs).
COLLECTION_PROFILES = (
    ("UK - Mixed Tech Roles", "gb", "", "it-jobs", 60),
    ("UK - Data Science", "gb", "data scientist", "it-jobs", 50),
    ("UK - Frontend Development", "gb", "frontend developer react", "it-jobs", 30),
    ("UK - Backend Development", "gb", "backend developer python", "it-jobs", 30),
    ("US - Software Engineering", "us", "software engineer", "it-jobs", 50),
    ("US - Machine Learning", "us", "machine learning engineer", "it-jobs", 40),
    ("AU - Software Engineering", "au", "software engineer", "it-jobs", 30),
    ("UK - Product Management", "gb", "product manager", "it-jobs", 20),
    ("UK - DevOps", "gb", "devops engineer", "it-jobs", 30),
    ("UK - Mobile Development", "gb", "mobile developer", "it-jobs", 20),
)
KEYWORD_FREE_PROFILE = ("UK - Mixed Tech Roles (keyword-free)", "gb", "", "it-jobs", 60)

# A CV counts as a technical one when either pattern is found. As in the skill tables
# below, the last field lists lower-case texts of which one is in every match of the pattern; it only
# spares the regex on texts without any of them.
TECH_CV_PATTERNS = (
    (
        r"\b(software|developer|engineer|programmer|data scientist|devops|frontend|backend|full.?stack)\b",
        ("software", "developer", "engineer", "programmer", "data scientist", "devops", "frontend", "backend", "stack"),
    ),
    (
        r"\b(skills?|technical skills?|technologies|programming)\b.*:",
        ("skill", "technologies", "programming"),
    ),
)

# Skill, pattern, category, texts.
TECH_SKILLS = (
    ("Python", r"\bPython\b", "Programming Languages", ("python",)),
    ("JavaScript", r"\b(JavaScript|JS)\b", "Programming Languages", ("javascript", "js")),
    ("TypeScript", r"\bTypeScript\b", "Programming Languages", ("typescript",)),
    ("Java", r"\bJava\b", "Programming Languages", ("java",)),
    ("C++", r"\bC\+\+\b", "Programming Languages", ("c++",)),
    ("Go", r"\bGo(?:lang)?\b", "Programming Languages", ("go",)),
    ("Rust", r"\bRust\b", "Programming Languages", ("rust",)),
    ("Ruby", r"\bRuby\b", "Programming Languages", ("ruby",)),
    ("PHP", r"\bPHP\b", "Programming Languages", ("php",)),
    ("C#", r"\bC#\b", "Programming Languages", ("c#",)),
    ("React", r"\bReact(?:\.js)?\b", "Web Frameworks", ("react",)),
    ("Vue", r"\bVue(?:\.js)?\b", "Web Frameworks", ("vue",)),
    ("Angular", r"\bAngular\b", "Web Frameworks", ("angular",)),
    ("Django", r"\bDjango\b", "Web Frameworks", ("django",)),
    ("Flask", r"\bFlask\b", "Web Frameworks", ("flask",)),
    ("FastAPI", r"\bFastAPI\b", "Web Frameworks", ("fastapi",)),
    ("Node.js", r"\bNode(?:\.js)?\b", "Web Frameworks", ("node",)),
    ("Express", r"\bExpress(?:\.js)?\b", "Web Frameworks", ("express",)),
    ("Spring", r"\bSpring\b", "Web Frameworks", ("spring",)),
    ("TensorFlow", r"\bTensorFlow\b", "ML/AI", ("tensorflow",)),
    ("PyTorch", r"\bPyTorch\b", "ML/AI", ("pytorch",)),
    ("Pandas", r"\bPandas\b", "ML/AI", ("pandas",)),
    ("NumPy", r"\bNumPy\b", "ML/AI", ("numpy",)),
    ("Scikit-learn", r"\bScikit-learn\b", "ML/AI", ("scikit-learn",)),
    ("PostgreSQL", r"\b(PostgreSQL|Postgres)\b", "Databases", ("postgres",)),
    ("MySQL", r"\bMySQL\b", "Databases", ("mysql",)),
    ("MongoDB", r"\bMongoDB\b", "Databases", ("mongodb",)),
    ("Redis", r"\bRedis\b", "Databases", ("redis",)),
    ("SQL", r"\bSQL\b", "Databases", ("sql",)),
    ("NoSQL", r"\bNoSQL\b", "Databases", ("nosql",)),
    ("AWS", r"\b(AWS|Amazon Web Services)\b", "Cloud & DevOps", ("aws", "amazon web services")),
    ("Azure", r"\b(Azure|Microsoft Azure)\b", "Cloud & DevOps", ("azure",)),
    ("GCP", r"\b(GCP|Google Cloud)\b", "Cloud & DevOps", ("gcp", "google cloud")),
    ("Docker", r"\bDocker\b", "Cloud & DevOps", ("docker",)),
    ("Kubernetes", r"\b(Kubernetes|K8s)\b", "Cloud & DevOps", ("kubernetes", "k8s")),
    ("CI/CD", r"\bCI/CD\b", "Cloud & DevOps", ("ci/cd",)),
    ("Jenkins", r"\bJenkins\b", "Cloud & DevOps", ("jenkins",)),
    ("GitLab", r"\bGitLab\b", "Cloud & DevOps", ("gitlab",)),
    ("GitHub Actions", r"\bGitHub Actions\b", "Cloud & DevOps", ("github actions",)),
    ("Git", r"\bGit\b", "Tools & Practices", ("git",)),
    ("REST API", r"\b(REST|RESTful|REST API)\b", "Tools & Practices", ("rest",)),
    ("GraphQL", r"\bGraphQL\b", "Tools & Practices", ("graphql",)),
    ("Microservices", r"\bMicroservices\b", "Tools & Practices", ("microservices",)),
    ("Agile", r"\bAgile\b", "Tools & Practices", ("agile",)),
    ("Scrum", r"\bScrum\b", "Tools & Practices", ("scrum",)),
    ("Terraform", r"\bTerraform\b", "Cloud & DevOps", ("terraform",)),
    ("Machine Learning", r"\bMachine Learning\b", "ML/AI", ("machine learning",)),
    ("Deep Learning", r"\bDeep Learning\b", "ML/AI", ("deep learning",)),
    ("NLP", r"\b(NLP|Natural Language Processing)\b", "ML/AI", ("nlp", "natural language processing")),
    ("Computer Vision", r"\bComputer Vision\b", "ML/AI", ("computer vision",)),
    ("Data Science", r"\bData Science\b", "ML/AI", ("data science",)),
    ("AI", r"\b(AI|Artificial Intelligence)\b", "ML/AI", ("ai", "artificial intelligence")),
)

# Phrases around a skill name ({}) that raise its proficiency.
EXPERT_PHRASES = (
    "expert in {}", "{} expert", "advanced {}", "proficient in {}", "{} architect", "lead {}",
)
INTERMEDIATE_PHRASES = ("experience with {}", "worked with {}", "using {}", "{} developer")

# Skills for all professions: skill, pattern, texts.
GENERAL_SKILLS = (
    ("Communication", r"\bcommunication\b", ("communication",)),
    ("Leadership", r"\bleadership\b", ("leadership",)),
    ("Teamwork", r"\bteam(?:work)?\b", ("team",)),
    ("Problem Solving", r"\bproblem solving\b", ("problem solving",)),
    ("Time Management", r"\btime management\b", ("time management",)),
    ("Project Management", r"\bproject management\b", ("project management",)),
    ("Microsoft Office", r"\b(Microsoft Office|MS Office)\b", ("microsoft office", "ms office")),
    ("Excel", r"\b(Excel|MS Excel)\b", ("excel",)),
    ("PowerPoint", r"\bPowerPoint\b", ("powerpoint",)),
    ("Word", r"\b(Word|MS Word)\b", ("word",)),
    ("Patient Care", r"\bpatient care\b", ("patient care",)),
    ("Clinical Skills", r"\bclinical\b", ("clinical",)),
    ("Nursing", r"\bnursing\b", ("nursing",)),
    ("Sales", r"\bsales\b", ("sales",)),
    ("Marketing", r"\bmarketing\b", ("marketing",)),
    ("Customer Service", r"\bcustomer service\b", ("customer service",)),
    ("Python", r"\bPython\b", ("python",)),
    ("JavaScript", r"\bJavaScript\b", ("javascript",)),
    ("SQL", r"\bSQL\b", ("sql",)),
)

# Ordered category rules for general skills (substrings of the lower-cased name).
SKILL_CATEGORY_RULES = (
    ("Healthcare", ("patient", "clinical", "medical", "nursing", "health")),
    ("Education", ("teach", "education", "classroom", "curriculum")),
    ("Technology", ("python", "javascript", "programming", "software", "code")),
    ("Sales & Marketing", ("sales", "marketing", "customer")),
    ("Finance", ("accounting", "financial", "budget")),
    ("Soft Skills", ("communication", "leadership", "teamwork", "problem")),
)
DEFAULT_SKILL_CATEGORY = "Professional Skills"

# Words that set the proficiency of a general skill, anywhere in the text.
EXPERT_WORDS = ("expert", "proficient", "advanced", "certified", "specialist")
INTERMEDIATE_WORDS = ("experience", "worked with", "knowledge")

# A skills section runs to a blank line, the next "Xxx:" heading or the end.
SKILL_SECTION_PATTERNS = (
    r"(?:^|\n)(skills?|competencies|technical skills?)[:\s]*\n(.*?)(?=\n\n|\n[A-Z][a-z]+:|\z)",
    r"(?:^|\n)(key skills?|core competencies)[:\s]*\n(.*?)(?=\n\n|\n[A-Z][a-z]+:|\z)",
)

# Inputs of the two readiness scores.
TECH_SCORE_SECTIONS = ("experience", "education", "skills", "summary", "projects")
TECH_SCORE_NUMBERS = r"\d+%|\d+x|\$\d+"
TECH_ACTION_VERBS = (
    "developed", "implemented", "led", "managed", "designed", "created", "built", "improved",
    "optimized",
)
GENERAL_SCORE_SECTIONS = ("experience", "education", "skills")
GENERAL_SCORE_NUMBERS = r"\d+%|\d+ years?|\d+\+"
GENERAL_SUGGESTION_NUMBERS = r"\d+%|\d+ years?"
GENERAL_ACTION_VERBS = ("achieved", "managed", "led", "developed", "improved")

# Section, mention pattern, weight, texts.
TECH_SECTION_PATTERNS = (
    ("Experience", r"\b(experience|work|employment|position)\b", 1, ("experience", "work", "employment", "position")),
    ("Education", r"\b(education|degree|university|college)\b", 1, ("education", "degree", "university", "college")),
    ("Skills", r"\b(skills?|technologies|tools)\b", 1, ("skill", "technologies", "tools")),
    ("Projects", r"\b(projects?|portfolio)\b", 1, ("project", "portfolio")),
    ("Summary", r"\b(summary|objective|profile|about)\b", 1, ("summary", "objective", "profile", "about")),
)
GENERAL_SECTION_PATTERNS = (
    ("Experience", r"\b(experience|work|employment|position|role|job)\b", 3, ("experience", "work", "employment", "position", "role", "job")),
    ("Education", r"\b(education|degree|university|college|school|qualification)\b", 3, ("education", "degree", "university", "college", "school", "qualification")),
    ("Skills", r"\b(skills?|proficient|expertise|knowledge|technologies|tools)\b", 2, ("skill", "proficient", "expertise", "knowledge", "technologies", "tools")),
    ("Summary", r"\b(summary|objective|profile|about|overview)\b", 2, ("summary", "objective", "profile", "about", "overview")),
    ("Projects", r"\b(projects?|portfolio|work samples?)\b", 2, ("project", "portfolio", "work sample")),
)

# Lower score bound -> summary text, per variant, and the short band names.
TECH_SUMMARIES = (
    (85, "Your CV has <strong>excellent ATS compatibility</strong> with strong keywords and well-structured content."),
    (70, "Your CV has <strong>good ATS compatibility</strong> with room for improvement in quantifying achievements and formatting consistency."),
    (50, "Your CV has <strong>moderate ATS compatibility</strong>. Focus on adding quantifiable achievements and relevant keywords."),
    (None, "Your CV needs <strong>significant improvement</strong> for ATS systems. Consider restructuring with clear sections and adding measurable achievements."),
)
GENERAL_SUMMARIES = (
    (85, "Your CV has <strong>excellent ATS compatibility</strong>."),
    (70, "Your CV has <strong>good ATS compatibility</strong> with room for improvement."),
    (50, "Your CV has <strong>moderate ATS compatibility</strong>."),
    (None, "Your CV needs <strong>improvement</strong> for ATS systems."),
)
SCORE_BANDS = ((85, "Excellent"), (70, "Good"), (50, "Moderate"), (None, "Needs Work"))

# Suggestion texts, keyed by the check that triggers them.
TECH_SUGGESTIONS = {
    "numbers": (
        "Quantify Achievements", "high", "Quantify Your Achievements",
        'Add specific metrics and numbers to your accomplishments. For example, instead of "Improved system performance," use "Improved system performance by 40%, reducing API response time from 500ms to 300ms."',
    ),
    "summary": (
        "Professional Summary", "high", "Add a Professional Summary",
        "Include a 3-4 sentence summary at the top highlighting your experience level, key skills, and what you're looking for. This helps ATS systems and recruiters quickly understand your profile.",
    ),
    "verbs": (
        "Action Verbs", "medium", "Use Strong Action Verbs",
        'Start bullet points with strong action verbs like "Developed," "Implemented," "Led," or "Optimized" rather than passive phrases. This makes your contributions more impactful.',
    ),
    "certifications": (
        "Certifications", "medium", "Include Relevant Certifications",
        "If you have certifications (AWS, Azure, Google Cloud, etc.), create a dedicated section. These keywords boost ATS scores and demonstrate ongoing professional development.",
    ),
    "projects": (
        "Projects", "medium", "Showcase Your Projects",
        "Add a projects section with 2-3 key projects that demonstrate your skills. Include technologies used and measurable outcomes to strengthen your profile.",
    ),
    "education": (
        "Education", "low", "Add Education Details",
        "Include your educational background with degree, institution, and graduation year. This is often a required field in ATS systems.",
    ),
}
TECH_SUGGESTION_PATTERNS = {
    "summary": r"\b(summary|objective|profile)\b",
    "certifications": r"\b(certifications?|certificates?)\b",
    "projects": r"\b(projects?|portfolio)\b",
    "education": r"\b(education|degree|university|bachelor|master)\b",
}
GENERAL_SUGGESTIONS = {
    "skills": (
        "Add More Skills",
        "Include a dedicated skills section with at least 5-10 relevant skills to improve ATS matching.",
    ),
    "numbers": (
        "Quantify Achievements",
        "Add specific metrics like percentages, numbers, or time periods to your accomplishments.",
    ),
    "summary": (
        "Add Professional Summary",
        "Include a brief summary at the top highlighting your experience and goals.",
    ),
}
GENERAL_SUMMARY_PATTERN = r"\b(summary|objective)\b"

# Required skills per role, first role found in the target wins.
ROLE_SKILLS = (
    ("software engineer", ("Python", "JavaScript", "Git", "REST API", "SQL", "Agile")),
    ("data scientist", ("Python", "Machine Learning", "Pandas", "SQL", "TensorFlow", "Data Science")),
    ("frontend developer", ("JavaScript", "React", "TypeScript", "HTML", "CSS")),
    ("backend developer", ("Python", "Java", "SQL", "REST API", "Docker", "PostgreSQL")),
    ("devops engineer", ("Docker", "Kubernetes", "AWS", "CI/CD", "Terraform", "Git")),
    ("ml engineer", ("Python", "TensorFlow", "PyTorch", "Machine Learning", "Docker", "AWS")),
    ("full stack developer", ("JavaScript", "Python", "React", "Node.js", "SQL", "REST API")),
)
GENERIC_ROLE_SKILLS = ("Python", "JavaScript", "SQL", "Git", "Docker", "AWS")
GAP_HIGHLIGHT = (
    "Highlight any relevant projects or coursework that demonstrate these skills, "
    "even if not from professional experience."
)

# Report labels.
RUN_STATUS_LABELS = {
    "RUNNING": "Running",
    "IDLE": "Idle",
    "ERROR": "Error",
    "ONLINE": "Online",
    "OFFLINE": "Offline",
    "SUCCESS": "Completed",
    "COMPLETED": "Completed",
    "NO_NEW_JOBS": "Completed",
    "NO_DATA": "No Data",
}
MODEL_STATUS_LABELS = {
    "RUNNING": "Running",
    "IDLE": "Idle",
    "ERROR": "Error",
    "ONLINE": "Online",
    "OFFLINE": "Offline",
    "SUCCESS": "Success",
    "COMPLETED": "Completed",
}
SOURCE_LABELS = {"Adzuna": "Adzuna API", "RemoteOK": "RemoteOK"}
PROFICIENCY_RANK = {"Expert": 3, "Intermediate": 2, "Familiar": 1}

# Texts that stand for a missing value in profile counts, and the label they get.
MISSING_COUNTRY = (("nan", "None", "Unknown", ""), "Other Countries")
MISSING_SOURCE = (("nan", ""), "Unknown")
MISSING_CATEGORY = (("nan", "None", "Unknown", ""), "Other sector jobs")
