"""CV rules on the fixture texts."""

import pytest
from pyspark.sql import functions as F

from vacantia.functions import dictionaries as D
from vacantia.operators import cvtext

TEXTS = {
    "tech": "Software engineer. Expert in Python. Using Docker. SQL",
    "nurse": "Nurse with patient care",
    "symbols": "Developer: C++ and C#",
    "section": "Summary\nx\n\nSkills:\nPython, Team lead\n- Excel\n",
    "figures": "Developer. grew 40% and 3x and $5",
    "blank": "  \n",
    "unicode": "Développeur engineer — Pythonü and éSQL, then AWS",
    "heading": "KEY SKILLS\n- node.js tools -\n• ab, c++\nOther: x, y",
    "listed": "programming languages we know: Go, Golang and K8s",
    "two lines": "programming languages\nwe know: Go, Golang and K8s",
}


@pytest.fixture(scope="module")
def cvs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "cv_id string, text string")


def collect(df, value):
    return {r["cv_id"]: r["v"] for r in df.select("cv_id", value.alias("v")).collect()}


def test_tech_skills(cvs):
    got = collect(cvs, cvtext.tech_skills(F.col("text")))
    triples = [(s["name"], s["proficiency"], s["category"]) for s in got["tech"]]
    assert triples == [
        ("Python", "Expert", "Programming Languages"),
        ("Docker", "Intermediate", "Cloud & DevOps"),
        ("SQL", "Familiar", "Databases"),
    ]
    assert got["nurse"] == [] and got["symbols"] == [] and got["blank"] == []
    # A letter of any alphabet next to the word is part of it.
    assert [s["name"] for s in got["unicode"]] == ["AWS"]
    assert [s["name"] for s in got["listed"]] == ["Go", "Kubernetes"]
    # The colon must be on the line of the heading word.
    assert got["two lines"] == []


def test_compat_order(cvs):
    got = collect(cvs, cvtext.tech_skills(F.col("text"), compat=True))
    assert [s["proficiency"] for s in got["tech"]] == ["Intermediate", "Familiar", "Expert"]


@pytest.mark.parametrize("variant", ["tech", "general"])
def test_hints_change_nothing(spark, cvs, folder, variant):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("cv_id"), F.concat("text", F.lit("\nWork: developer, SQL, team work")).alias("text")
    )
    df, hints = cvtext.with_hints(cvs.union(docs), "text", variant)
    fn = cvtext.tech_skills if variant == "tech" else cvtext.general_skills
    patterns = D.TECH_SECTION_PATTERNS if variant == "tech" else D.GENERAL_SECTION_PATTERNS
    t = F.col("text")
    both = df.select(
        fn(t).alias("a"),
        fn(t, hints=hints).alias("b"),
        F.map_entries(cvtext.section_shares(t, patterns, variant == "general")).alias("c"),
        F.map_entries(cvtext.section_shares(t, patterns, variant == "general", hints)).alias("d"),
    )
    assert both.filter("a <> b OR c <> d").count() == 0 and both.count() > 200


def test_general_skills(cvs):
    got = {k: [s["name"] for s in v] for k, v in collect(cvs, cvtext.general_skills(F.col("text"))).items()}
    assert got["nurse"] == ["Patient Care"]
    # Listed skills come first; "Team" is found again as Teamwork, Python and Excel are not repeated.
    assert got["section"] == ["Python", "Team Lead", "Excel", "Teamwork"]
    assert got["heading"] == ["Node.Js Tools", "C++"]
    assert got["blank"] == []


def test_section_body(cvs):
    got = collect(cvs, cvtext.skills_section_body(F.col("text")))
    assert got["section"] == "Python, Team lead\n- Excel\n"
    assert got["heading"] == "- node.js tools -\n• ab, c++"
    assert got["nurse"] is None


def test_skill_cap(spark):
    many = "Skills:\n" + ", ".join(f"skill number {i}" for i in range(40)) + "\n\npython"
    df = spark.createDataFrame([("m", many)], "cv_id string, text string")
    assert len(collect(df, cvtext.general_skills(F.col("text"), max_skills=20))["m"]) == 20
    assert len(collect(df, cvtext.general_skills(F.col("text")))["m"]) > 40


def test_scores(cvs):
    t = F.col("text")
    tech = collect(cvs, cvtext.tech_score(t, cvtext.tech_skills(t)))
    assert tech["figures"] == 60  # base 50, three figures
    assert tech["tech"] == 54  # three skills
    assert tech["blank"] == 50
    general = collect(cvs, cvtext.general_score(t, cvtext.general_skills(t)))
    assert general["section"] == 40 + 8 + 5
    assert general["blank"] == 40


def test_score_limits(spark):
    words = " ".join(name for name, *_ in D.TECH_SKILLS) + " developer experience education skills summary projects 1% 2% 3% "
    text = words + " ".join(D.TECH_ACTION_VERBS)
    df = spark.createDataFrame([("x", text)], "cv_id string, text string")
    t = F.col("text")
    assert collect(df, cvtext.tech_score(t, cvtext.tech_skills(t)))["x"] == 100


def test_bands(spark):
    df = spark.createDataFrame([(84,), (85,), (70,), (50,), (49,)], "s int")
    out = [r[0] for r in df.select(cvtext.by_score(F.col("s"), D.SCORE_BANDS)).collect()]
    assert out == ["Good", "Excellent", "Good", "Moderate", "Needs Work"]


def test_suggestions(cvs):
    got = collect(cvs, cvtext.tech_suggestions(F.col("text"), 5))
    assert [s["priority"] for s in got["tech"]] == ["high", "high", "medium", "medium", "medium"]
    assert got["section"][1]["category"] == "Action Verbs"
    t = F.col("text")
    general = collect(cvs, cvtext.general_suggestions(t, cvtext.general_skills(t)))
    assert [s["title"] for s in general["section"]] == ["Add More Skills", "Quantify Achievements"]


def test_sections(cvs):
    t = F.col("text")
    tech = collect(cvs, cvtext.section_shares(t, D.TECH_SECTION_PATTERNS))
    assert tech["section"]["Summary"] == 50.0 and tech["section"]["Skills"] == 50.0
    assert set(tech["blank"].values()) == {0.0} and len(tech["blank"]) == 5
    general = collect(cvs, cvtext.section_shares(t, D.GENERAL_SECTION_PATTERNS, general=True))
    assert general["section"] == {"Skills": 40.0, "Summary": 40.0, "Other": 20.0}
    assert general["blank"] == {}
    shown = collect(cvs, cvtext.visible_sections(cvtext.section_shares(t, D.GENERAL_SECTION_PATTERNS, general=True), 30))
    assert [e["section"] for e in shown["section"]] == ["Skills", "Summary"]


def test_gap(spark):
    rows = [("Senior Data Scientist (London)",), ("Chef",), ("Backend Developer",)]
    df = spark.createDataFrame(rows, "target string")
    skills = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("x").alias("proficiency"), F.lit("y").alias("category")) for n in ("SQL", "Python")])
    a, b, c = (r[0] for r in df.select(cvtext.gap_analysis(F.col("target"), skills)).collect())
    assert a["required_skills"] == list(D.ROLE_SKILLS[1][1]) and a["matching_skills"] == ["Python", "SQL"]
    assert a["match_percentage"] == 33.3 and a["skill_gap_count"] == 4 and len(a["recommendations"]) == 3
    assert b["required_skills"] == list(D.GENERIC_ROLE_SKILLS)
    assert c["missing_skills"] == ["Java", "REST API", "Docker", "PostgreSQL"]
    full = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("x").alias("proficiency"), F.lit("y").alias("category")) for n in D.GENERIC_ROLE_SKILLS])
    done = df.filter("target = 'Chef'").select(cvtext.gap_analysis(F.col("target"), full)).first()[0]
    assert done["recommendations"] == ["Great match! Your skills align well with Chef requirements."]


def test_replies(spark):
    good = '```json\n[{"name": "A", "proficiency": "Expert", "category": "B"}]\n```'
    rows = [("1", good, "sales"), ("2", "no json", "sales"), ("3", None, "sales"), ("4", "[]", "sales")]
    df = spark.createDataFrame(rows, "cv_id string, reply string, text string")
    got = {k: [s["name"] for s in v] for k, v in collect(df, cvtext.parse_reply(F.col("reply"), F.col("text"))).items()}
    assert got == {"1": ["A"], "2": ["Sales"], "3": ["Sales"], "4": []}


def test_context(cvs):
    row = cvtext.analyze(cvs.withColumn("role", F.lit("Chef")), "text", "tech", "role").filter("cv_id = 'tech'").first()
    assert row["ats_score"] == 54 and row["total_skills"] == 3 and row["has_gap_analysis"]
    assert [s["name"] for s in row["expert_skills"]] == ["Python"] and row["cv_word_count"] == 8
    assert "_hints" not in row.asDict()
