"""Queries on CV texts: skills, scores, sections, gaps and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import dictionaries as D
from vacantia.functions.text import word_count
from vacantia.operators import cvtext, phrases
from vacantia.plans.catalog_postings import sql_label, sql_text
from vacantia.plans.registry import ORACLES, Tables, query

# Each document becomes a CV: its text and a passage chosen by its source. The invented words of the
# documents hit no dictionary, so without the passage the rules would have nothing to find.
PASSAGES = (
    (("src0", "src1", "src2"), "\nSoftware engineer. Expert in Python. Using Docker. SQL, REST API\nEducation: degree"),
    (("src3", "src4"), "\nNurse with patient care and communication. Certified specialist. Work at school"),
    (("src5", "src6", "src7"), "\nSummary\nworked\n\nSkills:\nPython, Team lead\n- Excel\n• node.js tools, ab\n\nEducation: university"),
    (("src8", "src9", "src10"), "\nDeveloper: C++ and C#. Led projects, grew 40% in 3 years, 3x, $5. React.js, Node.js, AWS, CI/CD."
     " Developed, implemented, managed, designed"),
    (("src11", "src12", "src13"), "\nObjective: data scientist. Machine Learning, pandas, TensorFlow; experience with SQL; advanced python;"
     " achieved 20%, 30%, 10+ years experience. Work samples, certificates"),
    (("src14", "src15"), "\nskills\nTime management, sales and marketing\nLanguages: many\nleadership, MS Excel, knowledge of Word"),
    (("src16",), "\nKey Skills:\n- clinical nursing, problem solving -\n• budget planning"),
)
ROLES = (
    ("de", "Senior Data Scientist (London)"),
    ("fr", "Chef"),
    ("es", "Full Stack Developer or Software Engineer"),
)


def cvs(t: Tables) -> DataFrame:
    passage, role = F.lit(""), F.lit("DevOps engineer")
    for sources, text in reversed(PASSAGES):
        passage = F.when(F.col("source").isin(*sources), text).otherwise(passage)
    for lang, target in reversed(ROLES):
        role = F.when(F.col("lang") == lang, target).otherwise(role)
    return t.documents.select(
        F.col("doc_id").alias("cv_id"),
        F.concat("text", passage).alias("cv_text"),
        role.alias("target_role"),
        "source",
        "lang",
    )


CVS_SQL = "cvs AS (SELECT doc_id AS cv_id, source, lang, text || CASE {} ELSE '' END AS cv_text, CASE lang {} ELSE 'DevOps engineer' END AS target_role FROM documents)".format(
    " ".join(
        "WHEN source IN ({}) THEN {}".format(", ".join(map(sql_text, s)), sql_text(p)) for s, p in PASSAGES
    ),
    " ".join(f"WHEN '{lang}' THEN {sql_text(r)}" for lang, r in ROLES),
)

WORD = r"\p{L}\p{N}_"


def sql_finds(text: str, pattern: str, flags: str = "i") -> str:
    """regexp_matches for a \\b..\\b pattern with Unicode boundaries spelled out."""
    body = pattern.removeprefix(r"\b").removesuffix(r"\b").replace(r"\b.*:", f"(?:[^{WORD}\\n].*)?:")
    before = f"(?:^|[^{WORD}])"
    after = "" if not pattern.endswith(r"\b") else f"(?:$|[^{WORD}])"
    if pattern.endswith((r"\+\b", r"#\b")):
        after = f"[{WORD}]"
    return f"regexp_matches({text}, {sql_text(f'(?{flags}){before}{body}{after}')})"


def sql_mentions(text: str, pattern: str) -> str:
    """Number of matches: every word is set apart by doubled separators, so matches cannot share one."""
    body = pattern.removeprefix(r"\b").removesuffix(r"\b").replace(" ", "  ")
    apart = f"regexp_replace(regexp_replace(lower({text}), '[^{WORD} ]', '##', 'g'), ' ', '  ', 'g')"
    return f"len(regexp_extract_all('#' || {apart} || '#', {sql_text(f'[ #]{body}[ #]')}))"


def sql_present(lowered: str, words) -> str:
    return "(" + " + ".join(f"contains({lowered}, {sql_text(w)})::INTEGER" for w in words) + ")"


def sql_list(items) -> str:
    return "[" + ", ".join(map(sql_text, items)) + "]"


# --------------------------------------------------------------------------- tech variant

GATE_SQL = "(" + " OR ".join(sql_finds("cv_text", p) for p, _ in D.TECH_CV_PATTERNS) + ")"


def _phrase_level(name: str) -> str:
    def any_of(phrases):
        return " OR ".join(f"contains(lower(cv_text), {sql_text(p.format(name.lower()))})" for p in phrases)

    return f"CASE WHEN {any_of(D.EXPERT_PHRASES)} THEN 'Expert' WHEN {any_of(D.INTERMEDIATE_PHRASES)} THEN 'Intermediate' ELSE 'Familiar' END"


TECH_ROWS_SQL = "tech_rows AS ({})".format(
    " UNION ALL ".join(
        f"SELECT cv_id, {i} AS ord, {sql_text(name)} AS name, {_phrase_level(name)} AS proficiency, {sql_text(category)} AS category"
        f" FROM cvs WHERE {GATE_SQL} AND {sql_finds('cv_text', pattern)}"
        for i, (name, pattern, category, _) in enumerate(D.TECH_SKILLS)
    )
)
LEVEL_SQL = "CASE proficiency WHEN 'Expert' THEN 1 WHEN 'Intermediate' THEN 2 ELSE 3 END"
TECH_COUNT_SQL = (
    "tech_count AS (SELECT c.*, (SELECT count(*) FROM tech_rows r WHERE r.cv_id = c.cv_id) AS n_skills FROM cvs c)"
)


def tech_cvs(t: Tables) -> tuple[DataFrame, cvtext.Hints]:
    return cvtext.with_hints(cvs(t), "cv_text", "tech")


def general_cvs(t: Tables) -> tuple[DataFrame, cvtext.Hints]:
    return cvtext.with_hints(cvs(t), "cv_text", "general")


def with_tech_skills(t: Tables) -> DataFrame:
    c, hints = tech_cvs(t)
    return c.withColumn("skills", cvtext.tech_skills(F.col("cv_text"), hints=hints)).drop("_hints")


def with_general_skills(t: Tables, max_skills: int | None = 20) -> DataFrame:
    c, hints = general_cvs(t)
    return c.withColumn("skills", cvtext.general_skills(F.col("cv_text"), max_skills=max_skills, hints=hints)).drop("_hints")


def skills_text(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws("/", s["name"], s.proficiency, s.category)), "; ")


def _ordered_tech(order: str) -> str:
    return (
        f"WITH {CVS_SQL}, {TECH_ROWS_SQL} SELECT cv_id, coalesce((SELECT string_agg(name || '/' || proficiency || '/' || category,"
        f" '; ' ORDER BY {order}, ord) FROM tech_rows r WHERE r.cv_id = c.cv_id), '') AS skills FROM cvs c"
    )


@query(_ordered_tech(LEVEL_SQL))
def tech_skills(t: Tables) -> DataFrame:
    return with_tech_skills(t).select("cv_id", skills_text(F.col("skills")).alias("skills"))


@query(_ordered_tech("proficiency DESC"))
def tech_skills_by_level_name(t: Tables) -> DataFrame:
    c, hints = tech_cvs(t)
    skills = cvtext.tech_skills(F.col("cv_text"), compat=True, hints=hints)
    return c.select("cv_id", skills_text(skills).alias("skills"))


@query(f"WITH {CVS_SQL} SELECT cv_id, {GATE_SQL} AS is_tech FROM cvs")
def tech_cv_gate(t: Tables) -> DataFrame:
    c, hints = tech_cvs(t)
    return c.select("cv_id", cvtext.is_tech_cv(F.col("cv_text"), hints=hints).alias("is_tech"))


def _figures(pattern: str) -> str:
    return f"len(regexp_extract_all(cv_text, {sql_text('(?i)' + pattern)}))"


TECH_SCORE_SQL = f"""least(100, CAST(trunc(50 + least(n_skills * 1.5::DOUBLE, 20.0::DOUBLE)
   + {sql_present('lower(cv_text)', D.TECH_SCORE_SECTIONS)} / 5.0::DOUBLE * 15
   + CASE WHEN {_figures(D.TECH_SCORE_NUMBERS)} >= 3 THEN 10 WHEN {_figures(D.TECH_SCORE_NUMBERS)} >= 1 THEN 5 ELSE 0 END
   + CASE WHEN {sql_present('lower(cv_text)', D.TECH_ACTION_VERBS)} >= 5 THEN 5 ELSE 0 END) AS INTEGER))"""
TECH_SCORE_SQL = TECH_SCORE_SQL.replace("(?i)", "")


@query(
    f"WITH {CVS_SQL}, {TECH_ROWS_SQL}, {TECH_COUNT_SQL} SELECT cv_id, {TECH_SCORE_SQL} AS ats_score FROM tech_count"
)
def tech_score(t: Tables) -> DataFrame:
    score = cvtext.tech_score(F.col("cv_text"), F.col("skills"))
    return with_tech_skills(t).select("cv_id", score.alias("ats_score"))


def _suggestion_sql(checks: list[tuple[str, str]], limit: int = 5) -> str:
    items = ", ".join(f"CASE WHEN {condition} THEN {sql_text(title)} END" for condition, title in checks)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL)[1:{limit}], '; ')"


TECH_CHECKS = [
    (f"{_figures(D.TECH_SCORE_NUMBERS).replace('(?i)', '')} < 3", D.TECH_SUGGESTIONS["numbers"][2]),
    (f"NOT {sql_finds('lower(cv_text)', D.TECH_SUGGESTION_PATTERNS['summary'])}", D.TECH_SUGGESTIONS["summary"][2]),
    (f"{sql_present('lower(cv_text)', D.TECH_ACTION_VERBS)} < 5", D.TECH_SUGGESTIONS["verbs"][2]),
    *[
        (f"NOT {sql_finds('lower(cv_text)', D.TECH_SUGGESTION_PATTERNS[k])}", D.TECH_SUGGESTIONS[k][2])
        for k in ("certifications", "projects", "education")
    ],
]


def titles(suggestions: Column) -> Column:
    return F.array_join(F.transform(suggestions, lambda s: s.title), "; ")


@query(f"WITH {CVS_SQL} SELECT cv_id, {_suggestion_sql(TECH_CHECKS)} AS suggestions FROM cvs")
def tech_suggestions(t: Tables) -> DataFrame:
    return cvs(t).select("cv_id", titles(cvtext.tech_suggestions(F.col("cv_text"), 5)).alias("suggestions"))


def _words_sql(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '[^\s\v\x{{85}}\p{{Z}}\x1c-\x1f]+'))"


def _mentions_cte(patterns, name: str) -> str:
    columns = ", ".join(f"{sql_mentions('cv_text', p)} * {w} AS {n.lower()}" for n, p, w, _ in patterns)
    return f"{name} AS (SELECT cv_id, {_words_sql('cv_text')} AS words, {columns} FROM cvs)"


TECH_SECTIONS_SQL = " UNION ALL ".join(
    f"SELECT cv_id, '{n}' AS section, round({n.lower()} * 100.0::DOUBLE / CASE WHEN experience + education + skills + projects + summary = 0"
    f" THEN 1 ELSE experience + education + skills + projects + summary END, 4) AS share, words::INTEGER AS words FROM mentions"
    for n, *_ in D.TECH_SECTION_PATTERNS
)


@query(f"WITH {CVS_SQL}, {_mentions_cte(D.TECH_SECTION_PATTERNS, 'mentions')} {TECH_SECTIONS_SQL}")
def tech_sections(t: Tables) -> DataFrame:
    text = F.col("cv_text")
    c, hints = tech_cvs(t)
    shares = cvtext.section_shares(text, D.TECH_SECTION_PATTERNS, hints=hints)
    out = c.select("cv_id", word_count(text).alias("words"), F.explode_outer(shares).alias("section", "share"))
    return out.withColumn("share", F.round("share", 4))


GENERAL_SECTIONS_SQL = (
    "weighed AS (SELECT *, experience + education + skills + summary + projects AS found,"
    " greatest(1, words // 100) AS other FROM mentions), shares AS ("
    + " UNION ALL ".join(
        f"SELECT cv_id, '{n}' AS section, {n.lower()} * 100.0::DOUBLE / (found + other) AS share FROM weighed WHERE {n.lower()} > 0"
        for n, *_ in D.GENERAL_SECTION_PATTERNS
    )
    + " UNION ALL SELECT cv_id, 'Other', other * 100.0::DOUBLE / (found + other) FROM weighed WHERE found > 0)"
)


@query(
    f"WITH {CVS_SQL}, {_mentions_cte(D.GENERAL_SECTION_PATTERNS, 'mentions')}, {GENERAL_SECTIONS_SQL}"
    " SELECT cv_id, section, round(share, 4) AS share FROM shares"
)
def general_sections(t: Tables) -> DataFrame:
    c, hints = general_cvs(t)
    shares = cvtext.section_shares(F.col("cv_text"), D.GENERAL_SECTION_PATTERNS, general=True, hints=hints)
    out = c.select("cv_id", F.explode_outer(shares).alias("section", "share")).filter("section IS NOT NULL")
    return out.withColumn("share", F.round("share", 4))


@query(
    f"WITH {CVS_SQL}, {_mentions_cte(D.GENERAL_SECTION_PATTERNS, 'mentions')}, {GENERAL_SECTIONS_SQL}"
    " SELECT c.cv_id, coalesce(string_agg(section, ' > ' ORDER BY share DESC, section), '') AS shown"
    " FROM cvs c LEFT JOIN shares s ON s.cv_id = c.cv_id AND share >= 3.0 GROUP BY c.cv_id"
)
def visible_sections(t: Tables) -> DataFrame:
    c, hints = general_cvs(t)
    shares = cvtext.section_shares(F.col("cv_text"), D.GENERAL_SECTION_PATTERNS, general=True, hints=hints)
    shown = F.transform(cvtext.visible_sections(shares), lambda e: e.section)
    return c.select("cv_id", F.array_join(shown, " > ").alias("shown"))


# --------------------------------------------------------------------------- general variant

# RE2 has no lookahead; consuming the terminator gives the same group in the first match.
BODY_SQL = "CASE {} END".format(
    " ".join(
        "WHEN regexp_matches(cv_text, {p}) THEN regexp_extract(cv_text, {p}, 2)".format(
            p=sql_text("(?is)" + p.replace("(?=", "(?:"))
        )
        for p in D.SKILL_SECTION_PATTERNS
    )
)
SPACE = r"\s\v\x{85}\p{Z}\x1c-\x1f"
ITEM_SQL = (
    f"regexp_replace(regexp_replace(regexp_replace(item, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), '^-+|-+$', '', 'g'),"
    f" '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
)
TITLE_SQL = (
    "array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i > 1 AND"
    " regexp_matches(substr(s, i - 1, 1), '\\p{L}') THEN lower(substr(s, i, 1)) ELSE upper(substr(s, i, 1)) END), '')"
)
CATEGORY_SQL = sql_label("lower({s})", D.SKILL_CATEGORY_RULES, D.DEFAULT_SKILL_CATEGORY)
SECTION_ROWS_SQL = f"""
  bodies AS (SELECT cv_id, {BODY_SQL} AS body FROM cvs),
  items AS (SELECT cv_id, i, {ITEM_SQL} AS s FROM (SELECT cv_id, u.i, parts[u.i] AS item FROM
      (SELECT cv_id, regexp_split_to_array(body, '[•\\n,]') AS parts FROM bodies WHERE body IS NOT NULL) p, unnest(range(1, len(parts) + 1)) AS u(i))),
  section_rows AS (SELECT cv_id, i AS ord, {TITLE_SQL} AS name, 'Intermediate' AS proficiency, {CATEGORY_SQL.format(s='s')} AS category
      FROM items WHERE length(s) > 2 AND length(s) < 50)"""


def _document_level(name: str) -> str:
    named = f"contains(lower(cv_text), {sql_text(name.lower())})"

    def any_of(words):
        return "(" + " OR ".join(f"contains(lower(cv_text), {sql_text(w)})" for w in words) + ")"

    return (
        f"CASE WHEN {named} AND {any_of(D.EXPERT_WORDS)} THEN 'Expert'"
        f" WHEN {named} AND {any_of(D.INTERMEDIATE_WORDS)} THEN 'Intermediate' ELSE 'Familiar' END"
    )


GENERAL_ROWS_SQL = SECTION_ROWS_SQL + ", dictionary_rows AS ({}), ".format(
    " UNION ALL ".join(
        f"SELECT cv_id, {100000 + i} AS ord, {sql_text(name)} AS name, {_document_level(name)} AS proficiency,"
        f" {CATEGORY_SQL.format(s=sql_text(name))} AS category FROM cvs WHERE {sql_finds('cv_text', pattern)}"
        for i, (name, pattern, _) in enumerate(D.GENERAL_SKILLS)
    )
) + (
    "all_rows AS (SELECT * FROM section_rows UNION ALL SELECT * FROM dictionary_rows d WHERE NOT EXISTS"
    " (SELECT 1 FROM section_rows s WHERE s.cv_id = d.cv_id AND s.name = d.name)),"
    " general_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY ord) AS rn FROM all_rows) WHERE rn <= 20)"
)


@query(
    f"WITH {CVS_SQL}, {SECTION_ROWS_SQL} SELECT c.cv_id, coalesce(string_agg(name || '/' || category, '; ' ORDER BY ord), '') AS skills"
    " FROM cvs c LEFT JOIN section_rows s ON s.cv_id = c.cv_id GROUP BY c.cv_id"
)
def section_skills(t: Tables) -> DataFrame:
    c, hints = general_cvs(t)
    listed = F.transform(
        cvtext.section_skills(F.col("cv_text"), hints), lambda s: F.concat_ws("/", s["name"], s.category)
    )
    return c.select("cv_id", F.array_join(listed, "; ").alias("skills"))


@query(
    f"WITH {CVS_SQL}, {GENERAL_ROWS_SQL} SELECT cv_id, coalesce((SELECT string_agg(name || '/' || proficiency || '/' || category, '; ' ORDER BY rn)"
    " FROM general_rows r WHERE r.cv_id = c.cv_id), '') AS skills FROM cvs c"
)
def general_skills(t: Tables) -> DataFrame:
    """The first 20 skills, as they are shown."""
    return with_general_skills(t).select("cv_id", skills_text(F.col("skills")).alias("skills"))


@query(
    f"WITH {CVS_SQL}, {GENERAL_ROWS_SQL.replace('rn <= 20', 'true')} SELECT cv_id, coalesce((SELECT string_agg(name || '/' || proficiency || '/'"
    " || category, '; ' ORDER BY rn) FROM general_rows r WHERE r.cv_id = c.cv_id), '') AS skills FROM cvs c"
)
def general_skills_all(t: Tables) -> DataFrame:
    return with_general_skills(t, None).select("cv_id", skills_text(F.col("skills")).alias("skills"))


@query("SELECT doc_id, {} AS category FROM documents".format(CATEGORY_SQL.format(s="text")))
def general_category(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", cvtext.general_category(F.col("text")).alias("category"))


GENERAL_COUNT_SQL = (
    "general_count AS (SELECT c.*, (SELECT count(*) FROM general_rows r WHERE r.cv_id = c.cv_id) AS n_skills FROM cvs c)"
)
GENERAL_SCORE_SQL = f"""least(100, CAST(trunc(40 + least(n_skills * 2, 25)
   + {sql_present('lower(cv_text)', D.GENERAL_SCORE_SECTIONS)} / 3.0::DOUBLE * 15
   + least({_figures(D.GENERAL_SCORE_NUMBERS)} * 2, 10)
   + least({sql_present('lower(cv_text)', D.GENERAL_ACTION_VERBS)} * 2, 10)) AS INTEGER))"""


def _band_sql(score: str, bands) -> str:
    whens = " ".join(f"WHEN {score} >= {bound} THEN {sql_text(text)}" for bound, text in bands[:-1])
    return f"CASE {whens} ELSE {sql_text(bands[-1][1])} END"


@query(
    f"WITH {CVS_SQL}, {GENERAL_ROWS_SQL}, {GENERAL_COUNT_SQL}, s AS (SELECT cv_id, {GENERAL_SCORE_SQL} AS ats_score FROM general_count)"
    f" SELECT cv_id, ats_score, {_band_sql('ats_score', D.GENERAL_SUMMARIES)} AS summary FROM s"
)
def general_score(t: Tables) -> DataFrame:
    score = cvtext.general_score(F.col("cv_text"), F.col("skills"))
    scored = with_general_skills(t).select("cv_id", score.alias("ats_score"))
    return scored.withColumn("summary", cvtext.by_score(F.col("ats_score"), D.GENERAL_SUMMARIES))


GENERAL_CHECKS = [
    ("n_skills < 5", D.GENERAL_SUGGESTIONS["skills"][0]),
    (f"{_figures(D.GENERAL_SUGGESTION_NUMBERS)} < 3", D.GENERAL_SUGGESTIONS["numbers"][0]),
    (f"NOT {sql_finds('lower(cv_text)', D.GENERAL_SUMMARY_PATTERN)}", D.GENERAL_SUGGESTIONS["summary"][0]),
]


@query(
    f"WITH {CVS_SQL}, {GENERAL_ROWS_SQL}, {GENERAL_COUNT_SQL} SELECT cv_id, {_suggestion_sql(GENERAL_CHECKS)} AS suggestions FROM general_count"
)
def general_suggestions(t: Tables) -> DataFrame:
    out = cvtext.general_suggestions(F.col("cv_text"), F.col("skills"))
    return with_general_skills(t).select("cv_id", titles(out).alias("suggestions"))




@query(
    f"WITH {CVS_SQL}, {GENERAL_ROWS_SQL} SELECT cv_id, CASE lang WHEN 'de' THEN source || '/Expert/X' ELSE"
    " coalesce((SELECT string_agg(name || '/' || proficiency || '/' || category, '; ' ORDER BY rn)"
    " FROM general_rows r WHERE r.cv_id = c.cv_id), '') END AS skills FROM cvs c"
)
def parse_replies(t: Tables) -> DataFrame:
    reply = F.when(
        F.col("lang") == "de",
        F.format_string('```json\n[{"name": "%s", "proficiency": "Expert", "category": "X"}]\n```', F.col("source")),
    ).when(F.col("lang") == "fr", F.lit('[{"name": broken'))
    c, hints = general_cvs(t)
    skills = cvtext.parse_reply(reply, F.col("cv_text"), hints, max_skills=20)
    return c.select("cv_id", skills_text(skills).alias("skills"))


# --------------------------------------------------------------------------- gaps and assembled context

REQUIRED_SQL = "CASE " + " ".join(
    f"WHEN contains(lower(target_role), {sql_text(role)}) THEN {sql_list(skills)}" for role, skills in D.ROLE_SKILLS
) + f" ELSE {sql_list(D.GENERIC_ROLE_SKILLS)} END"
GAP_SQL = f"""{TECH_ROWS_SQL},
  asked AS (SELECT c.*, {REQUIRED_SQL} AS required, coalesce((SELECT list(name) FROM tech_rows r WHERE r.cv_id = c.cv_id), []) AS held FROM cvs c),
  gaps AS (SELECT *, list_filter(required, lambda s: list_contains(held, s)) AS matching,
      list_filter(required, lambda s: NOT list_contains(held, s)) AS missing FROM asked)"""


@query(
    f"""WITH {CVS_SQL}, {GAP_SQL} SELECT cv_id, array_to_string(required, ', ') AS required, array_to_string(matching, ', ') AS matching,
    array_to_string(missing, ', ') AS missing, round_even(len(matching)::DOUBLE / len(required) * 100, 1) AS match_percentage,
    len(missing)::INTEGER AS skill_gap_count,
    CASE WHEN len(missing) = 0 THEN 'Great match! Your skills align well with ' || target_role || ' requirements.'
      ELSE 'Consider adding experience with ' || array_to_string(missing[1:3], ', ') || ' to better match ' || target_role || ' requirements.'
        || CASE WHEN len(missing) > 3 THEN '; Additional skills to consider: ' || array_to_string(missing[4:6], ', ') || '.' ELSE '' END
        || '; Highlight any relevant projects or coursework that demonstrate these skills, even if not from professional experience.' END AS advice
    FROM gaps"""
)
def gap_analysis(t: Tables) -> DataFrame:
    g = cvtext.gap_analysis(F.col("target_role"), F.col("skills"))
    out = with_tech_skills(t).select("cv_id", g.alias("g"))
    return out.select(
        "cv_id",
        F.array_join("g.required_skills", ", ").alias("required"),
        F.array_join("g.matching_skills", ", ").alias("matching"),
        F.array_join("g.missing_skills", ", ").alias("missing"),
        "g.match_percentage",
        "g.skill_gap_count",
        F.array_join("g.recommendations", "; ").alias("advice"),
    )


@query(
    f"WITH {CVS_SQL}, {GAP_SQL}, need AS (SELECT cv_id, unnest(required) AS skill FROM gaps)"
    " SELECT skill, count(*) AS missing FROM need n WHERE NOT EXISTS"
    " (SELECT 1 FROM tech_rows r WHERE r.cv_id = n.cv_id AND r.name = n.skill) GROUP BY skill"
)
def missing_skill_rows(t: Tables) -> DataFrame:
    """Required skills not held, as an anti join on rows, counted per skill."""
    required = cvs(t).select("cv_id", F.explode(cvtext.role_skills(F.col("target_role"))).alias("skill"))
    held = with_tech_skills(t).select("cv_id", F.explode_outer("skills.name").alias("skill"))
    missing = cvtext.gap_rows(held, required, "cv_id", "skill", matched=False)
    return missing.groupBy("skill").agg(F.count(F.lit(1)).alias("missing"))


@query(
    f"""WITH {CVS_SQL}, {GENERAL_ROWS_SQL}, {GENERAL_COUNT_SQL} SELECT cv_id, {GENERAL_SCORE_SQL} AS ats_score, n_skills::INTEGER AS total_skills,
    (SELECT count(*) FROM general_rows r WHERE r.cv_id = c.cv_id AND proficiency = 'Expert')::INTEGER AS expert,
    (SELECT count(*) FROM general_rows r WHERE r.cv_id = c.cv_id AND proficiency = 'Intermediate')::INTEGER AS intermediate,
    (SELECT count(*) FROM general_rows r WHERE r.cv_id = c.cv_id AND proficiency = 'Familiar')::INTEGER AS familiar,
    {_words_sql('cv_text')}::INTEGER AS cv_word_count, lang <> 'fr' AS has_gap_analysis,
    {" + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in GENERAL_CHECKS)} AS suggestion_count FROM general_count c"""
)
def cv_context(t: Tables) -> DataFrame:
    c = cvs(t).withColumn("target_role", F.when(F.col("lang") != "fr", F.col("target_role")))
    out = cvtext.analyze(c, variant="general", target="target_role", max_skills=20, max_suggestions=5)
    sizes = [F.size(f"{level}_skills").alias(level) for level in ("expert", "intermediate", "familiar")]
    return out.select(
        "cv_id", "ats_score", "total_skills", *sizes, "cv_word_count", "has_gap_analysis", "suggestion_count"
    )


# --------------------------------------------------------------------------- reports


@query(
    f"WITH {CVS_SQL}, {GENERAL_ROWS_SQL} SELECT cv_id, category, count(*)::INTEGER AS n FROM general_rows WHERE rn <= 10 GROUP BY cv_id, category"
)
def skills_per_category(t: Tables) -> DataFrame:
    c = with_general_skills(t).select("cv_id", "skills")
    return cvtext.skills_per_category(c, "cv_id", n=10)


@query(
    f"WITH {CVS_SQL}, {GENERAL_ROWS_SQL} SELECT c.cv_id, coalesce(string_agg(name || '=' || CASE proficiency WHEN 'Expert' THEN 3"
    " WHEN 'Intermediate' THEN 2 ELSE 1 END, '; ' ORDER BY rn), '') AS ranks FROM cvs c LEFT JOIN general_rows r"
    " ON r.cv_id = c.cv_id AND rn <= 8 GROUP BY c.cv_id"
)
def proficiency_ranks(t: Tables) -> DataFrame:
    c = with_general_skills(t).select("cv_id", "skills")
    ranks = F.transform(
        cvtext.proficiency_ranks(F.col("skills"), 8), lambda r: F.concat_ws("=", r["name"], r["rank"].cast("string"))
    )
    return c.select("cv_id", F.array_join(ranks, "; ").alias("ranks"))


@query(
    f"WITH {CVS_SQL}, {TECH_ROWS_SQL} SELECT lang, name AS skill, category, count(*) AS n,"
    " round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM cvs), 4) AS share_pct"
    " FROM tech_rows JOIN cvs USING (cv_id) GROUP BY lang, name, category"
)
def skill_demand(t: Tables) -> DataFrame:
    c = with_tech_skills(t).select("lang", "skills")
    return cvtext.skill_demand(c, by=["lang"])


@query(
    f"WITH {CVS_SQL}, {TECH_ROWS_SQL}, {TECH_COUNT_SQL}, s AS (SELECT {TECH_SCORE_SQL} AS score FROM tech_count)"
    f" SELECT {_band_sql('score', D.SCORE_BANDS)} AS band, count(*) AS n, round(avg(score), 4) AS mean_score FROM s GROUP BY 1"
)
def score_bands(t: Tables) -> DataFrame:
    scored = with_tech_skills(t).select(cvtext.tech_score(F.col("cv_text"), F.col("skills")).alias("ats_score"))
    return cvtext.score_bands(scored).withColumn("mean_score", F.round("mean_score", 4))


# --------------------------------------------------------------------------- dictionaries as tables

#: Phrases of the documents as further entries: the third and fourth word of each text, if both are letters only.
PHRASES_SQL = r"""entries AS (SELECT (1000 + row_number() OVER (ORDER BY name))::INTEGER AS ord, name FROM (SELECT DISTINCT lower(regexp_extract(text, '^\S+ \S+ (\p{L}+ \p{L}+)', 1)) AS name
    FROM documents) WHERE name <> ''),
  apart AS (SELECT cv_id, string_split('#' || regexp_replace(lower(cv_text), '[^\p{L}\p{M}\p{Nd}\p{Pc} ]', '#', 'g') || '#', ' ') AS c FROM cvs),
  word_pairs AS (SELECT DISTINCT cv_id, regexp_extract(c[i], '[^#]*$') || ' ' || regexp_extract(c[i + 1], '^[^#]*') AS name
    FROM (SELECT cv_id, c, unnest(range(1, len(c))) AS i FROM apart)),
  phrase_rows AS (SELECT cv_id, ord, name FROM word_pairs JOIN entries USING (name))"""


def _level_of(name: str) -> str:
    def any_of(phrases):
        return " OR ".join("contains(lower(cv_text), {})".format(" || ".join(filter(None, (sql_text(a) if a else "", name, sql_text(b) if b else "")))) for a, b in (p.split("{}") for p in phrases))

    return f"CASE WHEN {any_of(D.EXPERT_PHRASES)} THEN 'Expert' WHEN {any_of(D.INTERMEDIATE_PHRASES)} THEN 'Intermediate' ELSE 'Familiar' END"


GENERAL_ROWS_SQL = " UNION ALL ".join(
    f"SELECT cv_id, {i} AS ord, {sql_text(n)} AS name FROM cvs WHERE {sql_finds('cv_text', p)}" for i, (n, p, _) in enumerate(D.GENERAL_SKILLS)
)


def dictionary_of(t: Tables, fixed: DataFrame) -> DataFrame:
    """A dictionary table: fixed entries, and the documents' phrases."""
    name = F.lower(F.regexp_extract("text", r"^\S+ \S+ (\p{L}+ \p{L}+)", 1))
    names = t.documents.select(name.alias("name")).filter("name <> ''").distinct()
    order = Window.orderBy("name")  # a dictionary is numbered as a whole; it is small beside the texts
    entries = names.select(
        (1000 + F.row_number().over(order)).cast("int").alias("ord"), "name", F.lit("Phrases").alias("category"),
        F.concat(F.lit(r"\b"), "name", F.lit(r"\b")).alias("pattern"), F.array("name").alias("forms"),
    )
    return fixed.unionByName(entries)


@query(
    f"WITH {CVS_SQL}, {TECH_ROWS_SQL}, {PHRASES_SQL}, every_row AS (SELECT cv_id, ord, name, proficiency, category FROM tech_rows UNION ALL"
    f" SELECT p.cv_id, ord, name, {_level_of('name')}, 'Phrases' FROM phrase_rows p JOIN cvs c ON c.cv_id = p.cv_id WHERE {GATE_SQL})"
    f" SELECT cv_id, coalesce((SELECT string_agg(name || '/' || proficiency || '/' || category, '; ' ORDER BY {LEVEL_SQL}, ord)"
    " FROM every_row r WHERE r.cv_id = c.cv_id), '') AS skills FROM cvs c"
)
def tech_skills_from_table(t: Tables) -> DataFrame:
    """Technical skills and the documents' phrases, all from one dictionary table."""
    found = phrases.with_tech_skills(cvs(t).select("cv_id", "cv_text"), "cv_text", dictionary_of(t, phrases.tech_dictionary(t.spark)))
    return found.select("cv_id", skills_text(F.col("skills")).alias("skills"))


@query(
    f"WITH {CVS_SQL}, {PHRASES_SQL}, fixed AS ({GENERAL_ROWS_SQL}), every_row AS (SELECT * FROM fixed UNION ALL SELECT cv_id, ord, name FROM phrase_rows)"
    " SELECT cv_id, coalesce((SELECT string_agg(name, '; ' ORDER BY ord) FROM every_row r WHERE r.cv_id = c.cv_id), '') AS names FROM cvs c"
)
def general_entries_from_table(t: Tables) -> DataFrame:
    """Entries of the general dictionary and the documents' phrases that each text holds."""
    held = phrases.with_entries(cvs(t).select("cv_id", "cv_text"), "cv_text", dictionary_of(t, phrases.general_dictionary(t.spark)))
    return held.select("cv_id", F.array_join(F.transform("entries", lambda e: e["name"]), "; ").alias("names"))


@query(ORACLES["general_skills_all"])
def general_skills_from_table(t: Tables) -> DataFrame:
    """The general variant with its dictionary as a table."""
    found = phrases.with_general_skills(cvs(t).select("cv_id", "cv_text"), "cv_text")
    return found.select("cv_id", skills_text(F.col("skills")).alias("skills"))
