"""Rule-based CV analysis as column expressions, and its corpus-level reports.

Two variants of every rule: "tech" (technical dictionary behind a gate) and
"general" (skills section plus a dictionary for all professions). All of it is
row-local; only the corpus reports shuffle, on small keys. Rules are JVM
expressions; with_hints() adds one Arrow pass that tells which regexes can match.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dictionaries as D
from vacantia.functions.bind import once
from vacantia.functions.keywords import occurring, vocabulary
from vacantia.functions.labels import lookup
from vacantia.functions.text import (
    contains_any,
    count_present,
    folded,
    ignoring_case,
    strip_space,
    title_case,
    word_count,
)
from vacantia.operators.rows import first_matching_label

SKILLS_TYPE = "array<struct<name:string,proficiency:string,category:string>>"


def _mentions(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(ignoring_case(pattern)))


def _finds(text: Column, pattern: str) -> Column:
    return text.rlike(ignoring_case(pattern))


def _no_skills() -> Column:
    return F.array().cast(SKILLS_TYPE)


def _skill(name: Column, proficiency: Column, category: Column) -> Column:
    return F.struct(
        name.alias("name"), proficiency.alias("proficiency"), category.alias("category")
    )


TECH_WORDS = vocabulary(
    *[needles for _, needles in D.TECH_CV_PATTERNS],
    *[entry[3] for entry in D.TECH_SKILLS],
    *[entry[3] for entry in D.TECH_SECTION_PATTERNS],
)
GENERAL_WORDS = vocabulary(
    ("skill", "competencies"),
    *[entry[2] for entry in D.GENERAL_SKILLS],
    *[entry[3] for entry in D.GENERAL_SECTION_PATTERNS],
)


class Hints:
    """Cheap proof that a pattern cannot match: none of its fixed texts occurs.

    Built by with_hints() from one pass over the text. Without a column it
    proves nothing and every pattern is tried.
    """

    def __init__(self, column: Column | None = None, words: Sequence[str] = ()):
        self.column, self.index = column, {word: i for i, word in enumerate(words)}

    def any(self, needles: Sequence[str]) -> Column:
        if self.column is None:
            return F.lit(True)
        checks = [F.array_contains(self.column, self.index[n]) for n in needles]
        return reduce(lambda a, b: a | b, checks)


def with_hints(df: DataFrame, text: str, variant: str, out: str = "_hints") -> tuple[DataFrame, Hints]:
    words = TECH_WORDS if variant == "tech" else GENERAL_WORDS
    return df.withColumn(out, occurring(folded(F.col(text)), words)), Hints(F.col(out), words)


def _matched_positions(text: Column, entries: Sequence, hints: Hints) -> Column:
    """Indexes of the dictionary entries (pattern, needles) found in the text."""
    hits = [
        F.when(hints.any(needles) & _finds(text, pattern), F.lit(i))
        for i, (pattern, needles) in enumerate(entries)
    ]
    return F.filter(F.array(*hits), lambda i: i.isNotNull())


# --------------------------------------------------------------------------- tech variant


def is_tech_cv(
    text: Column, patterns: Sequence = D.TECH_CV_PATTERNS, hints: Hints = Hints()
) -> Column:
    checks = [hints.any(needles) & _finds(text, p) for p, needles in patterns]
    return reduce(lambda a, b: a | b, checks)


def phrase_rank(lowered: Column, skill: Column, held: Column | None = None) -> Column:
    """1 (Expert) or 2 (Intermediate) when such a phrase names the skill, else 3 (Familiar).

    With `held` (phrases_held() of the text) the skill is looked for only beside the fixed parts of the phrases.
    """
    every = [*D.EXPERT_PHRASES, *D.INTERMEDIATE_PHRASES]

    def any_phrase(phrases: Sequence[str]) -> Column:
        checks = []
        for phrase in phrases:
            before, after = phrase.split("{}")
            check = lowered.contains(F.concat(F.lit(before), skill, F.lit(after)))
            if held is not None:
                beside, next_to = F.get(held, F.lit(every.index(phrase))), F.reverse(skill) if after else skill
                near = F.exists(beside, lambda x: x.startswith(next_to))  # noqa: B023
                check = F.when(F.length(skill) > PHRASE_REACH, (F.size(beside) > 0) & check).otherwise(near)
            checks.append(check)
        return reduce(lambda a, b: a | b, checks)

    return (
        F.when(any_phrase(D.EXPERT_PHRASES), F.lit(1))
        .when(any_phrase(D.INTERMEDIATE_PHRASES), F.lit(2))
        .otherwise(F.lit(3))
    )


#: Characters beside a phrase's fixed part that are kept for comparison; longer names are looked for in the whole text.
PHRASE_REACH = 64


def phrases_held(lowered: Column) -> Column:
    """For each level phrase what follows its fixed part, at every place where the text holds it.

    Where the fixed part comes last, it is what precedes it, from the end. No fixed part overlaps itself.
    """

    def beside(phrase: str) -> Column:
        before, after = phrase.split("{}")
        text, fixed = (F.reverse(lowered), after[::-1]) if after else (lowered, before)
        return F.when(lowered.contains(before + after), F.regexp_extract_all(text, F.lit(rf"(?s){fixed}(?=(.{{0,{PHRASE_REACH}}}))"), F.lit(1))).otherwise(F.array().cast("array<string>"))

    return F.array(*map(beside, (*D.EXPERT_PHRASES, *D.INTERMEDIATE_PHRASES)))


def _at_level(skills: Column, level: str) -> Column:
    return F.filter(skills, lambda s: s.proficiency == level)


def tech_skills(
    text: Column,
    dictionary: Sequence = D.TECH_SKILLS,
    compat: bool = False,
    hints: Hints = Hints(),
) -> Column:
    """Skills found by the technical dictionary; none when the text fails the gate.

    Ordered Expert, Intermediate, Familiar, each in dictionary order;
    compat=True orders by the level's name descending instead (Intermediate,
    Familiar, Expert).
    """
    names = F.array(*[F.lit(e[0]) for e in dictionary])
    keys = F.array(*[F.lit(e[0].lower()) for e in dictionary])
    categories = F.array(*[F.lit(e[2]) for e in dictionary])
    levels = F.array(*map(F.lit, D.PROFICIENCY_RANK))
    place = F.array(*map(F.lit, (3, 1, 2) if compat else (1, 2, 3)))

    def ranked(lowered: Column) -> Column:
        positions = _matched_positions(text, [(e[1], e[3]) for e in dictionary], hints)
        return F.transform(
            positions,
            lambda i: once(
                phrase_rank(lowered, F.get(keys, i)),
                lambda r: F.struct(F.get(place, r - 1).alias("p"), i.alias("i"), r.alias("r")),
            ),
        )

    found = F.transform(
        F.array_sort(once(F.lower(text), ranked)),
        lambda s: _skill(F.get(names, s.i), F.get(levels, s.r - 1), F.get(categories, s.i)),
    )
    return F.when(is_tech_cv(text, hints=hints), found.cast(SKILLS_TYPE)).otherwise(_no_skills())


def tech_score(text: Column, skills: Column) -> Column:
    """Readiness 0..100 from skills, sections, figures and action verbs."""
    lowered = F.lower(text)
    sections = count_present(lowered, D.TECH_SCORE_SECTIONS) / F.lit(len(D.TECH_SCORE_SECTIONS))
    figures = F.regexp_count(text, F.lit("(?U)" + D.TECH_SCORE_NUMBERS))
    verbs = count_present(lowered, D.TECH_ACTION_VERBS)
    score = (
        F.lit(50)
        + F.least(F.size(skills) * 1.5, F.lit(20.0))
        + sections * 15
        + F.when(figures >= 3, 10).when(figures >= 1, 5).otherwise(0)
        + F.when(verbs >= 5, 5).otherwise(0)
    )
    return F.least(score.cast("int"), F.lit(100))


def tech_suggestions(text: Column, max_items: int | None = None) -> Column:
    """Titles and texts of the checks that fail, in a fixed order; max_items limits them."""
    lowered = F.lower(text)
    figures = F.regexp_count(text, F.lit("(?U)" + D.TECH_SCORE_NUMBERS))
    failed = {
        "numbers": figures < 3,
        "summary": ~lowered.rlike("(?U)" + D.TECH_SUGGESTION_PATTERNS["summary"]),
        "verbs": count_present(lowered, D.TECH_ACTION_VERBS) < 5,
        "certifications": ~lowered.rlike("(?U)" + D.TECH_SUGGESTION_PATTERNS["certifications"]),
        "projects": ~lowered.rlike("(?U)" + D.TECH_SUGGESTION_PATTERNS["projects"]),
        "education": ~lowered.rlike("(?U)" + D.TECH_SUGGESTION_PATTERNS["education"]),
    }
    items = [
        F.when(condition, _suggestion(*D.TECH_SUGGESTIONS[name]))
        for name, condition in failed.items()
    ]
    return _at_most(F.filter(F.array(*items), lambda s: s.isNotNull()), max_items)


def _at_most(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def _suggestion(category: str | None, priority: str | None, title: str, description: str) -> Column:
    return F.struct(
        F.lit(category).cast("string").alias("category"),
        F.lit(priority).cast("string").alias("priority"),
        F.lit(title).alias("title"),
        F.lit(description).alias("description"),
    )


# --------------------------------------------------------------------------- general variant


def general_category(name: Column) -> Column:
    return first_matching_label(F.lower(name), D.SKILL_CATEGORY_RULES, D.DEFAULT_SKILL_CATEGORY)


def document_proficiency(lowered: Column, skill: Column) -> Column:
    """Level from words anywhere in the text, provided the skill name occurs too."""
    named = lowered.contains(skill)
    return (
        F.when(named & contains_any(lowered, D.EXPERT_WORDS), F.lit("Expert"))
        .when(named & contains_any(lowered, D.INTERMEDIATE_WORDS), F.lit("Intermediate"))
        .otherwise(F.lit("Familiar"))
    )


def skills_section_body(text: Column, hints: Hints = Hints()) -> Column:
    """Body of the first skills section, null without one."""
    bodies = []
    for pattern in D.SKILL_SECTION_PATTERNS:
        regex = f"(?isU){pattern}"
        bodies.append(F.when(text.rlike(regex), F.regexp_extract(text, regex, 2)))
    return F.when(hints.any(("skill", "competencies")), F.coalesce(*bodies))


def section_skills(text: Column, hints: Hints = Hints()) -> Column:
    """Skills listed in the skills section: items of 3 to 49 characters, title-cased."""
    items = F.split(skills_section_body(text, hints), r"[•\n,]")
    trimmed = F.transform(
        items, lambda s: strip_space(F.regexp_replace(strip_space(s), r"^-+|-+$", ""))
    )
    named = F.filter(trimmed, lambda s: (F.length(s) > 2) & (F.length(s) < 50))
    skills = F.transform(
        named, lambda s: _skill(title_case(s), F.lit("Intermediate"), general_category(s))
    )
    return F.coalesce(skills.cast(SKILLS_TYPE), _no_skills())


def general_skills(
    text: Column,
    dictionary: Sequence = D.GENERAL_SKILLS,
    max_skills: int | None = None,
    hints: Hints = Hints(),
) -> Column:
    """Section skills first, then dictionary skills not listed by name; max_skills limits them."""
    names = F.array(*[F.lit(e[0]) for e in dictionary])

    def found(lowered: Column) -> Column:
        positions = _matched_positions(text, [(e[1], e[2]) for e in dictionary], hints)
        skills = F.transform(
            F.transform(positions, lambda i: F.get(names, i)),
            lambda n: _skill(n, document_proficiency(lowered, F.lower(n)), general_category(n)),
        )
        return skills.cast(SKILLS_TYPE)

    def merged(listed: Column) -> Column:
        fresh = F.filter(
            once(F.lower(text), found),
            lambda s: ~F.exists(listed, lambda have: have["name"] == s["name"]),
        )
        return _at_most(F.concat(listed, fresh), max_skills)

    return once(section_skills(text, hints), merged)


def general_score(text: Column, skills: Column) -> Column:
    lowered = F.lower(text)
    sections = count_present(lowered, D.GENERAL_SCORE_SECTIONS) / F.lit(
        len(D.GENERAL_SCORE_SECTIONS)
    )
    figures = _mentions(text, D.GENERAL_SCORE_NUMBERS)
    verbs = count_present(lowered, D.GENERAL_ACTION_VERBS)
    score = (
        F.lit(40)
        + F.least(F.size(skills) * 2, F.lit(25))
        + sections * 15
        + F.least(figures * 2, F.lit(10))
        + F.least(verbs * 2, F.lit(10))
    )
    return F.least(score.cast("int"), F.lit(100))


def general_suggestions(text: Column, skills: Column) -> Column:
    failed = {
        "skills": F.size(skills) < 5,
        "numbers": _mentions(text, D.GENERAL_SUGGESTION_NUMBERS) < 3,
        "summary": ~F.lower(text).rlike("(?U)" + D.GENERAL_SUMMARY_PATTERN),
    }
    items = [
        F.when(condition, _suggestion(None, None, *D.GENERAL_SUGGESTIONS[name]))
        for name, condition in failed.items()
    ]
    return F.filter(F.array(*items), lambda s: s.isNotNull())


# --------------------------------------------------------------------------- both variants


def by_score(score: Column, bands: Sequence[tuple[int | None, str]]) -> Column:
    """Text of the first band whose lower bound the score reaches."""
    out = F.lit(bands[-1][1])
    for bound, text in reversed(bands[:-1]):
        out = F.when(score >= bound, F.lit(text)).otherwise(out)
    return out


def section_shares(
    text: Column, patterns: Sequence, general: bool = False, hints: Hints = Hints()
) -> Column:
    """Map section -> share of mentions in percent.

    general=True drops sections without a mention and adds "Other" from the
    text length.
    """
    names = [entry[0] for entry in patterns]
    counts = F.array(
        *[
            F.when(hints.any(needles), _mentions(text, pattern) * weight).otherwise(0)
            for _, pattern, weight, needles in patterns
        ]
    )
    # The last element is the "Other" count, the one before it the sum of the mentions.
    other = F.greatest(F.lit(1), F.floor(word_count(text) / 100).cast("int"))
    def mentioned(c: Column) -> Column:
        return reduce(lambda a, b: a + b, [c[i] for i in range(len(names))])


    def shares(c: Column) -> Column:
        divisor = F.when(c[len(names)] > 0, c[len(names)] + (c[len(names) + 1] if general else 0))
        entries = [
            F.struct(F.lit(n).alias("k"), (c[i] / divisor.otherwise(1) * 100).alias("v"))
            for i, n in enumerate(names)
        ]
        if not general:
            return F.array(*entries)
        rest = F.when(c[len(names)] > 0, c[len(names) + 1] / divisor.otherwise(1) * 100)
        entries.append(F.struct(F.lit("Other").alias("k"), rest.otherwise(0.0).alias("v")))
        return F.filter(F.array(*entries), lambda e: e.v > 0)

    extended = once(counts, lambda c: F.concat(c, F.array(mentioned(c), other)))
    return F.map_from_entries(once(extended, shares))


def visible_sections(shares: Column, at_least: float = 3.0) -> Column:
    """Sections with at least the given share, largest first: array of (section, share)."""
    entries = F.transform(
        F.map_entries(shares), lambda e: F.struct((-e.value).alias("o"), e.key.alias("section"))
    )
    kept = F.filter(entries, lambda e: -e.o >= at_least)
    return F.transform(
        F.array_sort(kept), lambda e: F.struct(e.section.alias("section"), (-e.o).alias("share"))
    )


def skills_at(skills: Column, level: str) -> Column:
    return _at_level(skills, level)


def proficiency_ranks(skills: Column, n: int | None = None) -> Column:
    """(name, 3|2|1) of the skills, or the first n; an unknown level counts as 1."""
    return F.transform(
        _at_most(skills, n),
        lambda s: F.struct(
            s["name"].alias("name"),
            F.coalesce(lookup(D.PROFICIENCY_RANK, s.proficiency), F.lit(1)).alias("rank"),
        ),
    )


def role_skills(target: Column, roles: Sequence = D.ROLE_SKILLS, generic: Sequence[str] = D.GENERIC_ROLE_SKILLS) -> Column:
    """Required skills of the first role named in the target, else the generic list."""
    lowered = F.lower(target)
    out = F.array(*map(F.lit, generic))
    for role, skills in reversed(roles):
        out = F.when(lowered.contains(role), F.array(*map(F.lit, skills))).otherwise(out)
    return out


def gap_analysis(target: Column, skills: Column) -> Column:
    """Struct of required, matching and missing skills, match percentage and advice."""
    held = F.transform(skills, lambda s: s["name"])
    sides = once(
        role_skills(target),
        lambda required: once(
            held,
            lambda names: F.struct(
                required.alias("required"),
                F.array_intersect(required, names).alias("matching"),
                F.array_except(required, names).alias("missing"),
            ),
        ),
    )

    def report(g: Column) -> Column:
        return F.struct(
            target.alias("target_role"),
            g.required.alias("required_skills"),
            g.matching.alias("matching_skills"),
            g.missing.alias("missing_skills"),
            F.bround(F.size(g.matching) / F.size(g.required) * 100, 1).alias("match_percentage"),
            F.size(g.missing).alias("skill_gap_count"),
            _gap_advice(target, g.missing).alias("recommendations"),
        )

    return once(sides, report)


def _gap_advice(target: Column, missing: Column) -> Column:
    first, more = F.slice(missing, 1, 3), F.slice(missing, 4, 3)
    lines = F.array(
        F.when(
            F.size(missing) > 0,
            F.concat(
                F.lit("Consider adding experience with "),
                F.array_join(first, ", "),
                F.lit(" to better match "),
                target,
                F.lit(" requirements."),
            ),
        ),
        F.when(
            F.size(missing) > 3,
            F.concat(F.lit("Additional skills to consider: "), F.array_join(more, ", "), F.lit(".")),
        ),
        F.when(F.size(missing) > 0, F.lit(D.GAP_HIGHLIGHT)),
        F.when(
            F.size(missing) == 0,
            F.concat(F.lit("Great match! Your skills align well with "), target, F.lit(" requirements.")),
        ),
    )
    return F.filter(lines, lambda s: s.isNotNull())


def parse_reply(reply: Column, text: Column, hints: Hints = Hints(), max_skills: int | None = None) -> Column:
    """Skills from a model's JSON reply; the general rules when it is missing or malformed."""
    bare = strip_space(F.replace(F.replace(reply, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    parsed = F.when(bare.startswith("["), F.from_json(bare, SKILLS_TYPE))
    return F.coalesce(parsed, general_skills(text, max_skills=max_skills, hints=hints))


def analyze(
    df: DataFrame, text: str = "cv_text", variant: str = "general", target: str | None = None,
    max_skills: int | None = None, max_suggestions: int | None = None,
) -> DataFrame:
    """Adds score, summary, skills (all and per level), suggestions, sections and word count."""
    t = F.col(text)
    tech = variant == "tech"
    df, hints = with_hints(df, text, variant)
    # Skills in a step of their own: later expressions reuse the column.
    found = tech_skills(t, hints=hints) if tech else general_skills(t, max_skills=max_skills, hints=hints)
    df = df.withColumn("skills", found)
    skills = F.col("skills")
    df = df.withColumn("ats_score", tech_score(t, skills) if tech else general_score(t, skills))
    patterns = D.TECH_SECTION_PATTERNS if tech else D.GENERAL_SECTION_PATTERNS
    out = df.withColumns(
        {
            "analysis_summary": by_score(
                F.col("ats_score"), D.TECH_SUMMARIES if tech else D.GENERAL_SUMMARIES
            ),
            "expert_skills": skills_at(skills, "Expert"),
            "intermediate_skills": skills_at(skills, "Intermediate"),
            "familiar_skills": skills_at(skills, "Familiar"),
            "total_skills": F.size(skills),
            "suggestions": tech_suggestions(t, max_suggestions) if tech else general_suggestions(t, skills),
            "sections": section_shares(t, patterns, general=not tech, hints=hints),
            "cv_word_count": word_count(t),
        }
    )
    out = out.withColumn("suggestion_count", F.size("suggestions")).drop("_hints")
    if target is not None:
        asked = F.coalesce(F.col(target), F.lit("")) != ""
        out = out.withColumn("gap_analysis", F.when(asked, gap_analysis(F.col(target), skills)))
        out = out.withColumn("has_gap_analysis", asked)
    return out


def skills_per_category(df: DataFrame, identifier: str, skills: str = "skills", n: int | None = None) -> DataFrame:
    """(id, category, n) over each row's skills, or the first n, computed inside the row."""
    first = F.transform(_at_most(F.col(skills), n), lambda s: s.category)
    counted = F.transform(
        F.array_distinct(first),
        lambda c: F.struct(c.alias("category"), F.size(F.filter(first, lambda x: x == c)).alias("n")),
    )
    # The outer form: for the inner one Spark adds a filter that evaluates the skills once more.
    return df.select(identifier, F.inline_outer(counted)).filter(F.col("category").isNotNull())


def skill_demand(df: DataFrame, skills: str = "skills", by: Sequence[str] = ()) -> DataFrame:
    """Rows naming each skill and their share of all rows, optionally per other columns.

    Skill names are a small set, so the exploded rows collapse on the map side.
    """
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    named = df.select(
        *by,
        F.explode_outer(
            F.array_distinct(
                F.transform(F.col(skills), lambda s: F.struct(s["name"].alias("skill"), s.category.alias("category")))
            )
        ).alias("s"),
    )
    return (
        named.filter(F.col("s").isNotNull())
        .groupBy(*by, "s.skill", "s.category")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("share_pct", F.bround(100 * F.col("n") / rows, 4))
    )


def score_bands(df: DataFrame, score: str = "ats_score") -> DataFrame:
    return df.groupBy(by_score(F.col(score), D.SCORE_BANDS).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score")
    )


def gap_rows(held: DataFrame, required: DataFrame, key: str, skill: str, matched: bool) -> DataFrame:
    """Required (key, skill) rows that are held, or not held, as a semi or anti join."""
    how = "left_semi" if matched else "left_anti"
    return required.join(held.select(key, skill), [key, skill], how)
