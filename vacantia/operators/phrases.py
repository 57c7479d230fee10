"""Dictionaries as tables: entries found in texts by an equi-join on words, verified by pattern where words do not decide.

The plan is the same for ten entries and for ten thousand: texts are split into words, the words
of many texts together meet the dictionary's in a join (which Spark broadcasts or shuffles by its
own size check), and patterns are tried only where words alone do not decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import dictionaries as D
from vacantia.functions.bind import once
from vacantia.functions.text import folded, ignoring_case
from vacantia.operators import cvtext
from vacantia.operators.blocks import with_candidates
from vacantia.session import materialize

ENTRY = "ord int, name string, category string, pattern string, forms array<string>"
#: What separates words: the complement of a pattern's word characters.
GAP = r"(?U)\W+"


def literal_forms(pattern: str) -> list[str]:
    """All texts that a pattern of letters, escapes, (a|b), (?:x)? and x? matches, without the \\b at its ends.

    Patterns with other signs have no finite list and raise; their entries need forms of their own.
    """
    body = pattern.removeprefix(r"\b").removesuffix(r"\b")
    forms, rest = _alternatives(body, 0)
    if rest != len(body):
        raise ValueError(f"unbalanced pattern {pattern}")
    return list(dict.fromkeys(forms))


def _alternatives(body: str, at: int) -> tuple[list[str], int]:
    """Texts of the alternatives from ``at`` up to a closing bracket or the end, and where that is."""
    done: list[str] = []
    heads = [""]
    while at < len(body) and body[at] != ")":
        sign = body[at]
        if sign == "|":
            done, heads, at = done + heads, [""], at + 1
            continue
        if sign == "(":
            parts, at = _alternatives(body, at + (3 if body.startswith("(?:", at) else 1))
            at += 1
        elif sign == "\\" and at + 1 < len(body) and not body[at + 1].isalnum():
            parts, at = [body[at + 1]], at + 2
        elif sign in "\\.*+?[]{}^$":
            raise ValueError(f"{sign} has no finite list of texts in {body}")
        else:
            parts, at = [sign], at + 1
        if at < len(body) and body[at] == "?":
            parts, at = [*parts, ""], at + 1
        heads = [h + p for h in heads for p in parts]
    return done + heads, at


def dictionary_table(spark: SparkSession, entries: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Entries (name, category, pattern) in their order as a table, with the texts each pattern stands for."""
    rows = [(i, name, category, pattern, literal_forms(pattern)) for i, (name, category, pattern) in enumerate(entries)]
    return spark.createDataFrame(rows, ENTRY)


def tech_dictionary(spark: SparkSession) -> DataFrame:
    return dictionary_table(spark, [(name, category, pattern) for name, pattern, category, _ in D.TECH_SKILLS])


def general_dictionary(spark: SparkSession) -> DataFrame:
    """Categories follow from the names, once per entry and not once per hit."""
    table = dictionary_table(spark, [(name, "", pattern) for name, pattern, _ in D.GENERAL_SKILLS])
    return table.withColumn("category", cvtext.general_category(F.col("name")))


def word_list(text: Column) -> Column:
    return F.filter(F.split(folded(text), GAP), lambda w: w != "")


def _key_index(dictionary: DataFrame) -> DataFrame:
    """(key, entry): the first word of each form, or the first two with the gaps that are allowed.

    An entry whose pattern is one or two whole words, with one blank between them, and nothing
    else is there wherever its key is (`sure`); other keys only say where to try the pattern.
    """
    form = F.get("forms", F.lit(0))
    plain = (F.size("forms") == 1) & (F.col("pattern") == F.concat(F.lit(r"\b"), form, F.lit(r"\b"))) & form.rlike(r"(?U)\A\w+(?: \w+)?\z")
    entry = F.struct("ord", "name", "category", F.concat(F.lit(ignoring_case("")), "pattern").alias("pattern"), F.coalesce(plain, F.lit(False)).alias("sure"))
    forms = dictionary.select(entry.alias("entry"), F.explode("forms").alias("form"))
    words = forms.select("entry", word_list(F.col("form")).alias("words")).filter(F.size("words") > 0)
    first, second = F.get("words", F.lit(0)), F.get("words", F.lit(1))
    blank, other = (F.concat(first, F.lit(gap), second) for gap in (" ", "\t"))
    keys = F.when(second.isNull(), F.array(first)).when(F.col("entry.sure"), F.array(blank)).otherwise(F.array(blank, other))
    return words.select("entry", F.explode(keys).alias("key")).distinct()


def with_entries(df: DataFrame, text: str, dictionary: DataFrame, out: str = "entries") -> DataFrame:
    """Each row with the dictionary's entries that its text holds: array of (ord, name, category, pattern) by ord.

    Texts are cut into words and pairs of words that follow each other, which meet the entries
    that begin with them by equal keys (`blocks.with_candidates`, which writes the rows once to the
    shared folder): an entry of several words meets only texts that hold its first two in a row.
    Entries of one or two plain words are then found, and the pattern of any other decides, blind
    to case and with Unicode word boundaries. A form without any word character is never found.
    Null texts hold no entry; repeated rows and null ids are rows like others.
    """
    given = with_candidates(df, text, materialize(_key_index(dictionary), "entry_keys"))
    found = F.filter(F.col("_candidates"), lambda e: e["sure"] | F.regexp_like(F.col(text), e["pattern"]))
    different = once(F.array_sort(found), lambda es: F.filter(es, lambda e, i: (i == 0) | ~e.eqNullSafe(F.get(es, i - 1))))
    listed = F.transform(different, lambda e: F.struct(*[e[n].alias(n) for n in ("ord", "name", "category", "pattern")]))
    return given.withColumn(out, listed).drop("_candidates")


def with_tech_skills(df: DataFrame, text: str, dictionary: DataFrame | None = None, out: str = "skills", compat: bool = False) -> DataFrame:
    """Skills of a technical dictionary table, as cvtext.tech_skills gives them for constants."""
    held = with_entries(df, text, dictionary if dictionary is not None else tech_dictionary(df.sparkSession), "_entries")
    levels = F.array(*map(F.lit, D.PROFICIENCY_RANK))
    place = F.array(*map(F.lit, (3, 1, 2) if compat else (1, 2, 3)))

    def ranked(lowered: Column) -> Column:
        return once(cvtext.phrases_held(lowered), lambda held: listed(lowered, held))

    def listed(lowered: Column, held: Column) -> Column:
        return F.transform(
            "_entries",
            lambda e: once(
                cvtext.phrase_rank(lowered, F.lower(e["name"]), held),
                lambda r: F.struct(F.get(place, r - 1).alias("p"), e["ord"].alias("i"), r.alias("r"), e["name"].alias("name"), e["category"].alias("category")),
            ),
        )

    skills = F.transform(
        F.array_sort(once(F.lower(F.col(text)), ranked)),
        lambda s: F.struct(s["name"].alias("name"), F.get(levels, s["r"] - 1).alias("proficiency"), s["category"].alias("category")),
    )
    some = (F.size("_entries") > 0) & is_tech_cv(F.col(text))
    none = F.array().cast(cvtext.SKILLS_TYPE)
    return held.withColumn(out, F.when(some, skills.cast(cvtext.SKILLS_TYPE)).otherwise(none)).drop("_entries")


def with_general_skills(
    df: DataFrame, text: str, dictionary: DataFrame | None = None, out: str = "skills", max_skills: int | None = None
) -> DataFrame:
    """Skills of the skills section, then those of a dictionary table that the section does not name."""
    held = with_entries(df, text, dictionary if dictionary is not None else general_dictionary(df.sparkSession), "_entries")

    def found(lowered: Column) -> Column:
        skills = F.transform(
            "_entries",
            lambda e: F.struct(
                e["name"].alias("name"), cvtext.document_proficiency(lowered, F.lower(e["name"])).alias("proficiency"), e["category"].alias("category")
            ),
        )
        return skills.cast(cvtext.SKILLS_TYPE)

    def merged(listed: Column) -> Column:
        fresh = F.filter(once(F.lower(F.col(text)), found), lambda s: ~F.exists(listed, lambda have: have["name"] == s["name"]))
        every = F.concat(listed, fresh)
        return every if max_skills is None else F.slice(every, 1, max_skills)

    return held.withColumn(out, once(cvtext.section_skills(F.col(text), Contained(text)), merged)).drop("_entries")


class Contained(cvtext.Hints):
    """Proof by plain containment that a pattern cannot match; for a handful of words, without a pass in Python."""

    def __init__(self, text: str):
        super().__init__()
        self.text = text

    def any(self, needles: Sequence[str]) -> Column:
        return once(folded(F.col(self.text)), lambda t: F.exists(F.array(*map(F.lit, needles)), lambda n: t.contains(n)))


def is_tech_cv(text: Column, patterns: Sequence = D.TECH_CV_PATTERNS) -> Column:
    """The gate of the technical rules: each pattern is tried only where one of its words occurs."""

    def gate(lowered: Column) -> Column:
        checks = F.lit(False)
        for pattern, needles in patterns:
            here = F.exists(F.array(*map(F.lit, needles)), lambda n: lowered.contains(n))
            checks = checks | (here & text.rlike(ignoring_case(pattern)))
        return checks

    return F.coalesce(once(folded(text), gate), F.lit(False))
