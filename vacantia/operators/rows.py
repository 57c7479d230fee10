"""Row mapping: raw payloads to postings, clean-up and output projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia.functions import dictionaries as D
from vacantia.functions.dates import age_in_days
from vacantia.functions.keywords import occurring, vocabulary
from vacantia.functions.labels import lookup
from vacantia.functions.text import (
    blank_to_null,
    contains_any,
    first_filled,
    strip_space,
    truncate_text,
)
from vacantia.operators.ranking import top_per_group
from vacantia.schema import CANONICAL, CANONICAL_ALIASES


def first_matching_label(text: Column, rules: Sequence, default: str) -> Column:
    """Label of the first rule with a keyword in the (lower-cased) text."""
    label = F.lit(default)
    for name, keywords in reversed(rules):
        label = F.when(contains_any(text, keywords), F.lit(name)).otherwise(label)
    return label


def infer_category(
    title: Column,
    description: Column,
    given: Column,
    rules: Sequence = D.CATEGORY_RULES,
    default: str = "Unknown",
) -> Column:
    """The given category when filled, else the first keyword rule that hits the whole text."""
    given = blank_to_null(given)
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    words = vocabulary(*[keywords for _, keywords in rules])
    labels = [next(label for label, keywords in rules if word in keywords) for word in words]
    # Words are listed in rule order, so the lowest index found belongs to the first rule that hits.
    found = occurring(F.when(given.isNull(), F.lower(text)), words)
    inferred = F.get(F.array(*map(F.lit, labels)), F.array_min(found))
    return F.coalesce(given, inferred, F.lit(default))


def resolve_country(
    code: Column, area: Column, labels: Mapping[str, str] = D.COUNTRY_LABELS
) -> Column:
    """Label of the run's country code, else the first area name, else Unknown."""
    code = blank_to_null(code)
    return F.coalesce(
        lookup(labels, F.lower(code)), F.upper(code), F.get(area, 0), F.lit("Unknown")
    )


def structure_nested(
    raw: DataFrame,
    *,
    collected_at: Column,
    country_code: Column | None = None,
    payload: str | None = None,
    source: str = "adzuna",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Flatten nested API payloads into landed postings."""

    def p(name: str) -> Column:
        return F.col(f"{payload}.{name}" if payload else name)

    code = country_code if country_code is not None else F.lit(None).cast("string")
    return raw.select(
        *keep,
        first_filled(p("id"), p("adref")).alias("id"),
        p("title").alias("title"),
        p("company.display_name").alias("company"),
        p("location.display_name").alias("location"),
        resolve_country(code, p("location.area")).alias("country"),
        p("description").alias("description"),
        infer_category(p("title"), p("description"), p("category.label")).alias("category"),
        p("created").alias("created"),
        p("redirect_url").alias("redirect_url"),
        p("salary_min").alias("salary_min"),
        p("salary_max").alias("salary_max"),
        p("contract_type").alias("contract_type"),
        p("contract_time").alias("contract_time"),
        F.lit(source).alias("source"),
        collected_at.alias("collected_at"),
    )


def structure_flat(
    raw: DataFrame,
    *,
    collected_at: Column,
    payload: str | None = None,
    source: str = "remoteok",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Map flat API payloads onto landed postings, with fallbacks for empty fields."""

    def p(name: str) -> Column:
        return F.col(f"{payload}.{name}" if payload else name)

    return raw.select(
        *keep,
        first_filled(p("id"), p("slug")).alias("id"),
        first_filled(p("position"), p("title")).alias("title"),
        p("company").alias("company"),
        first_filled(p("location"), F.lit("Remote")).alias("location"),
        p("description").alias("description"),
        p("tags").alias("tags"),
        p("url").alias("url"),
        first_filled(p("date"), p("created_at")).alias("created_at"),
        F.lit(source).alias("source"),
        collected_at.alias("collected_at"),
    )


def to_canonical(df: DataFrame) -> DataFrame:
    """Rename, add and cast columns so that every source has the canonical schema."""
    out = []
    for field in CANONICAL:
        names = [n for n in CANONICAL_ALIASES.get(field.name, (field.name,)) if n in df.columns]
        if not names:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            value = F.coalesce(*names)
            if df.schema[names[0]].dataType != field.dataType:
                value = value.try_cast(field.dataType)
            out.append(value.alias(field.name))
    return df.select(*out)


def add_age(df: DataFrame, created: str, as_of, out: str = "job_age_days") -> DataFrame:
    """Age in whole days; 0 when the date is missing or unparseable."""
    return df.withColumn(out, F.coalesce(age_in_days(F.col(created), as_of), F.lit(0)))


def coerce_salaries(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric salaries; anything unparseable or missing becomes 0."""
    return df.withColumns(
        {c: F.coalesce(F.col(c).try_cast("float"), F.lit(0.0).cast("float")) for c in columns}
    )


def fill_defaults(
    df: DataFrame,
    *,
    description: str = "description",
    contract_time: str = "contract_time",
    others: Sequence[str] = ("title", "company", "location_display", "redirect_url"),
) -> DataFrame:
    """Placeholders for missing texts; absent columns are added."""
    values = {
        description: (
            F.coalesce(F.col(description), F.lit("No description available."))
            if description in df.columns
            else F.lit("No description available.")
        )
    }
    if contract_time not in df.columns:
        values[contract_time] = F.lit("N/A")
    for name in others:
        missing = F.lit("Not specified")
        values[name] = F.coalesce(F.col(name), missing) if name in df.columns else missing
    return df.withColumns(values)


def trim_texts(
    df: DataFrame, columns: Sequence[str] = ("title", "company", "description")
) -> DataFrame:
    return df.withColumns({c: strip_space(F.col(c)) for c in columns if c in df.columns})


def embedding_texts(df: DataFrame) -> DataFrame:
    """The four texts to embed; missing parts are left out."""
    title = F.coalesce(F.col("title"), F.lit(""))
    return df.withColumns(
        {
            "text_full": F.coalesce(F.col("description"), F.lit("")),
            "text_title": title,
            "text_title_company": F.concat_ws(" at ", F.col("title"), F.col("company")),
            "text_category_title": F.concat_ws(" ", F.col("category_label"), F.col("title")),
        }
    )


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, dates become text, nulls stay null."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
            c = F.when(~bad, c)
        elif kind.startswith("timestamp") or kind == "date":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def shorten_descriptions(
    df: DataFrame,
    columns: Sequence[str] = ("description", "full_description"),
    max_chars: int = 600,
) -> DataFrame:
    return df.withColumns(
        {c: truncate_text(F.col(c), max_chars) for c in columns if c in df.columns}
    )


def join_chunks(
    df: DataFrame,
    *,
    key: str,
    position: str,
    chunk: str,
    budget: int = 20_000,
    max_chunks: int | None = None,
    separator: str = "\n\n",
    out: str = "text",
) -> DataFrame:
    """Ordered concatenation per key under a character budget.

    Only the first max_chunks chunks count; empty ones are skipped and the last
    one is cut. A non-empty chunk has at least one character, so no more than
    `budget` of them can contribute. That bound is applied before the running
    sum, which keeps a key with very many chunks out of one task.
    """
    rows = df.select(key, position, chunk)
    order = [F.col(position).asc()]
    if max_chunks is not None:
        rows = top_per_group(rows, [key], order, max_chunks)
    rows = rows.filter(F.length(chunk) > 0)
    if max_chunks is None or max_chunks > budget:
        rows = top_per_group(rows, [key], order, budget)
    before = W.partitionBy(key).orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(chunk)).over(before), F.lit(0))
    return (
        rows.withColumn("_used", used)
        .filter(F.col("_used") < budget)
        .withColumn(
            "_piece", F.substring(F.col(chunk), F.lit(1), (F.lit(budget) - F.col("_used")).cast("int"))
        )
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct(position, "_piece"))).alias("_pieces"))
        .select(key, F.array_join(F.col("_pieces._piece"), separator).alias(out))
    )


def recommendation_rows(df: DataFrame, score: str = "score", cluster: str = "cluster_id") -> DataFrame:
    """Output fields of a recommendation, each with its fallback columns."""

    def pick(*names: str) -> Column:
        present = [F.col(n) for n in names if n in df.columns]
        return first_filled(*present) if present else F.lit(None).cast("string")

    passthrough = ("company", "description", "source", "salary_min", "salary_max", "created_date")
    carried = [n for n in ("query_id", "rank") if n in df.columns]
    return df.select(
        *carried,
        pick("job_id", "id").alias("id"),
        pick("title", "position", "job_title").alias("title"),
        pick("location_display", "location").alias("location"),
        pick("location_country", "country").alias("country"),
        pick("category_label", "category").alias("category"),
        pick("redirect_url", "url").alias("url"),
        *[
            (F.col(n) if n in df.columns else F.lit(None).cast("string")).alias(n)
            for n in passthrough
        ],
        F.col(score).cast("double").alias("score"),
        F.col(cluster).cast("int").alias("cluster"),
    )


def query_text(keywords: Column, location: Column, skills: Column) -> Column:
    """"Job: .. | Location: .. | Skills: .." from the parts that are filled."""

    def part(label: str, c: Column) -> Column:
        return F.when(c != "", F.concat(F.lit(label), c))

    return F.concat_ws(
        " | ", part("Job: ", keywords), part("Location: ", location), part("Skills: ", skills)
    )


def drop_metadata_element(df: DataFrame, array_column: str, keep: Sequence[str] = (), out: str = "item") -> DataFrame:
    """One row per array element, without element 0 (API metadata)."""
    return (
        df.select(*keep, F.posexplode(array_column).alias("pos", out)).filter(F.col("pos") > 0)
    )
