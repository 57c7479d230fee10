"""Filters, deduplication counters and unions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dictionaries as D
from vacantia.functions.dates import as_wall_clock, days_before
from vacantia.functions.text import ignoring_case


def has_any_tag(tags: Column, wanted: Sequence[str] = D.DEFAULT_TAGS) -> Column:
    """True when a tag is among the wanted ones (any case); no wanted tags keep all rows."""
    wanted = sorted({t.lower() for t in wanted})
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.exists(tags, lambda t: F.lower(t).isin(*wanted)), F.lit(False))


def filter_tags(df: DataFrame, tags: str = "tags", wanted: Sequence[str] = D.DEFAULT_TAGS) -> DataFrame:
    return df.filter(has_any_tag(F.col(tags), wanted))


def filter_recent(df: DataFrame, created: str, as_of, max_days_old: int | None) -> DataFrame:
    """Drop rows older than max_days_old; missing or unparseable dates stay."""
    if max_days_old is None:
        return df
    if dict(df.dtypes)[created].startswith("timestamp"):
        # A bare column comparison reaches the Parquet scan as a pushed filter.
        limit = days_before(as_of, max_days_old).cast(dict(df.dtypes)[created])
        return df.filter(F.col(created).isNull() | (F.col(created) >= limit))
    ts = as_wall_clock(F.col(created))
    return df.filter(ts.isNull() | (ts >= days_before(as_of, max_days_old)))


def filter_complete(df: DataFrame, columns: Sequence[str] = ("title", "description")) -> DataFrame:
    """Drop rows with a null in any of the columns; empty strings stay."""
    return df.na.drop(subset=list(columns))


def filter_identified(df: DataFrame, identifier: str = "id") -> DataFrame:
    return df.filter(F.col(identifier).isNotNull() & (F.col(identifier).cast("string") != ""))


def filter_asked(queries: DataFrame, text: str) -> DataFrame:
    """Keep queries with something in them; a blank query returns nothing, not everything."""
    return queries.filter(F.col(text).rlike(r"(?U)[^\s\x1C-\x1F]"))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def keyword_search(
    df: DataFrame,
    *,
    query: str = "",
    location: str = "",
    skills: str = "",
    title: str = "title",
    description: str = "description",
    place: str = "location_display",
    literal: bool = False,
) -> DataFrame:
    """Postings that match all given terms.

    Terms are case-insensitive regular expressions, or plain texts with
    literal=True. `skills` is a comma-separated list that must all match.
    """

    def found(column: str, term: str) -> Column:
        pattern = ignoring_case(re.escape(term) if literal else term)
        return F.coalesce(F.col(column).rlike(pattern), F.lit(False))

    conditions = []
    if query:
        conditions.append(found(title, query) | found(description, query))
    if location:
        conditions.append(found(place, location))
    wanted = [s.strip() for s in skills.split(",")]
    conditions += [found(description, s) for s in wanted if s]
    return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df


def removal_counts(raw: DataFrame, deduplicated: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows in, duplicates removed, and kept rows dropped for a missing required field."""
    incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    rows_in = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = deduplicated.agg(
        F.count(F.lit(1)).alias("rows_kept"), F.count_if(incomplete).alias("missing_removed")
    )
    return kept.select(
        rows_in.alias("rows_in"),
        (rows_in - F.col("rows_kept")).alias("duplicates_removed"),
        "missing_removed",
        (F.col("rows_kept") - F.col("missing_removed")).alias("rows_out"),
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """Union by name; a column one source lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def stack_columns(df: DataFrame, columns: Sequence[str], out: str = "value") -> DataFrame:
    """All values of several columns in one column, in a single pass."""
    return df.select(F.explode(F.array(*columns)).alias(out))
