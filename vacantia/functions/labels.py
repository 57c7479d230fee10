"""Number, duration and status labels for reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.text import title_case


def lookup(mapping: Mapping[str, str], key: Column) -> Column:
    """Value of a small fixed mapping, null for an unknown key."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def fixed(c: Column, decimals: int) -> Column:
    """Decimal text without grouping, half-even on the exact binary value."""
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", c, F.lit(pattern))


def thousands(c: Column) -> Column:
    return F.coalesce(F.format_number(c.cast("bigint"), 0), F.lit("-"))


def decimal_label(c: Column, decimals: int = 1) -> Column:
    return F.coalesce(fixed(c.cast("double"), decimals), F.lit("-"))


def percent_label(c: Column) -> Column:
    return F.coalesce(F.concat(fixed(c.cast("double") * 100, 1), F.lit("%")), F.lit("-"))


def duration_label(seconds: Column) -> Column:
    """"0s", "42s" or "3m 05s"; seconds are rounded half-even first."""
    whole = F.bround(seconds, 0).cast("bigint")
    return (
        F.when(F.coalesce(seconds, F.lit(0)) == 0, F.lit("0s"))
        .when(whole < 60, F.format_string("%ds", whole))
        .otherwise(F.format_string("%dm %02ds", F.floor(whole / 60), whole % 60))
    )


def millis_label(ms: Column) -> Column:
    """"0ms", "850ms" or "1.23s"."""
    filled = F.coalesce(ms, F.lit(0.0))
    return (
        F.when((filled == 0) | F.isnan(filled), F.lit("0ms"))
        .when(filled < 1000, F.format_string("%dms", filled.cast("bigint")))
        .otherwise(F.concat(fixed(filled / 1000, 2), F.lit("s")))
    )


def status_label(status: Column, mapping: Mapping[str, str]) -> Column:
    upper = F.upper(F.coalesce(status, F.lit("")))
    return F.when(upper == "", F.lit("Unknown")).otherwise(
        F.coalesce(lookup(mapping, upper), title_case(upper))
    )


def half_even_percent(ratio: Column) -> Column:
    return F.bround(ratio * 100, 0).cast("int")
