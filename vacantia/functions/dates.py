"""Timestamp expressions on wall-clock (zone-free) timestamps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def as_wall_clock(value: Column | dt.datetime | str) -> Column:
    """TIMESTAMP_NTZ from a column, datetime or literal; null when unparseable.

    A zone suffix is dropped, so "10:00Z" and "10:00+05:00" are both 10:00.
    """
    if isinstance(value, Column):
        return value.try_cast("timestamp_ntz")
    return F.lit(str(value)).try_cast("timestamp_ntz")


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (end - start).cast("interval second").cast("decimal(20,6)")


def age_in_days(created: Column, as_of: Column | dt.datetime | str) -> Column:
    """Whole days between creation and as_of, floored (negative for the future)."""
    seconds = elapsed_seconds(as_wall_clock(created), as_wall_clock(as_of))
    return F.floor(seconds / F.lit(86400)).cast("int")


def days_before(as_of: Column | dt.datetime | str, days: int) -> Column:
    return as_wall_clock(as_of) - F.make_dt_interval(F.lit(days))


def minute_label(ts: Column) -> Column:
    """yyyy-MM-dd HH:mm; "N/A" for a missing text, null for an unparseable one."""
    text = ts.cast("string")
    return F.when(text.isNull() | (text == ""), F.lit("N/A")).otherwise(
        F.date_format(as_wall_clock(ts), "yyyy-MM-dd HH:mm")
    )


def stamp(ts: Column) -> Column:
    return F.date_format(as_wall_clock(ts), "yyyyMMdd_HHmmss")


def interval_ms(spark: SparkSession, text: str) -> int:
    """Milliseconds of an interval such as "2 days" or "90 minutes"."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return spark.range(1).select(F.unix_millis(zero + F.expr(f"INTERVAL {text}")) - F.unix_millis(zero)).first()[0]
