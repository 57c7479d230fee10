"""Top-k, paging and first-row selection that survive a hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia.session import materialize

# Spark prunes each map task to k rows per group before the shuffle when a rank filter is at most
# this large (default of spark.sql.optimizer.windowGroupLimitThreshold).
_GROUP_LIMIT_THRESHOLD = "spark.sql.optimizer.windowGroupLimitThreshold"
_SALTS = 64


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str | None = None,
) -> DataFrame:
    """First n rows of every group.

    Small n: a plain rank filter, which Spark turns into a group limit on the
    map side, so a group holding a third of all rows shrinks to n rows per map
    task. Larger n: groups are first cut to n rows per salt and then merged;
    the first n of a group are among the first n of its salts, so nothing is
    lost.
    """
    threshold = int(df.sparkSession.conf.get(_GROUP_LIMIT_THRESHOLD, "1000"))
    position = rank or "_position"
    if n > threshold:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(df)), F.lit(_SALTS)))
        per_salt = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_position", F.row_number().over(per_salt))
            .filter(F.col("_position") <= n)
            .drop("_position", "_salt")
        )
    window = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= n)
    return out if rank else out.drop(position)


def _hashable(df: DataFrame) -> list[str]:
    """Columns to spread rows by: the narrow ones, as hashing long values costs more."""
    wide = ("array", "map", "struct", "variant", "binary")
    names = [name for name, kind in df.dtypes if not kind.startswith(wide)]
    return names or [name for name, kind in df.dtypes if not kind.startswith(("map", "variant"))]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order; null keys form one group."""
    return top_per_group(df, keys, order, 1)


def keep_first_text(df: DataFrame, text: str, order: Sequence[str], identifier: str) -> DataFrame:
    """One row per text, the first in the given order of columns, then by id; null is a text of its own.

    Keys are the text's digest and length, so long values are payload and never compared. The
    table is read once, and as the cut is a rank filter, only the first row of each text that a
    task has seen leaves it. Null ids count as any other, behind the rest of an equal order; of
    rows that agree in order and id one stays.
    """
    keyed = df.withColumns({"_digest": F.unhex(F.sha2(F.col(text).cast("binary"), 256)), "_size": F.octet_length(text)})
    first = [*[F.col(c).asc() for c in order], F.col(identifier).asc_nulls_last()]
    return keep_first(keyed, ["_digest", "_size"], first).drop("_digest", "_size")


def newest_first(df: DataFrame, created: str, tie: str) -> DataFrame:
    """Descending by date, missing dates last; unchanged if the column is absent.

    The tie column is part of the sort key, so the range partitioning can split
    a date that very many rows share.
    """
    if created not in df.columns:
        return df
    return df.orderBy(F.col(created).desc_nulls_last(), F.col(tie).asc())


def with_positions(ordered: DataFrame, out: str = "position") -> DataFrame:
    """Rows of an ordered table with their number from 1.

    The sorted partitions are written; each one's offset is the number of rows before it.
    """
    held = materialize(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered")
    parts = held.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return held.join(offsets, "_part").withColumn(out, F.col("_offset") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_offset")


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page_of(df: DataFrame, order: Sequence[Column], page: int, page_size: int) -> DataFrame:
    """Rows of a 1-based page; empty when the page lies past the end."""
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def page_with_total(
    matched: DataFrame, order: Sequence[Column], columns: Sequence[str], page: int, page_size: int, out: str = "total_results"
) -> DataFrame:
    """Rows of a 1-based page with the number of all matched rows, in one pass over what they are matched from.

    Only `columns` of the matches, which have to hold the order's, are written; page and total are read from those.
    """
    narrow = materialize(matched.select(*columns), "matched")
    return with_total(page_of(narrow, order, page, page_size), narrow, out)


def with_total(page: DataFrame, matched: DataFrame, out: str = "total_results") -> DataFrame:
    """Attach the number of matched rows to every row of a page."""
    total = matched.agg(F.count(F.lit(1)).alias("n")).scalar()
    return page.withColumn(out, total)


def last_entries(df: DataFrame, timestamp: str, n: int, tie: str | None = None) -> DataFrame:
    """The n newest log entries, newest first; equal times by `tie` or by the whole entry."""
    last = F.col(tie) if tie else F.to_json(F.struct(*df.columns))
    return top_n(df, [F.col(timestamp).desc_nulls_last(), last.desc()], n)


def cap_per_run(
    df: DataFrame, run_keys: Sequence[str], order: Sequence[Column], max_rows: int
) -> DataFrame:
    """First max_rows of every run."""
    return top_per_group(df, run_keys, order, max_rows)


def first_items(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)
