"""Profiling: value counts, missingness, exact quantiles, histograms, densities."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantia.session import materialize
from vacantia.functions import dictionaries as D
from vacantia.functions.dates import age_in_days
from vacantia.functions.text import strip_space


def value_counts(
    df: DataFrame, column: str | Column, n: int | None = None, missing: str = "Unknown"
) -> DataFrame:
    """(value, n), most frequent first, ties by value."""
    c = F.col(column) if isinstance(column, str) else column
    counts = df.groupBy(F.coalesce(c.cast("string"), F.lit(missing)).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ordered = counts.orderBy(F.desc("n"), F.asc("value"))
    return ordered.limit(n) if n is not None else ordered


def cleaned_counts(
    df: DataFrame,
    column: str,
    missing: tuple[Sequence[str], str],
    n: int | None = None,
    keep_null_label: str | None = None,
) -> DataFrame:
    """value_counts over trimmed values, with texts for "missing" merged into one label."""
    texts, label = missing
    value = strip_space(F.col(column).cast("string"))
    value = F.when(value.isin(*texts), F.lit(label)).otherwise(value)
    return value_counts(df, value, n, missing=keep_null_label or label)


def country_counts(df: DataFrame, column: str, n: int = 12) -> DataFrame:
    return cleaned_counts(df, column, D.MISSING_COUNTRY, n)


def source_counts(df: DataFrame, column: str = "source") -> DataFrame:
    """All sources; a null source is counted under "None", an empty one under "Unknown"."""
    return cleaned_counts(df, column, D.MISSING_SOURCE, keep_null_label="None")


def category_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return cleaned_counts(df, column, D.MISSING_CATEGORY, n)


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, missing, missing_pct) for columns with nulls, in one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    return (
        counts.unpivot("_rows", columns, "column_name", "missing")
        .filter(F.col("missing") > 0)
        .select(
            "column_name",
            "missing",
            F.bround(F.col("missing") / F.col("_rows") * 100, 2).alias("missing_pct"),
        )
        .orderBy(F.desc("missing"), "column_name")
    )


def shape(df: DataFrame) -> DataFrame:
    """Row and column counts and the number of columns per type."""
    kinds: dict[str, int] = {}
    for _, kind in df.dtypes:
        kinds[kind] = kinds.get(kind, 0) + 1
    entries = [F.lit(x) for pair in sorted(kinds.items()) for x in pair]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.create_map(*entries).alias("column_types"),
    )


def exact_quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    bins: int = 16_384,
    few: int = 100_000,
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row (probability, quantile) each.

    percentile() keeps every distinct value in one aggregation buffer. Here the
    value range is split into equal bins and only bin counts are aggregated; the
    bins that hold the wanted ranks are split again until they hold a `few`
    values or a single distinct one. State is bounded by `bins` per wanted rank.
    Every level is one column-pruned scan whose range filter reaches the files.

    Nulls and NaN are left out. Infinities are counted apart, so only finite
    values are split, and returned where their ranks fall.
    """
    v = F.col("_v")
    values = df.select(F.col(column).cast("double").alias("_v")).filter(v.isNotNull() & ~F.isnan(v))
    finite = F.abs(v) < F.lit(float("inf"))
    low, high, n, n_low, n_finite = values.agg(
        F.min(F.when(finite, v)), F.max(F.when(finite, v)), F.count(v), F.count_if(v == float("-inf")), F.count_if(finite)
    ).first()
    # Zero-based ranks on both sides of the interpolation, and its weight.
    places = [((n - 1) * float(p), float(p)) for p in probabilities] if n else []
    spots = [(p, math.floor(at), math.ceil(at), at - math.floor(at)) for at, p in places]
    all_ranks = sorted({rank for _, below, above, _ in spots for rank in (below, above)})
    if not n:
        return values.select(F.lit(0.0).alias("probability"), v.alias("quantile")).filter(F.lit(False))
    ranks = [r - n_low for r in all_ranks if n_low <= r < n_low + n_finite]
    values = values.filter(finite)
    cells, held = [(low, high, 0)] if ranks else [], n_finite
    while held > few and any(lo < hi for lo, hi, _ in cells):
        split, left = _narrow(values, cells, ranks, bins)
        if split == cells:
            break
        cells, held = split, left

    number, before = _cell_of(v, cells), F.lit(0).cast("bigint")
    for i, (_, _, start) in enumerate(cells):
        before = F.when(F.col("_cell") == i, F.lit(start).cast("bigint")).otherwise(before)
    runs = (
        values.filter(_within(v, cells) if cells else F.lit(False))
        .groupBy(number.alias("_cell"), "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = W.partitionBy("_cell").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    runs = runs.withColumn("_end", before + F.sum("_c").over(upto))

    def value_at(rank: int) -> Column:
        covers = (F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank)
        return F.max(F.when(covers, v))

    found = runs.agg(F.count(F.lit(1)).alias("_runs"), *[value_at(rank).alias(f"r{i}") for i, rank in enumerate(ranks)])
    index = {rank + n_low: F.col(f"r{i}") for i, rank in enumerate(ranks)}
    for rank in all_ranks:
        index.setdefault(rank, F.lit(float("-inf") if rank < n_low else float("inf")))
    rows = [
        F.struct(
            F.lit(p).alias("probability"),
            (
                index[below]
                if weight == 0 or below == above
                else F.when(index[below] == index[above], index[below]).otherwise(
                    index[below] + (index[above] - index[below]) * F.lit(weight)
                )
            ).alias("quantile"),
        )
        for p, below, above, weight in spots
    ]
    return found.select(F.inline(F.array(*rows)))


def _within(v: Column, cells: Sequence[tuple[float, float, int]]) -> Column:
    return reduce(lambda a, b: a | b, [(v >= lo) & (v <= hi) for lo, hi, _ in cells])


def _cell_of(v: Column, cells: Sequence[tuple[float, float, int]]) -> Column:
    """Number of the cell a value lies in; cells do not overlap."""
    number = F.lit(0)
    for i, (lo, hi, _) in enumerate(cells):
        number = F.when((v >= lo) & (v <= hi), F.lit(i)).otherwise(number)
    return number


def _narrow(
    values: DataFrame, cells: Sequence[tuple[float, float, int]], ranks: Sequence[int], bins: int
) -> tuple[list[tuple[float, float, int]], int]:
    """Split every cell (low, high, rows below) into bins and keep those that hold a rank.

    Returns at most two bins per probability, and the number of values in them.
    """
    v = F.col("_v")
    slot, start = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for i, (lo, hi, below) in enumerate(cells):
        width = hi / bins - lo / bins
        if width > 0:
            place = F.greatest(F.lit(0), F.least(F.floor(v / F.lit(width) - F.lit(lo / width)), F.lit(bins - 1)))
            slot = F.when((v >= lo) & (v <= hi), place).otherwise(slot)
        start = F.when(F.col("_cell") == i, F.lit(below).cast("bigint")).otherwise(start)
    counts = (
        values.filter(_within(v, cells))
        .groupBy(_cell_of(v, cells).alias("_cell"), slot.alias("_slot"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    )
    earlier = W.partitionBy("_cell").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_start", start + F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    first, end = F.col("_start"), F.col("_start") + F.col("_c")
    holds = reduce(lambda a, b: a | b, [(first <= rank) & (end > rank) for rank in ranks])
    kept = counts.filter(holds).select("_lo", "_hi", "_start", "_c").collect()
    return [(row[0], row[1], row[2]) for row in kept], sum(row[3] for row in kept)


def age_histogram(
    df: DataFrame, created: str, as_of, *, upper: int = 120, bins: int = 30
) -> DataFrame:
    """(bin, from_day, to_day, n) of posting ages clipped to [0, upper], and the median.

    Ages are integers in a known range, so everything after the first
    aggregation works on at most upper + 1 rows.
    """
    age = age_in_days(F.col(created), as_of)
    clipped = F.greatest(F.lit(0), F.least(F.lit(upper), age))
    ages = (
        df.select(F.when(age.isNotNull(), clipped).alias("age"))
        .filter(F.col("age").isNotNull())
        .groupBy("age")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    span = ages.agg(
        F.struct(
            F.min("age").alias("lo"),
            F.max("age").alias("hi"),
            F.percentile("age", F.lit(0.5), F.col("c")).cast("int").alias("median"),
        ).alias("s")
    ).scalar()
    placed = ages.withColumn("_s", span)
    width = F.col("_s.hi") - F.col("_s.lo")
    slot = F.when(
        width > 0,
        F.least(F.floor((F.col("age") - F.col("_s.lo")) * F.lit(bins) / width), F.lit(bins - 1)),
    ).otherwise(F.lit(0))
    return (
        placed.withColumn("bin", slot.cast("int"))
        .groupBy("bin", "_s")
        .agg(F.sum("c").alias("n"))
        .select(
            "bin",
            (F.col("_s.lo") + F.col("bin") * width / bins).alias("from_day"),
            (F.col("_s.lo") + (F.col("bin") + 1) * width / bins).alias("to_day"),
            "n",
            F.col("_s.median").alias("median_age"),
        )
    )


def salary_bounds(
    df: DataFrame, columns: Sequence[str], low: float = 0.02, high: float = 0.98
) -> DataFrame:
    """One row (q_low, q_high) over all values of the columns together."""
    stacked = df.select(F.explode(F.array(*[F.col(c).try_cast("double") for c in columns])).alias("v"))
    q = exact_quantiles(stacked, "v", (low, high))
    return q.agg(
        F.max(F.when(F.col("probability") == low, F.col("quantile"))).alias("q_low"),
        F.max(F.when(F.col("probability") == high, F.col("quantile"))).alias("q_high"),
    )


def trim_salaries(
    df: DataFrame, columns: Sequence[str], low: float = 0.02, high: float = 0.98
) -> DataFrame:
    """(measure, value): every column clipped to the common quantile bounds, nulls dropped."""
    q_low, q_high = salary_bounds(df, columns, low, high).first()
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("measure"), F.col(c).try_cast("double").alias("v"))
                    for c in columns
                ]
            )
        ).alias("e")
    ).select("e.measure", "e.v")
    clipped = F.greatest(F.lit(q_low), F.least(F.lit(q_high), F.col("v")))
    return long.filter(F.col("v").isNotNull()).select("measure", clipped.alias("value"))


def density(trimmed: DataFrame, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per measure on an even grid, Scott's bandwidth.

    Equal values are counted first and written once. Each task then adds up the kernels of its
    distinct values on the grid of their measure and ships one array of `points` sums per measure.
    The variance is summed around the mean, so values far from zero lose no digits. A measure
    without spread (one value, or equal ones) has no bandwidth: its points all lie on that value
    and its density is null. Values that are null or not finite are left out.
    """
    v, w = F.col("value"), F.col("w")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    counted = trimmed.filter(finite).groupBy("measure", "value").agg(F.count(F.lit(1)).cast("double").alias("w"))
    weights = materialize(counted, "weights")
    # One row per measure; a value near the mean keeps the sum of differences small.
    middle = weights.groupBy("measure").agg(
        F.sum("w").alias("n"), (F.sum(w * v) / F.sum("w")).alias("middle"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    centred = v - F.col("middle")
    spread = weights.join(F.broadcast(middle), "measure").groupBy("measure", "n", "lo", "hi").agg(
        F.sum(w * centred * centred).alias("squares"), F.sum(w * centred).alias("rest")
    )
    variance = (F.col("squares") - F.col("rest") * F.col("rest") / F.col("n")) / (F.col("n") - 1)
    flat = (F.col("hi") <= F.col("lo")) | (F.col("n") <= 1)
    stats = spread.select("measure", "n", "lo", "hi", F.when(flat, 0.0).otherwise(F.sqrt(variance)).alias("sd"))
    bandwidth = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    grid = stats.select(
        "measure",
        "n",
        bandwidth.alias("h"),
        (F.col("lo") - cut * bandwidth).alias("g0"),
        ((F.col("hi") - F.col("lo") + 2 * cut * bandwidth) / (points - 1)).alias("step"),
    )
    # One row per measure: the number of measures is fixed by the caller's column list.
    spread = weights.join(F.broadcast(grid), "measure")

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple] = {}
        for batch in batches:
            rows = batch.to_pandas()
            for measure, part in rows.groupby("measure"):
                n, h, g0, step = part[["n", "h", "g0", "step"]].iloc[0]
                x, got = g0 + step * np.arange(points), sums.setdefault(measure, (np.zeros(points), n, h, g0, step))[0]
                for at in range(0, len(part) if h > 0 else 0, 4_096):
                    piece = part.iloc[at : at + 4_096]
                    z = (x[None, :] - piece["value"].to_numpy()[:, None]) / h
                    got += piece["w"].to_numpy() @ np.exp(-0.5 * z * z)
        for measure, (got, n, h, g0, step) in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"measure": [measure] * points, "point": pa.array(range(points), pa.int32()), "x": g0 + step * np.arange(points), "n": [n] * points, "h": [h] * points, "k": got}
            )

    summed = spread.mapInArrow(kernels, "measure string, point int, x double, n double, h double, k double")
    k = F.try_divide(F.sum("k"), F.first("n") * F.first("h") * F.sqrt(F.lit(2.0) * F.pi()))
    return summed.groupBy("measure", "point").agg(F.first("x").alias("x"), k.alias("density"))


def cluster_sizes(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, n, pct) by cluster id."""
    counts = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter(F.col("cluster").isNotNull())
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.select(
        "cluster", "n", F.bround(100 * F.col("n") / total, 1).alias("pct")
    ).orderBy("cluster")


def distinct_clusters(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return df.agg(F.count_distinct(cluster).alias("n_clusters"))


def profile_totals(runs: DataFrame, profile: str = "profile", jobs: str = "jobs_collected") -> DataFrame:
    """Jobs per profile and a grand-total row named TOTAL."""
    return (
        runs.rollup(profile)
        .agg(F.sum(jobs).alias("jobs"), F.grouping(profile).alias("is_total"))
        .select(
            F.when(F.col("is_total") == 1, F.lit("TOTAL")).otherwise(F.col(profile)).alias("profile"),
            "jobs",
        )
    )


def overview(df: DataFrame, source: str, country: str, clustered: DataFrame, cluster: str) -> DataFrame:
    """Rows (kind, value, n): rows, columns, every source, top-3 countries, number of clusters."""
    top3 = value_counts(df, country, 3, missing="Other / Unknown")
    sources = value_counts(df.filter(F.col(source).isNotNull()), source)
    none = F.lit(None).cast("string").alias("value")
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("kind"), none, "n"),
        distinct_clusters(clustered, cluster).toDF("n").select(F.lit("clusters").alias("kind"), none, "n"),
        df.sparkSession.range(1).select(F.lit("columns").alias("kind"), none, F.lit(len(df.columns)).cast("bigint").alias("n")),
        sources.select(F.lit("source").alias("kind"), "value", "n"),
        top3.select(F.lit("country").alias("kind"), "value", "n"),
    ]
    return reduce(DataFrame.unionAll, parts)
