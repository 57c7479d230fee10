"""Plans and results under skew: hot keys, bounded windows, pushed filters."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.operators import oplogs, profile, ranking, rows, selection
from vacantia.plans.catalog import QUERIES
from vacantia.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    # One key holds about a third of the rows.
    return spark.range(30_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 997).alias("k"), (F.hash("id") % 1000).alias("v")
    )


def test_hot_group_is_cut_before_the_shuffle(skewed):
    out = ranking.top_per_group(skewed, ["k"], [F.desc("v"), F.asc("id")], 3)
    text = plan(out)
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("hashpartitioning") < text.index("Partial")


@pytest.mark.parametrize("n", [1, 7, 5_000])
def test_top_per_group_is_exact(skewed, n):
    out = ranking.top_per_group(skewed, ["k"], [F.desc("v"), F.asc("id")], n, rank="r")
    got = sorted((r["k"], r["r"], r["id"]) for r in out.collect())
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r["k"], []).append((-r["v"], r["id"]))
    expected = sorted((k, i + 1, row[1]) for k, g in groups.items() for i, row in enumerate(sorted(g)[:n]))
    assert got == expected


def test_large_n_is_salted(skewed):
    text = plan(ranking.top_per_group(skewed, ["k"], [F.asc("id")], 5_000))
    assert "_salt" in text


@pytest.mark.parametrize("bins, few", [(64, 30), (16_384, 0), (64, 100_000)])
def test_quantiles(spark, bins, few):
    random.seed(3)
    cases = {
        "uniform": [random.random() for _ in range(1_001)],
        "heavy": [10 ** random.uniform(-6, 9) for _ in range(1_000)],
        "one value": [5.0] * 50,
        "ties": [float(random.randrange(4)) for _ in range(999)] + [7.0] * 500,
        "negative": [-random.random() * 1e6 for _ in range(77)],
        "single": [3.5],
    }
    probabilities = (0.0, 0.02, 0.5, 0.9, 0.98, 1.0)
    for name, xs in cases.items():
        df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double")
        got = {r["probability"]: r["quantile"] for r in profile.exact_quantiles(df, "x", probabilities, bins, few).collect()}
        for p in probabilities:
            assert got[p] == pytest.approx(np.quantile(xs, p), rel=1e-9, abs=1e-9), (name, p)


def test_chunks_of_a_hot_key(spark):
    df = spark.range(50_000).select(F.lit("hot").alias("key"), F.col("id").alias("pos"), F.lit("ab").alias("chunk"))
    out = rows.join_chunks(df, key="key", position="pos", chunk="chunk", budget=3_000, separator="")
    assert out.first()["text"] == "ab" * 1_500


def test_latest_state_of_a_hot_key(skewed):
    out = oplogs.latest_state(skewed, "k", "id", ["v"])
    assert out.filter("k = -1").first()["id"] == 29_997
    text = plan(out)
    assert text.count("max_by") >= 2 and "partial_max_by" in text


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(QUERIES["filter_recent_dates"](spark, folder))
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_custkey" not in text
    narrow = plan(QUERIES["top_sources"](spark, folder))
    assert "ReadSchema: struct<source:string>" in narrow


def test_no_cartesian_joins(spark, folder):
    for name in ("recommend_in_cluster", "collect_pages", "keyword_search_page", "exact_quantiles", "salary_density", "weighted_views"):
        text = plan(QUERIES[name](spark, folder))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_counts_after_deduplication(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", None, 3), (None, "x", 4), (None, "y", 5)], "k string, t string, p int")
    kept = ranking.keep_first(df, ["k"], [F.asc("p")])
    row = selection.removal_counts(df, kept, ["t"]).first()
    assert row.asDict() == {"rows_in": 5, "duplicates_removed": 2, "missing_removed": 1, "rows_out": 2}


def test_age_histogram_edges(spark):
    df = spark.createDataFrame([("2025-01-10",), ("2020-01-01",), ("2026-01-01",), (None,), ("x",)], "c string")
    out = profile.age_histogram(df, "c", "2025-01-11 00:00:00").collect()
    assert sum(r["n"] for r in out) == 3 and {r["median_age"] for r in out} == {1}
    assert {r["bin"] for r in out} == {0, 29}


def test_empty_inputs(spark, folder):
    empty = table(spark, folder, "events").filter("false")
    stats = oplogs.search_stats(empty, kind="event_type", duration="value", status="event_type").first()
    assert stats["total_searches"] == 0 and stats["error_rate"] == 0 and stats["avg_duration"] is None
    labels = oplogs.search_stats_labels(oplogs.search_stats(empty, kind="event_type", duration="value", status="event_type")).first()
    assert labels["avg_duration"] == "0ms" and labels["error_rate"] == "0.0%" and labels["total_searches"] == "0"
    assert profile.exact_quantiles(empty, "value", (0.5,)).count() == 0
    assert oplogs.last_entries(empty, "ts", 6).count() == 0


@pytest.mark.parametrize("few", [500, 100_000])
def test_quantiles_with_infinities(spark, few):
    import duckdb

    inf, tail = float("inf"), [1e308, -1e308, 5e-324, 0.0]
    values = [float(i * i % 997) for i in range(3_000)] + [inf] * 7 + [-inf] * 3 + tail
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    wanted = [0.0, 0.0005, 0.25, 0.5, 0.99, 0.999, 1.0]
    got = {r["probability"]: r["quantile"] for r in profile.exact_quantiles(df, "v", wanted, bins=256, few=few).collect()}
    frame = duckdb.from_arrow(df.where("v IS NOT NULL AND NOT isnan(v)").toArrow())
    expected = duckdb.sql(f"SELECT quantile_cont(v, {wanted}) FROM frame").fetchall()[0][0]
    assert [got[p] for p in wanted] == pytest.approx(expected, nan_ok=True)
    assert [r["quantile"] for r in profile.exact_quantiles(df.where("v > 1e308"), "v", [0.5]).collect()] == [inf]
