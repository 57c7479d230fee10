"""Queries that profile the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.operators import oplogs, profile, ranking
from vacantia.plans.registry import Tables, query
from vacantia.session import materialize


def _counts_sql(value: str, table: str, n: int | None = None) -> str:
    limit = f" LIMIT {n}" if n else ""
    return f"SELECT {value} AS value, count(*) AS n FROM {table} GROUP BY 1 ORDER BY n DESC, value{limit}"


def _merged(column: str, texts: tuple[str, ...], label: str, null_label: str | None = None) -> str:
    listed = ", ".join(f"'{t}'" for t in texts)
    return (
        f"coalesce(CASE WHEN trim({column}) IN ({listed}) THEN '{label}' ELSE trim({column}) END,"
        f" '{null_label or label}')"
    )


@query(_counts_sql("coalesce(nullif(source, 'src3'), 'Unknown')", "documents", 5))
def top_sources(t: Tables) -> DataFrame:
    return profile.value_counts(t.documents, F.nullif("source", F.lit("src3")), 5)


@query(_counts_sql("coalesce(p_type, 'Unknown')", "part", 5))
def top_categories(t: Tables) -> DataFrame:
    return profile.value_counts(t.part, "p_type", 5)


COUNTRY_SQL = (
    "CASE lang WHEN 'fr' THEN NULL WHEN 'de' THEN 'nan' WHEN 'es' THEN ' Unknown ' ELSE source END"
)


def _messy_country() -> Column:
    lang = F.col("lang")
    return (
        F.when(lang == "fr", F.lit(None))
        .when(lang == "de", "nan")
        .when(lang == "es", " Unknown ")
        .otherwise(F.col("source"))
    )


@query(
    _counts_sql(
        _merged("c", ("nan", "None", "Unknown", ""), "Other Countries"),
        f"(SELECT {COUNTRY_SQL} AS c FROM documents)",
        12,
    )
)
def country_counts(t: Tables) -> DataFrame:
    return profile.country_counts(t.documents.select(_messy_country().alias("c")), "c")


@query(
    _counts_sql(
        _merged("c", ("nan", ""), "Unknown", "None"), f"(SELECT {COUNTRY_SQL} AS c FROM documents)"
    )
)
def source_counts(t: Tables) -> DataFrame:
    return profile.source_counts(t.documents.select(_messy_country().alias("c")), "c")


@query(
    _counts_sql(
        _merged("c", ("nan", "None", "Unknown", ""), "Other sector jobs"),
        f"(SELECT {COUNTRY_SQL} AS c FROM documents)",
        10,
    )
)
def category_counts(t: Tables) -> DataFrame:
    return profile.category_counts(t.documents.select(_messy_country().alias("c")), "c")


@query(
    """WITH m AS (SELECT count(*) AS n, count(*) FILTER (lang = 'fr') AS lang, count(*) FILTER (source = 'src3')
      AS source, count(*) FILTER (text IS NULL) AS text FROM documents),
    l AS (SELECT 'lang' AS column_name, lang AS missing, n FROM m UNION ALL SELECT 'source', source, n FROM m
      UNION ALL SELECT 'text', text, n FROM m)
    SELECT column_name, missing, round(missing * 100.0 / n, 2)::DOUBLE AS missing_pct FROM l WHERE missing > 0"""
)
def missing_profile(t: Tables) -> DataFrame:
    d = t.documents.select(
        "text", F.nullif("lang", F.lit("fr")).alias("lang"), F.nullif("source", F.lit("src3")).alias("source")
    )
    return profile.missing_profile(d)


@query(
    "SELECT count(*) AS n_rows, 6 AS n_columns, 'bigint=2 double=1 string=2 timestamp_ntz=1' AS column_types FROM events"
)
def frame_shape(t: Tables) -> DataFrame:
    out = profile.shape(t.events)
    kinds = F.array_sort(F.map_entries("column_types"))
    text = F.array_join(F.transform(kinds, lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), " ")
    return out.withColumn("column_types", text)


@query(
    """WITH a AS (SELECT least(120, greatest(0, CAST(floor((epoch_us(TIMESTAMP '2000-03-01 12:00:00')
        - epoch_us(o_orderdate)) / 86400000000.0) AS INTEGER))) AS age FROM orders WHERE o_orderdate IS NOT NULL),
    s AS (SELECT min(age) AS lo, max(age) AS hi, CAST(floor(median(age)) AS INTEGER) AS median_age FROM a),
    b AS (SELECT CAST(least(29, (age - lo) * 30 // (hi - lo)) AS INTEGER) AS bin, lo, hi, median_age FROM a, s)
    SELECT bin, (lo + bin * (hi - lo) / 30.0)::DOUBLE AS from_day, (lo + (bin + 1) * (hi - lo) / 30.0)::DOUBLE AS to_day,
        count(*) AS n, median_age FROM b GROUP BY ALL"""
)
def age_histogram(t: Tables) -> DataFrame:
    return profile.age_histogram(t.orders, "o_orderdate", "2000-03-01 12:00:00")


@query(
    "SELECT p AS probability, round(CASE p WHEN 0.02 THEN a WHEN 0.25 THEN b WHEN 0.5 THEN c WHEN 0.75 THEN d ELSE e END, 4)"
    " AS quantile FROM (SELECT quantile_cont(l_extendedprice, 0.02) AS a, quantile_cont(l_extendedprice, 0.25) AS b,"
    " quantile_cont(l_extendedprice, 0.5) AS c, quantile_cont(l_extendedprice, 0.75) AS d,"
    " quantile_cont(l_extendedprice, 0.98) AS e FROM lineitem), (SELECT unnest([0.02, 0.25, 0.5, 0.75, 0.98])::DOUBLE AS p)"
)
def exact_quantiles(t: Tables) -> DataFrame:
    q = profile.exact_quantiles(t.lineitem, "l_extendedprice", (0.02, 0.25, 0.5, 0.75, 0.98))
    return q.withColumn("quantile", F.round("quantile", 4))


STACKED_SQL = (
    "SELECT l_extendedprice AS v FROM lineitem UNION ALL SELECT l_extendedprice * (1 + l_tax) FROM lineitem"
)
TRIMMED_SQL = f"""
  bounds AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM ({STACKED_SQL})),
  trimmed AS (SELECT 'salary_min' AS measure, least(hi, greatest(lo, l_extendedprice)) AS value FROM lineitem, bounds
    UNION ALL SELECT 'salary_max', least(hi, greatest(lo, l_extendedprice * (1 + l_tax))) FROM lineitem, bounds)"""


def _salaries(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_extendedprice").alias("salary_min"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("salary_max"),
    )


@query(
    f"WITH {TRIMMED_SQL} SELECT measure, count(*) AS n, round(min(value), 4) AS lowest, round(max(value), 4) AS highest,"
    " round(avg(value), 4) AS mean FROM trimmed GROUP BY measure"
)
def trimmed_salaries(t: Tables) -> DataFrame:
    trimmed = profile.trim_salaries(_salaries(t), ["salary_min", "salary_max"])
    return trimmed.groupBy("measure").agg(
        F.count("value").alias("n"),
        F.round(F.min("value"), 4).alias("lowest"),
        F.round(F.max("value"), 4).alias("highest"),
        F.round(F.avg("value"), 4).alias("mean"),
    )


@query(
    f"""WITH {TRIMMED_SQL},
    s AS (SELECT measure, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo, max(value) AS hi
          FROM trimmed GROUP BY measure),
    g AS (SELECT s.*, p.point, lo - 3 * h + p.point * ((hi - lo + 6 * h) / 49) AS x
          FROM s, (SELECT unnest(range(0, 50)) AS point) p)
    SELECT g.measure, g.point::INTEGER AS point, round(g.x, 2) AS x,
      round(sum(exp(-0.5 * pow((g.x - t.value) / g.h, 2))) / (any_value(g.n) * any_value(g.h) * sqrt(2 * pi())) * 1e6, 6)
        AS density_e6
    FROM g JOIN trimmed t ON g.measure = t.measure GROUP BY g.measure, g.point, g.x"""
)
def salary_density(t: Tables) -> DataFrame:
    trimmed = profile.trim_salaries(_salaries(t), ["salary_min", "salary_max"])
    d = profile.density(trimmed, points=50)
    return d.select(
        "measure", "point", F.round("x", 2).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density_e6")
    )


@query(
    "SELECT label AS cluster, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct"
    " FROM embeddings GROUP BY label"
)
def cluster_sizes(t: Tables) -> DataFrame:
    return profile.cluster_sizes(t.embeddings, "label")


@query("SELECT count(DISTINCT label) AS n_clusters FROM embeddings")
def distinct_clusters(t: Tables) -> DataFrame:
    return profile.distinct_clusters(t.embeddings, "label")


@query(
    "SELECT coalesce(event_type, 'TOTAL') AS profile, sum(event_id)::BIGINT AS jobs FROM events GROUP BY ROLLUP (event_type)"
)
def profile_totals(t: Tables) -> DataFrame:
    return profile.profile_totals(t.events, "event_type", "event_id")


@query(
    """WITH s AS (SELECT source AS v, count(*) AS n FROM documents GROUP BY 1),
    c AS (SELECT coalesce(nullif(lang, 'es'), 'Other / Unknown') AS v, count(*) AS n FROM documents GROUP BY 1
          ORDER BY n DESC, v LIMIT 3)
    SELECT 'rows' AS kind, NULL AS value, count(*) AS n FROM documents UNION ALL SELECT 'columns', NULL, 2
    UNION ALL SELECT 'clusters', NULL, count(DISTINCT label) FROM embeddings
    UNION ALL SELECT 'source', v, n FROM s UNION ALL SELECT 'country', v, n FROM c"""
)
def overview(t: Tables) -> DataFrame:
    d = t.documents.select("source", F.nullif("lang", F.lit("es")).alias("country"))
    return profile.overview(d, "source", "country", t.embeddings, "label")


@query(
    "SELECT '2025-12-03T00:41:35' AS timestamp, 'success' AS status, (SELECT count(*) FROM documents)"
    " + (SELECT count(*) FROM pages) AS records_read, (SELECT count(DISTINCT text) FROM documents)"
    " + (SELECT count(*) FROM pages) AS records_in, (SELECT count(DISTINCT text) FROM documents) AS records_a,"
    " (SELECT count(*) FROM pages) AS records_b, (SELECT count(DISTINCT text) FROM documents) AS records_out,"
    " 'out/jobs' AS output_path"
)
def consolidation_stats(t: Tables) -> DataFrame:
    """Sources are counted after their own deduplication, and as landed in records_read."""
    kept = materialize(ranking.keep_first_text(t.documents, "text", [], "doc_id").select("doc_id"), "interim")
    run = oplogs.consolidation_run(
        {"a": kept, "b": t.pages}, kept, F.lit("2025-12-03T00:41:35"), "out/jobs", read=[t.documents, t.pages]
    )
    by_source = F.col("records_in_by_source")
    return run.withColumn("records_a", by_source["a"]).withColumn("records_b", by_source["b"]).drop(
        "records_in_by_source"
    )
