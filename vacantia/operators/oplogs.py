"""Latest state, run statistics and report rows over append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dictionaries as D
from vacantia.functions.dates import minute_label, stamp
from vacantia.functions.labels import (
    decimal_label,
    duration_label,
    lookup,
    millis_label,
    percent_label,
    status_label,
    thousands,
)
from vacantia.functions.text import title_case
from vacantia.operators.ranking import last_entries


def latest_state(
    log: DataFrame, key: str, updated_at: str, values: Sequence[str], tie: str | None = None
) -> DataFrame:
    """Newest entry per key; partial maxima are taken before the shuffle."""
    order = F.struct(updated_at, tie) if tie else F.col(updated_at)
    newest = F.max_by(F.struct(updated_at, *values), order).alias("s")
    return log.groupBy(key).agg(newest).select(key, "s.*")


def source_response(
    runs: DataFrame, duration: str = "duration_seconds", calls: str = "api_calls", status: str = "status"
) -> DataFrame:
    """Mean time per call and ONLINE/ERROR per run."""
    ok = F.col(status).isin("success", "no_new_jobs")
    return runs.withColumns(
        {
            "response_time_ms": F.when(F.col(calls) > 0, F.col(duration) / F.col(calls) * 1000),
            "health": F.when(ok, F.lit("ONLINE")).otherwise(F.lit("ERROR")),
        }
    )


def search_stats(
    log: DataFrame,
    *,
    kind: str = "search_type",
    duration: str = "duration_ms",
    status: str = "status",
    keyword: str = "keyword",
    semantic: Sequence[str] = ("semantic",),
    failed: str = "error",
) -> DataFrame:
    """One row of totals, mean durations and the error rate; zeros for an empty log.

    Pass semantic=("semantic", "semantic_text") to count text searches too.
    """
    is_keyword, is_semantic = F.col(kind) == keyword, F.col(kind).isin(*semantic)
    d = F.col(duration)
    n = F.count(F.lit(1))
    return log.agg(
        n.alias("total_searches"),
        F.count_if(is_keyword).alias("keyword_searches"),
        F.count_if(is_semantic).alias("semantic_searches"),
        F.avg(d).alias("avg_duration"),
        F.avg(F.when(is_keyword, d)).alias("avg_keyword_duration"),
        F.avg(F.when(is_semantic, d)).alias("avg_semantic_duration"),
        F.coalesce(F.try_divide(F.count_if(F.col(status) == failed), n), F.lit(0.0)).alias("error_rate"),
    )


def search_stats_labels(stats: DataFrame) -> DataFrame:
    counts = ("total_searches", "keyword_searches", "semantic_searches")
    times = ("avg_duration", "avg_keyword_duration", "avg_semantic_duration")
    return stats.select(
        *[thousands(F.col(c)).alias(c) for c in counts],
        *[millis_label(F.col(c)).alias(c) for c in times],
        percent_label(F.col("error_rate")).alias("error_rate"),
    )


def embedding_stats(
    log: DataFrame,
    *,
    timestamp: str = "timestamp",
    embeddings: str = "total_embeddings",
    jobs: str = "num_jobs",
    speed: str = "embeddings_per_second",
    last: int = 50,
    tie: str | None = None,
) -> DataFrame:
    """Totals, mean of the non-zero speeds and newest timestamp over the last runs."""
    recent = last_entries(log, timestamp, last, tie)
    return recent.agg(
        F.coalesce(F.sum(embeddings), F.lit(0)).alias("total_embeddings"),
        F.coalesce(F.sum(jobs), F.lit(0)).alias("total_jobs"),
        F.coalesce(F.avg(F.when(F.col(speed) != 0, F.col(speed))), F.lit(0.0)).alias("avg_speed"),
        F.max(timestamp).alias("last_run"),
    )


def embedding_run(jobs: Column, duration: Column, views: int = 4) -> Column:
    """Struct of run totals; the speed is 0 for a zero duration."""
    total = jobs * views
    return F.struct(
        jobs.alias("num_jobs"),
        F.lit(views).alias("num_embeddings_per_job"),
        total.alias("total_embeddings"),
        F.coalesce(F.try_divide(total, duration), F.lit(0.0)).alias("embeddings_per_second"),
    )


def cv_stats(
    log: DataFrame, duration: str = "duration_seconds", status: str = "status", timestamp: str = "timestamp"
) -> DataFrame:
    n = F.count(F.lit(1))
    return log.agg(
        n.alias("total_analyzed"),
        F.coalesce(F.avg(duration), F.lit(0.0)).alias("average_duration_seconds"),
        F.coalesce(F.try_divide(F.count_if(F.col(status) == "error"), n), F.lit(0.0)).alias("error_rate"),
        F.max(timestamp).alias("updated_at"),
    )


def consolidation_run(
    sources: dict[str, DataFrame], output: DataFrame, timestamp: Column, path: str | None = None,
    read: Sequence[DataFrame] = (),
) -> DataFrame:
    """One log row: rows in per source, rows out, status.

    Sources are given after their own deduplication; `read` are the tables as landed.
    """
    tagged = [df.select(F.lit(name).alias("s")) for name, df in sources.items()]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionAll(other)
    counts = union.agg(
        *[F.count_if(F.col("s") == name).alias(name) for name in sources],
        F.count(F.lit(1)).alias("_in"),
    )
    rows_out = output.agg(F.count(F.lit(1)).alias("n")).scalar()
    by_source = [x for name in sources for x in (F.lit(name), F.col(name))]
    n_read = F.lit(0).cast("bigint")
    for df in read:
        n_read = n_read + df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("records_out", rows_out).select(
        timestamp.alias("timestamp"),
        F.when(F.col("records_out") > 0, "success").otherwise("no_data").alias("status"),
        n_read.alias("records_read"),
        F.col("_in").alias("records_in"),
        F.create_map(*by_source).alias("records_in_by_source"),
        "records_out",
        F.when(F.col("records_out") > 0, F.lit(path)).alias("output_path"),
    )


# --------------------------------------------------------------------------- report rows


def run_id(prefix: str, timestamp: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), stamp(timestamp))


def short_id(c: Column, n: int = 12) -> Column:
    return F.substring(c, 1, n)


def source_health_report(state: DataFrame, show_zero: bool = False) -> DataFrame:
    """Label, status, last check, response time and rate text per source.

    A response time of zero counts as none, as in the reference; `show_zero` shows it.
    """
    used, total = F.col("rate_limit_used"), F.col("rate_limit_total")
    response = F.col("response_time_ms")
    return state.select(
        F.coalesce(lookup(D.SOURCE_LABELS, F.col("source")), F.col("source")).alias("name"),
        status_label(F.col("status"), D.RUN_STATUS_LABELS).alias("status"),
        minute_label(F.col("last_check")).alias("last_check"),
        F.when(
            response.isNotNull() & (F.lit(show_zero) | (response != 0)), F.concat(response.cast("bigint").cast("string"), F.lit(" ms"))
        )
        .otherwise(F.lit("-"))
        .alias("response_time"),
        F.when(
            used.isNotNull() & total.isNotNull(),
            F.concat(used.cast("string"), F.lit(" / "), total.cast("string"), F.lit(" req/day")),
        )
        .otherwise(F.lit("-"))
        .alias("rate_limit"),
    )


def collection_report(log: DataFrame, n: int = 6, tie: str | None = None) -> DataFrame:
    ts = F.col("timestamp")
    return last_entries(log, "timestamp", n, tie).select(
        run_id("col", ts).alias("job_id"),
        F.coalesce(F.col("source"), F.lit("Unknown")).alias("source"),
        status_label(F.col("status"), D.RUN_STATUS_LABELS).alias("status"),
        thousands(F.col("jobs_collected")).alias("records"),
        duration_label(F.col("duration_seconds")).alias("duration"),
        minute_label(ts).alias("started"),
        F.col("filepath").alias("log_path"),
    )


def processing_report(log: DataFrame, n: int = 6, tie: str | None = None) -> DataFrame:
    ts = F.col("timestamp")
    return last_entries(log, "timestamp", n, tie).select(
        run_id("cons", ts).alias("job_id"),
        status_label(F.col("status"), D.RUN_STATUS_LABELS).alias("status"),
        thousands(F.col("records_in")).alias("records_in"),
        thousands(F.col("records_out")).alias("records_out"),
        duration_label(F.col("duration_seconds")).alias("duration"),
        minute_label(ts).alias("completed"),
        F.col("output_path").alias("output"),
    )


def embedding_report(log: DataFrame, n: int = 6, tie: str | None = None) -> DataFrame:
    ts = F.col("timestamp")
    speed = F.coalesce(F.col("embeddings_per_second"), F.lit(0.0))
    return last_entries(log, "timestamp", n, tie).select(
        run_id("emb", ts).alias("job_id"),
        F.coalesce(F.col("model_name"), F.lit("Unknown")).alias("model"),
        status_label(F.col("status"), D.MODEL_STATUS_LABELS).alias("status"),
        thousands(F.col("num_jobs")).alias("jobs_processed"),
        thousands(F.col("total_embeddings")).alias("total_embeddings"),
        duration_label(F.col("duration_seconds")).alias("duration"),
        F.concat(decimal_label(speed), F.lit(" emb/s")).alias("speed"),
        minute_label(ts).alias("completed"),
    )


def cv_report(log: DataFrame, n: int = 6, tie: str | None = None) -> DataFrame:
    ts = F.col("timestamp")
    return last_entries(log, "timestamp", n, tie).select(
        short_id(F.coalesce(F.col("cv_id"), run_id("cv", ts))).alias("cv_id"),
        status_label(F.col("status"), D.MODEL_STATUS_LABELS).alias("status"),
        thousands(F.col("skills_extracted")).alias("skills_found"),
        thousands(F.col("jobs_matched")).alias("jobs_matched"),
        duration_label(F.col("duration_seconds")).alias("duration"),
        F.coalesce(F.col("model_used"), F.lit("N/A")).alias("model"),
        minute_label(ts).alias("timestamp"),
    )


def search_query_label(kind: Column, query: Column) -> Column:
    """"KW: 'x', Loc: 'y'" for keyword searches, "CV: file" for CV searches."""

    def part(label: str, field: str) -> Column:
        value = query[field]
        return F.when(value != "", F.concat(F.lit(label + ": '"), value, F.lit("'")))

    keyword = F.concat_ws(", ", part("KW", "keywords"), part("Loc", "location"), part("Skills", "skills"))
    return (
        F.when(kind == "keyword", keyword)
        .when(kind == "semantic", F.concat(F.lit("CV: "), F.coalesce(query["filename"], F.lit("N/A"))))
        .otherwise(F.lit(""))
    )


def search_report(log: DataFrame, n: int = 10, tie: str | None = None) -> DataFrame:
    return last_entries(log, "timestamp", n, tie).select(
        minute_label(F.col("timestamp")).alias("timestamp"),
        title_case(F.coalesce(F.col("search_type"), F.lit("N/A"))).alias("type"),
        search_query_label(F.col("search_type"), F.col("query")).alias("query"),
        thousands(F.col("results_count")).alias("results"),
        millis_label(F.col("duration_ms")).alias("duration"),
        status_label(F.col("status"), D.MODEL_STATUS_LABELS).alias("status"),
    )


def model_report(state: DataFrame) -> DataFrame:
    """Per model: status (default offline), type with dimension, last use."""
    kind = F.coalesce(F.col("service_type"), F.lit("Unknown"))
    dim = F.col("embedding_dim")
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("OFFLINE"))
    return state.select(
        F.col("model").alias("title"),
        status_label(status, D.MODEL_STATUS_LABELS).alias("status"),
        F.when(
            F.coalesce(dim, F.lit(0)) != 0, F.concat(kind, F.lit(" (dim: "), dim.cast("string"), F.lit(")"))
        )
        .otherwise(kind)
        .alias("models"),
        minute_label(F.col("last_used")).alias("last_check"),
    )


def worker_report(state: DataFrame) -> DataFrame:
    """Per worker: status (default idle) and last run, falling back to the update time."""
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("IDLE"))
    last = F.coalesce(F.nullif(F.col("last_run"), F.lit("")), F.col("updated_at"))
    return state.select(
        F.col("worker"),
        status_label(status, D.RUN_STATUS_LABELS).alias("status"),
        minute_label(last).alias("last_run"),
    )
