"""Queries on latest state, run statistics and report rows, with events as the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import dictionaries as D
from vacantia.functions import labels
from vacantia.functions.dates import minute_label
from vacantia.operators import oplogs
from vacantia.plans.registry import Tables, query

MINUTE_SQL = "strftime(ts, '%Y-%m-%d %H:%M')"
STAMP_SQL = "strftime(ts, '%Y%m%d_%H%M%S')"
K_SQL = "json_extract(props, '$.k')::BIGINT"


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def sql_duration(seconds: str) -> str:
    whole = f"CAST(round_even({seconds}, 0) AS BIGINT)"
    return (
        f"CASE WHEN coalesce({seconds}, 0) = 0 THEN '0s' WHEN {whole} < 60 THEN {whole} || 's'"
        f" ELSE printf('%dm %02ds', {whole} // 60, {whole} % 60) END"
    )


def sql_millis(ms: str) -> str:
    return (
        f"CASE WHEN coalesce({ms}, 0) = 0 THEN '0ms' WHEN {ms} < 1000 THEN CAST(trunc({ms}) AS BIGINT) || 'ms'"
        f" ELSE printf('%.2fs', {ms} / 1000) END"
    )


def sql_status(status: str, mapping) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return (
        f"CASE upper(coalesce({status}, '')) WHEN '' THEN 'Unknown' {whens} ELSE"
        f" upper({status}[1:1]) || lower({status}[2:]) END"
    )


@query(
    "SELECT user_id, event_type AS status, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id"
    " ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"
)
def latest_state(t: Tables) -> DataFrame:
    state = oplogs.latest_state(t.events, "user_id", "ts", ["event_type", "value", "event_id"], tie="event_id")
    return state.select("user_id", F.col("event_type").alias("status"), "value", "event_id")


@query(
    f"SELECT event_id, CASE WHEN {K_SQL} % 10 > 0 THEN round(value / ({K_SQL} % 10) * 1000, 4) END AS response_time_ms,"
    " CASE WHEN event_type IN ('view', 'click') THEN 'ONLINE' ELSE 'ERROR' END AS health FROM events"
)
def source_response(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "success").when(kind == "click", "no_new_jobs").otherwise("error")
    runs = t.events.select(
        "event_id", F.col("value").alias("duration_seconds"), (_k() % 10).alias("api_calls"), status.alias("status")
    )
    out = oplogs.source_response(runs)
    return out.select("event_id", F.round("response_time_ms", 4).alias("response_time_ms"), "health")


STATS_SQL = """SELECT count(*) AS total_searches, count(*) FILTER (event_type = 'view') AS keyword_searches,
  count(*) FILTER (event_type = 'click') AS semantic_searches, avg(value) AS a, avg(value) FILTER (event_type = 'view') AS k,
  avg(value) FILTER (event_type = 'click') AS s, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS e FROM events"""


@query(
    "SELECT total_searches, keyword_searches, semantic_searches, round(a, 6) AS avg_duration, round(k, 6) AS avg_keyword_duration,"
    f" round(s, 6) AS avg_semantic_duration, round(e, 6) AS error_rate FROM ({STATS_SQL})"
)
def search_stats(t: Tables) -> DataFrame:
    out = _stats(t)
    rates = ["avg_duration", "avg_keyword_duration", "avg_semantic_duration", "error_rate"]
    return out.withColumns({c: F.round(c, 6) for c in rates})


def _stats(t: Tables) -> DataFrame:
    return oplogs.search_stats(
        t.events, kind="event_type", duration="value", status="event_type", keyword="view", semantic=("click",)
    )


@query(
    "SELECT format('{:,}', total_searches) AS total_searches, format('{:,}', keyword_searches) AS keyword_searches,"
    " format('{:,}', semantic_searches) AS semantic_searches,"
    f" {sql_millis('a')} AS avg_duration, {sql_millis('k')} AS avg_keyword_duration, {sql_millis('s')} AS avg_semantic_duration,"
    f" printf('%.1f%%', e * 100) AS error_rate FROM ({STATS_SQL})"
)
def search_stats_labels(t: Tables) -> DataFrame:
    return oplogs.search_stats_labels(_stats(t))


@query(
    f"""WITH recent AS (SELECT *, {K_SQL} AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)
    SELECT sum(k * 4)::BIGINT AS total_embeddings, sum(k)::BIGINT AS total_jobs,
      round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS avg_speed,
      strftime(max(date_trunc('second', ts)), '%Y-%m-%d %H:%M:%S') AS last_run FROM recent"""
)
def embedding_stats(t: Tables) -> DataFrame:
    log = t.events.select(
        F.col("ts").alias("timestamp"),
        (_k() * 4).alias("total_embeddings"),
        _k().alias("num_jobs"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("embeddings_per_second"),
        "event_id",
    )
    out = oplogs.embedding_stats(log, tie="event_id")
    return out.withColumns(
        {"avg_speed": F.round("avg_speed", 6), "last_run": F.date_format("last_run", "yyyy-MM-dd HH:mm:ss")}
    )


@query(
    f"SELECT event_id, {K_SQL} AS num_jobs, 4 AS num_embeddings_per_job, {K_SQL} * 4 AS total_embeddings,"
    f" CASE WHEN event_type = 'error' OR value = 0 THEN 0 ELSE {K_SQL} * 4 / value END AS embeddings_per_second FROM events"
)
def embedding_runs(t: Tables) -> DataFrame:
    seconds = F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value"))
    return t.events.select("event_id", oplogs.embedding_run(_k(), seconds).alias("r")).select("event_id", "r.*")


@query(
    "SELECT count(*) AS total_analyzed, round(avg(value), 6) AS average_duration_seconds,"
    " round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS error_rate,"
    " strftime(max(ts), '%Y-%m-%d %H:%M') AS updated_at FROM events"
)
def cv_stats(t: Tables) -> DataFrame:
    out = oplogs.cv_stats(t.events, duration="value", status="event_type", timestamp="ts")
    return out.withColumns(
        {
            "average_duration_seconds": F.round("average_duration_seconds", 6),
            "error_rate": F.round("error_rate", 6),
            "updated_at": minute_label(F.col("updated_at")),
        }
    )


# --------------------------------------------------------------------------- labels over whole tables


@query(
    f"SELECT event_id, {MINUTE_SQL} AS at_minute, {sql_duration('value * 3')} AS duration, {sql_millis('value * 20')} AS millis,"
    " format('{:,}', event_id * 1000) AS thousands, printf('%.1f', value) AS one_decimal, printf('%.1f%%', value * 100) AS percent,"
    f" 'col_' || {STAMP_SQL} AS run_id, substr('cv_' || {STAMP_SQL}, 1, 12) AS short_id FROM events"
)
def report_labels(t: Tables) -> DataFrame:
    value, ts = F.col("value"), F.col("ts")
    return t.events.select(
        "event_id",
        minute_label(ts).alias("at_minute"),
        labels.duration_label(value * 3).alias("duration"),
        labels.millis_label(value * 20).alias("millis"),
        labels.thousands(F.col("event_id") * 1000).alias("thousands"),
        labels.decimal_label(value).alias("one_decimal"),
        labels.percent_label(value).alias("percent"),
        oplogs.run_id("col", ts).alias("run_id"),
        oplogs.short_id(oplogs.run_id("cv", ts)).alias("short_id"),
    )


STATUS_SQL = "CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'no_new_jobs' WHEN 'signup' THEN '' ELSE event_type END"


def _status() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "view", "success").when(kind == "click", "no_new_jobs").when(kind == "signup", "").otherwise(kind)
    )


@query(
    f"SELECT run_label, model_label, count(*) AS n FROM (SELECT {sql_status('s', D.RUN_STATUS_LABELS)} AS run_label,"
    f" CASE WHEN s = 'no_new_jobs' THEN 'No_New_Jobs' ELSE {sql_status('s', D.MODEL_STATUS_LABELS)} END AS model_label"
    f" FROM (SELECT {STATUS_SQL} AS s FROM events)) GROUP BY ALL"
)
def status_labels(t: Tables) -> DataFrame:
    return (
        t.events.select(
            labels.status_label(_status(), D.RUN_STATUS_LABELS).alias("run_label"),
            labels.status_label(_status(), D.MODEL_STATUS_LABELS).alias("model_label"),
        )
        .groupBy("run_label", "model_label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --------------------------------------------------------------------------- reports


NEWEST_PER_SOURCE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


@query(
    f"""SELECT CASE WHEN user_id < 10 THEN 'Adzuna API' ELSE 'u' || user_id END AS name, {sql_status('s', D.RUN_STATUS_LABELS)} AS status,
      {MINUTE_SQL} AS last_check, CASE WHEN event_type = 'error' THEN '-' ELSE CAST(trunc(value * 10) AS BIGINT) || ' ms' END AS response_time,
      CASE WHEN event_type = 'view' THEN '-' ELSE event_id || ' / 1000 req/day' END AS rate_limit
    FROM (SELECT *, {STATUS_SQL} AS s FROM ({NEWEST_PER_SOURCE}))"""
)
def source_health_report(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    state = oplogs.latest_state(t.events, "user_id", "ts", ["event_type", "value", "event_id"], tie="event_id")
    named = state.select(
        F.when(F.col("user_id") < 10, "Adzuna").otherwise(F.concat(F.lit("u"), "user_id")).alias("source"),
        _status().alias("status"),
        F.col("ts").alias("last_check"),
        F.when(kind != "error", F.col("value") * 10).alias("response_time_ms"),
        F.when(kind != "view", F.col("event_id")).alias("rate_limit_used"),
        F.lit(1000).alias("rate_limit_total"),
    )
    return oplogs.source_health_report(named, show_zero=True)


def _log(t: Tables, **columns: Column) -> DataFrame:
    return t.events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        _status().alias("status"),
        F.col("value").alias("duration_seconds"),
        "event_id",
        *[c.alias(n) for n, c in columns.items()],
    )


def _recent(n: int) -> str:
    return f"(SELECT *, {STATUS_SQL} AS s FROM events ORDER BY ts DESC, event_id DESC LIMIT {n})"


@query(
    f"SELECT 'col_' || {STAMP_SQL} AS job_id, 'u' || user_id AS source, {sql_status('s', D.RUN_STATUS_LABELS)} AS status,"
    f" format('{{:,}}', event_id) AS records, {sql_duration('value')} AS duration, {MINUTE_SQL} AS started, 'f' || event_id AS log_path"
    f" FROM {_recent(6)}"
)
def collection_report(t: Tables) -> DataFrame:
    log = _log(
        t, source=F.concat(F.lit("u"), "user_id"), jobs_collected=F.col("event_id"), filepath=F.concat(F.lit("f"), "event_id")
    )
    return oplogs.collection_report(log, tie="event_id")


@query(
    f"SELECT 'cons_' || {STAMP_SQL} AS job_id, {sql_status('s', D.RUN_STATUS_LABELS)} AS status, format('{{:,}}', event_id) AS records_in,"
    f" '-' AS records_out, {sql_duration('value')} AS duration, {MINUTE_SQL} AS completed, 'o' || event_id AS output FROM {_recent(6)}"
)
def processing_report(t: Tables) -> DataFrame:
    log = _log(
        t, records_in=F.col("event_id"), records_out=F.lit(None).cast("long"), output_path=F.concat(F.lit("o"), "event_id")
    )
    return oplogs.processing_report(log, tie="event_id")


@query(
    f"SELECT 'emb_' || {STAMP_SQL} AS job_id, 'Unknown' AS model, CASE WHEN s = 'no_new_jobs' THEN 'No_New_Jobs' ELSE"
    f" {sql_status('s', D.MODEL_STATUS_LABELS)} END AS status, format('{{:,}}', event_id) AS jobs_processed,"
    f" format('{{:,}}', event_id * 4) AS total_embeddings, {sql_duration('value')} AS duration, printf('%.1f emb/s', value) AS speed,"
    f" {MINUTE_SQL} AS completed FROM {_recent(6)}"
)
def embedding_report(t: Tables) -> DataFrame:
    log = _log(
        t, model_name=F.lit(None).cast("string"), num_jobs=F.col("event_id"), total_embeddings=F.col("event_id") * 4,
        embeddings_per_second=F.col("value"),
    )
    return oplogs.embedding_report(log, tie="event_id")


@query(
    f"SELECT substr(CASE WHEN event_type = 'view' THEN 'cv_' || {STAMP_SQL} ELSE 'candidate-' || event_id END, 1, 12) AS cv_id,"
    f" CASE WHEN s = 'no_new_jobs' THEN 'No_New_Jobs' ELSE {sql_status('s', D.MODEL_STATUS_LABELS)} END AS status,"
    f" format('{{:,}}', user_id) AS skills_found, '-' AS jobs_matched, {sql_duration('value')} AS duration, 'N/A' AS model,"
    f" {MINUTE_SQL} AS timestamp FROM {_recent(6)}"
)
def cv_report(t: Tables) -> DataFrame:
    log = _log(
        t,
        cv_id=F.when(F.col("event_type") != "view", F.concat(F.lit("candidate-"), "event_id")),
        skills_extracted=F.col("user_id"),
        jobs_matched=F.lit(None).cast("long"),
        model_used=F.lit(None).cast("string"),
    )
    return oplogs.cv_report(log, tie="event_id")


@query(
    f"""SELECT {MINUTE_SQL} AS timestamp, CASE event_type WHEN 'view' THEN 'Keyword' WHEN 'click' THEN 'Semantic' ELSE 'Semantic_Text' END AS type,
      CASE event_type WHEN 'view' THEN concat_ws(', ', 'KW: ''' || 'k' || user_id || '''', CASE WHEN user_id > 50 THEN 'Loc: ''UK''' END)
        WHEN 'click' THEN 'CV: ' || CASE WHEN user_id > 50 THEN 'cv.pdf' ELSE 'N/A' END ELSE '' END AS query,
      format('{{:,}}', event_id) AS results, {sql_millis('value')} AS duration,
      CASE WHEN s = 'no_new_jobs' THEN 'No_New_Jobs' ELSE {sql_status('s', D.MODEL_STATUS_LABELS)} END AS status FROM {_recent(10)}"""
)
def search_report(t: Tables) -> DataFrame:
    kind, late = F.col("event_type"), F.col("user_id") > 50
    search = F.when(kind == "view", "keyword").when(kind == "click", "semantic").otherwise("semantic_text")
    asked = F.struct(
        F.concat(F.lit("k"), "user_id").alias("keywords"),
        F.when(late, "UK").otherwise("").alias("location"),
        F.lit(None).cast("string").alias("skills"),
        F.when(late, "cv.pdf").alias("filename"),
    )
    log = _log(t, search_type=search, query=asked, results_count=F.col("event_id"), duration_ms=F.col("value"))
    return oplogs.search_report(log, tie="event_id")


@query(
    f"""SELECT 'm' || user_id AS title, CASE WHEN s = '' THEN 'Offline' WHEN s = 'no_new_jobs' THEN 'No_New_Jobs' ELSE {sql_status('s', D.MODEL_STATUS_LABELS)} END AS status,
      CASE WHEN event_type = 'error' THEN 'Encoder' ELSE 'Encoder (dim: 768)' END AS models, {MINUTE_SQL} AS last_check
    FROM (SELECT *, {STATUS_SQL} AS s FROM ({NEWEST_PER_SOURCE}))"""
)
def model_report(t: Tables) -> DataFrame:
    state = oplogs.latest_state(t.events, "user_id", "ts", ["event_type", "event_id"], tie="event_id")
    return oplogs.model_report(
        state.select(
            F.concat(F.lit("m"), "user_id").alias("model"),
            _status().alias("status"),
            F.lit("Encoder").alias("service_type"),
            F.when(F.col("event_type") != "error", F.lit(768)).alias("embedding_dim"),
            F.col("ts").alias("last_used"),
        )
    )


@query(
    f"""SELECT user_id AS worker, CASE WHEN s = '' THEN 'Idle' ELSE {sql_status('s', D.RUN_STATUS_LABELS)} END AS status,
      CASE WHEN event_type = 'view' THEN '2024-02-01 00:00' ELSE {MINUTE_SQL} END AS last_run
    FROM (SELECT *, {STATUS_SQL} AS s FROM ({NEWEST_PER_SOURCE}))"""
)
def worker_report(t: Tables) -> DataFrame:
    state = oplogs.latest_state(t.events, "user_id", "ts", ["event_type", "event_id"], tie="event_id")
    return oplogs.worker_report(
        state.select(
            F.col("user_id").alias("worker"),
            _status().alias("status"),
            F.when(F.col("event_type") == "view", "2024-02-01T00:00:00").alias("last_run"),
            F.col("ts").cast("string").alias("updated_at"),
        )
    )
