"""Streaming jobs run to the end of the given tables; results are read from their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.plans.registry import Tables, query
from vacantia.session import scratch_path
from vacantia.sources import landing
from vacantia.streaming import jobs, stateful


def _event_stream(t: Tables) -> DataFrame:
    # A pattern matches a single file as well as a folder of part files.
    path = f"{t.folder.rstrip('/')}/events.parquet*"
    return t.spark.readStream.schema(t.events.schema).parquet(path)


def _finish(running) -> None:
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()


@query(
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS kind, count(*) AS n,"
    " CAST(round(avg(value) * count(*) * 100) AS BIGINT) AS total_cents, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2"
)
def stream_search_stats(t: Tables) -> DataFrame:
    """Hourly counts and durations per type; the sink's newest value per window is the result."""
    stats = jobs.windowed_search_stats(
        _event_stream(t), event_time="ts", kind="event_type", duration="value"
    )
    path = scratch_path(t.spark, "stream-stats")
    _finish(jobs.update_parquet(stats, path, scratch_path(t.spark, "checkpoint")))
    newest = jobs.newest_values(t.spark.read.parquet(path), ["window_start", "kind"])
    # Values have two decimals: the total in hundredths does not depend on the order of summing.
    return newest.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
        "kind",
        "n",
        F.round(F.col("avg_duration") * F.col("n") * 100).cast("bigint").alias("total_cents"),
        "errors",
    )


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_drop_repeats(t: Tables) -> DataFrame:
    """First event per user and type; the watermark delay covers the whole table."""
    first = jobs.drop_repeats(_event_stream(t), ["user_id", "event_type"], "ts", "400 days")
    path = scratch_path(t.spark, "stream-first")
    _finish(jobs.append_parquet(first, path, scratch_path(t.spark, "checkpoint")))
    return t.spark.read.parquet(path).select("user_id", "event_type")


@query(
    "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)"
    " AS rn FROM events) WHERE rn = 1"
)
def stream_latest_state(t: Tables) -> DataFrame:
    state = jobs.latest_state_stream(_event_stream(t), "user_id", "ts", ["event_type", "value"], tie="event_id")
    path = scratch_path(t.spark, "stream-state")
    _finish(jobs.update_parquet(state, path, scratch_path(t.spark, "checkpoint")))
    newest = jobs.newest_values(t.spark.read.parquet(path), ["user_id"])
    return newest.select("user_id", "event_type", "value")


@query(
    "SELECT 'd' || doc_id AS job_id, split_part(text, chr(10), 1) AS title, lang AS location_country, source AS category_label,"
    " length(text) AS chars FROM documents"
)
def stream_landing(t: Tables) -> DataFrame:
    """Documents landed as JSON lines and streamed into the canonical table."""
    raw, out = scratch_path(t.spark, "stream-raw"), scratch_path(t.spark, "stream-jobs")
    d = t.documents.select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("description"),
        F.col("lang").alias("country"),
        F.col("source").alias("category"),
        F.lit("adzuna").alias("source"),
    )
    landing.append_lines(d, raw)
    canonical = jobs.landed_to_canonical(jobs.stream_landed(t.spark, raw))
    _finish(jobs.append_parquet(canonical, out, scratch_path(t.spark, "checkpoint")))
    table = t.spark.read.parquet(out)
    return table.select(
        "job_id", "title", "location_country", "category_label", F.length("description").cast("bigint").alias("chars")
    )


@query(
    """WITH bound AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
    newest AS (SELECT user_id, event_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR DESC) AS rn FROM events) WHERE rn = 1)
    SELECT user_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value
    FROM newest, bound WHERE ts + INTERVAL 2 DAY >= mark"""
)
def stream_latest_entries(t: Tables) -> DataFrame:
    """Newest entry of the users seen in the last two days; a fifth of the entries are corrupt and count as empty."""
    body = F.to_json(F.struct("event_type", "value"))
    stream = _event_stream(t).withColumn("entry", F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(body))
    path = scratch_path(t.spark, "stream-entries")
    changed = stateful.latest_entries(stream, "user_id", "ts", "entry", "event_id", lifetime="2 days", delay="1 hour")
    _finish(jobs.update_parquet(changed, path, scratch_path(t.spark, "checkpoint")))
    newest = jobs.newest_values(t.spark.read.parquet(path), ["user_id"]).filter("not expired")
    entry = F.from_json("entry", "event_type string, value double")
    return newest.select("user_id", entry["event_type"].alias("event_type"), entry["value"].alias("value"))


#: Events arrive in three batches that do not follow their times.
ARRIVAL = 3


@query(
    f"""WITH placed AS (SELECT *, max(ts) OVER (PARTITION BY user_id, event_type ORDER BY event_id % {ARRIVAL}, ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM events),
    kinds AS (SELECT *, CASE WHEN newest IS NULL THEN 'first' WHEN ts < newest - INTERVAL 6 HOUR THEN 'late' WHEN ts > newest + INTERVAL 6 HOUR THEN 'first' ELSE 'repeat' END AS kind FROM placed)
    SELECT kind, user_id, event_type, event_id, NULL::BIGINT AS n FROM kinds WHERE kind <> 'repeat'
    UNION ALL SELECT kind, NULL, NULL, NULL, count(*) FROM kinds GROUP BY kind"""
)
def stream_first_and_late(t: Tables) -> DataFrame:
    """First rows, late rows in a table of their own, and how many rows of each kind came in; together all rows."""
    folder = scratch_path(t.spark, "stream-arrivals")
    first, late, counts = (scratch_path(t.spark, f"stream-{x}") for x in ("first", "late", "counts"))
    checkpoint = scratch_path(t.spark, "checkpoint")
    for batch in range(ARRIVAL):  # the stream goes on from its checkpoint and takes all that has come as one batch
        t.events.filter(F.col("event_id") % ARRIVAL == batch).write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(t.events.schema).parquet(folder)
        kinds = stateful.kinds_of_rows(stream, ["user_id", "event_type"], "ts", "event_id", delay="6 hours", kept="3650 days")
        _finish(stateful.split_late(kinds, first, late, counts, checkpoint))
    rows = [t.spark.read.parquet(path).select(F.lit(kind).alias("kind"), "user_id", "event_type", "event_id") for kind, path in (("first", first), ("late", late))]
    totals = t.spark.read.schema("kind string, count long").json(counts).groupBy("kind").agg(F.sum("count").alias("n"))
    return rows[0].unionByName(rows[1]).unionByName(totals, allowMissingColumns=True)
