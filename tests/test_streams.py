"""Streams over several batches against the batch result."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from vacantia.sources import landing
from vacantia.streaming import jobs


def batches(spark, tmp_path, folder, n=4):
    """Events split by time into n files, read one file per batch."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    cuts = events.select(F.ntile(n).over(Window.orderBy("ts", "event_id")).alias("part"), "*")
    for i in range(1, n + 1):
        cuts.filter(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return events, stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_windowed_stats(spark, tmp_path, folder):
    events, stream = batches(spark, tmp_path, folder)
    out = jobs.windowed_search_stats(stream, event_time="ts", kind="event_type", duration="value", window="1 day", delay="1 day")
    jobs.update_parquet(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.select("batch_id").distinct().count() >= 4
    got = jobs.newest_values(table, ["window_start", "kind"]).select(F.to_date("window_start"), "kind", "n", "errors")
    day = F.to_date("ts")
    expected = events.groupBy(day.alias("d"), "event_type").agg(F.count("*"), F.count_if(F.col("event_type") == "error"))
    assert rows(got) == rows(expected)


def test_drop_repeats_and_restart(spark, tmp_path, folder):
    events, stream = batches(spark, tmp_path, folder)
    for _ in range(2):  # the second run finds nothing new
        first = jobs.drop_repeats(stream, ["user_id", "event_type"], "ts", "60 days")
        jobs.append_parquet(first, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("user_id", "event_type")
    assert rows(got) == rows(events.select("user_id", "event_type").distinct())


def test_latest_state(spark, tmp_path, folder):
    events, stream = batches(spark, tmp_path, folder)
    state = jobs.latest_state_stream(stream, "event_type", "ts", ["event_id"])
    jobs.update_parquet(state, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = jobs.newest_values(spark.read.parquet(str(tmp_path / "out")), ["event_type"]).select("event_type", "event_id")
    assert rows(got) == rows(events.groupBy("event_type").agg(F.max_by("event_id", "ts")))


def test_landing_stream(spark, tmp_path):
    def land(name, *jobs_):
        path = tmp_path / "raw" / "a" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(json.dumps(j) for j in jobs_))

    land("1.json", {"id": "1", "title": "t", "description": "d", "source": "a", "location": "L"}, {"id": "", "title": "t", "description": "d"})
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        canonical = jobs.landed_to_canonical(jobs.stream_landed(spark, str(tmp_path / "raw")))
        jobs.append_parquet(canonical, out, checkpoint).awaitTermination()
        return sorted((r["job_id"], r["location_display"]) for r in spark.read.parquet(out).collect())

    assert run() == [("1", "L")]
    land("2.json", {"id": "2", "title": "t", "description": "d", "source": "a"}, {"id": "3", "title": None, "description": "d"})
    assert run() == [("1", "L"), ("2", None)]
    assert landing.read_landed_lines(spark, str(tmp_path / "raw")).count() == 4
