"""Readers and writers on files of every shape."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vacantia.operators import vectors
from vacantia.plans import end_to_end
from vacantia.schema import PROCESSING_LOG, SEARCH_LOG
from vacantia.sources import landing, logs, tables


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


def job(i, **extra):
    return {"id": i, "title": f" t{i} ", "description": "d", "source": "a", **extra}


@pytest.fixture()
def raw(tmp_path):
    put(tmp_path / "a/2025-01-01/jobs_000001.json", [job("1"), job("2", created="2025-01-01T00:00:00Z")])
    put(tmp_path / "a/2025-01-02/jobs_000002.json", [job("1", title="later"), job(None), job(None), job("4", title=None)])
    put(tmp_path / "a/2025-01-02/jobs_000003.json", job("3", location="Here", category="C"))
    put(tmp_path / "a/2025-01-02/jobs_000004.json", '[{"id": "9", "title": "x"')
    put(tmp_path / "a/2025-01-02/jobs.jsonl", job("8"))
    put(tmp_path / "b/2025-01-02/jobs_000001.json", [job("1", source="b", url="u", created_at="2025-02-01", tags=["x"])])
    return tmp_path


def test_landed_scan(spark, raw):
    df = landing.read_landed(spark, str(raw / "a"))
    # A list, a single object; the truncated file and the other file name are left out.
    assert sorted((r["id"] or "-") for r in df.collect()) == ["-", "-", "1", "1", "2", "3", "4"]
    assert df.count() == 7
    assert df.filter("src_file LIKE '%jobs_000001.json'").count() == 2


def test_consolidation(spark, raw):
    a, b = (landing.read_landed(spark, str(raw / s)) for s in ("a", "b"))
    out = {(r["source"], r["job_id"]): r for r in end_to_end.consolidate(a, b).collect()}
    # First per id and source, null ids as one row, no title dropped; ids of two sources both stay.
    assert set(out) == {("a", "1"), ("a", "2"), ("a", None), ("a", "3"), ("b", "1")}
    assert out["a", "1"]["title"] == "t1" and out["b", "1"]["redirect_url"] == "u"
    assert out["a", "2"]["created_date"] == dt.datetime(2025, 1, 1) and out["a", "3"]["category_label"] == "C"


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_consolidation_run(spark, raw, kind):
    entry = end_to_end.run_consolidation(
        spark, {"adzuna": str(raw / "a"), "remoteok": str(raw / "b")}, str(raw / f"out-{kind}"), dt.datetime(2025, 3, 1), kind
    )
    assert entry["records_in_by_source"] == {"adzuna": 5, "remoteok": 1} and entry["records_in"] == 6
    assert entry["records_read"] == 8 and entry["duration_seconds"] > 0
    assert spark.read.parquet(f"{raw}/out-{kind}_interim/adzuna").count() == 5
    assert entry["records_out"] == 5 and entry["status"] == "success"
    back = spark.read.parquet(str(raw / "out-parquet")) if kind == "parquet" else spark.read.option("header", True).csv(str(raw / "out-csv"))
    assert back.count() == 5


def test_nothing_to_consolidate(spark, tmp_path):
    put(tmp_path / "a/jobs_1.json", [{"id": "1", "title": None, "description": None}])
    entry = end_to_end.run_consolidation(spark, {"adzuna": str(tmp_path / "a")}, str(tmp_path / "out"), dt.datetime(2025, 3, 1))
    assert entry["status"] == "no_data" and entry["output_path"] is None


def test_missing_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="first"):
        tables.read_table(spark, str(tmp_path / "none"), "Run the other job first.")


def test_logs(spark, tmp_path):
    lines = [
        json.dumps({"timestamp": f"2025-01-0{i}T00:00:00", "status": "success", "records_in": i, "records_in_by_source": {"a": i}})
        for i in (1, 3, 2)
    ]
    put(tmp_path / "log/part-1.json", "\n".join([lines[0], "", "{broken", lines[1], lines[2]]))
    log = logs.read_log(spark, str(tmp_path / "log"), PROCESSING_LOG)
    assert sorted(r["records_in"] for r in log.collect()) == [1, 2, 3]
    tail = logs.tail_log(spark, str(tmp_path / "log"), PROCESSING_LOG, 2)
    assert [r["records_in"] for r in tail.collect()] == [3, 2]
    assert logs.read_log(spark, str(tmp_path / "absent"), SEARCH_LOG).count() == 0
    logs.append_log(log.limit(1), str(tmp_path / "log"))
    assert logs.read_log(spark, str(tmp_path / "log"), PROCESSING_LOG).count() == 4


def test_landing_appends(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", "2025-01-01"), ("2", "b", "2025-01-01")], "id string, source string, collect_date string")
    for _ in range(2):
        landing.write_landed(df, str(tmp_path / "raw"))
    assert (tmp_path / "raw/source=a/collect_date=2025-01-01").is_dir()
    assert landing.read_landed_lines(spark, str(tmp_path / "raw")).count() == 4


def test_runs_skip_repeat_and_cap(spark):
    rows = [("r", i, f"{i % 4}", "2025-01-01") for i in range(8)] + [("r", 9, "", "2025-01-01"), ("r", 10, "old", "2020-01-01"), ("s", 4, "x", "2025-01-02")]
    df = spark.createDataFrame(rows, "run string, pos int, id string, created string")
    args = dict(run_keys=["run"], order=["pos"], identifier="id", created="created", as_of="2025-01-05 00:00:00", max_days_old=30)
    assert sorted((r["run"], r["id"]) for r in landing.collect_runs(df, max_jobs=9, **args).collect()) == [("r", "0"), ("r", "1"), ("r", "2"), ("r", "3"), ("s", "x")]
    assert sorted(r["id"] for r in landing.collect_runs(df, max_jobs=2, **args).collect()) == ["0", "1", "x"]


def test_profiles(spark):
    p = landing.profiles_table(spark)
    assert p.count() == 10 and p.agg(F.sum("max_jobs")).first()[0] == 360


def test_model_build(spark, tmp_path, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    jobs = docs.select(
        F.col("doc_id").cast("string").alias("job_id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("company"),
        F.col("text").alias("description"), F.col("lang").alias("category_label"), "source",
    )
    out = end_to_end.build_embeddings(jobs, vectors.HashingEncoder(32))
    assert out.columns == [*vectors.EMBEDDING_METADATA, *vectors.EMBEDDING_VIEWS]
    path = str(tmp_path / "embeddings")
    tables.write_table(out, path)
    for day in (1, 2):
        run = end_to_end.train_clusters(spark, path, str(tmp_path / "model"), dt.datetime(2025, 1, day))
    assert run == "20250102_000000"
    latest = tables.read_latest(spark, str(tmp_path / "model/job_clusters"))
    assert latest.count() == docs.count() and "cluster_id" in latest.columns
    model = tables.load_model(str(tmp_path / "model"), run)
    metrics = spark.read.json(str(tmp_path / "model/metrics")).filter(F.col("run_id") == run).first()
    assert metrics["n_samples"] == docs.count() and metrics["n_clusters"] == model.getK() == 2
    log = end_to_end.embedding_log_entry(jobs, 2.0).first()
    assert log["total_embeddings"] == 4 * docs.count() and log["embeddings_per_second"] == 2.0 * docs.count()
