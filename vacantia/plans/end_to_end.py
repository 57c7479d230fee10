"""The end-to-end jobs: consolidate postings, build the model, analyse CVs."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vacantia.operators.oplogs import embedding_run
from vacantia.operators.ranking import keep_first, newest_first
from vacantia.operators.rows import embedding_texts, to_canonical, trim_texts
from vacantia.operators.selection import filter_complete, union_sources
from vacantia.operators.vectors import (
    embed_views,
    find_serving_vector_column,
    predict_clusters,
    squared_silhouette,
    train_kmeans,
    vector_check,
)
from vacantia.sources.landing import read_landed
from vacantia.sources.tables import read_table, run_stamp, save_clusters, write_table


def consolidate(*sources: DataFrame, order: tuple[str, ...] = ("src_file", "src_pos")) -> DataFrame:
    """Canonical postings: first row per id and source, complete, trimmed."""
    return merge(*[first_per_id(s, order) for s in sources])


def first_per_id(source: DataFrame, order: tuple[str, ...] = ("src_file", "src_pos")) -> DataFrame:
    return keep_first(to_canonical(source), ["job_id"], [F.col(c).asc() for c in order])


def merge(*sources: DataFrame) -> DataFrame:
    return trim_texts(filter_complete(union_sources(*sources)))


def run_consolidation(
    spark: SparkSession,
    directories: dict[str, str],
    output: str,
    now: dt.datetime,
    output_format: str = "parquet",
    interim: str | None = None,
) -> dict:
    """Read every source, write the processed table newest first, return the log entry.

    Each source's rows after its own deduplication are written below `interim` (by default
    beside the output) and read from there, and are what records_in counts; records_read counts
    them as landed. Counters are observed while tables are written; nothing is counted twice.
    """
    began = time.monotonic()
    read, counts, sources = {}, {}, []
    for name, path in directories.items():
        seen, kept = Observation(f"read_{name}"), Observation(f"in_{name}")
        landed = read_landed(spark, path).observe(seen, F.count(F.lit(1)).alias("n"))
        first = first_per_id(landed).observe(kept, F.count(F.lit(1)).alias("n"))
        place = f"{interim or output.rstrip('/') + '_interim'}/{name}"
        write_table(first, place)
        read[name], counts[name] = seen.get["n"], kept.get["n"]
        sources.append(spark.read.schema(first.schema).parquet(place))
    out = Observation("out")
    result = newest_first(merge(*sources), "created_date", "job_id")
    result = result.observe(out, F.count(F.lit(1)).alias("n"))
    write_table(result, output, output_format)
    rows_out = out.get["n"]
    return {
        "timestamp": now.isoformat(),
        "status": "success" if rows_out else "no_data",
        "duration_seconds": round(time.monotonic() - began, 3),
        "records_read": sum(read.values()),
        "records_in": sum(counts.values()),
        "records_in_by_source": counts,
        "records_out": rows_out,
        "output_path": output if rows_out else None,
    }


def build_embeddings(jobs: DataFrame, encoder) -> DataFrame:
    return embed_views(embedding_texts(jobs), encoder)


def train_clusters(
    spark: SparkSession, embeddings: str, root: str, now: dt.datetime, wanted: int = 20, seed: int = 42
) -> str:
    """Fit, assign, measure and save; returns the run id."""
    df = read_table(spark, embeddings, "Build the embeddings first.")
    vector = find_serving_vector_column(df)
    check = vector_check(df, vector).first()
    if not check["valid"]:
        raise ValueError(f"vectors do not match rows: {check.asDict()}")
    model = train_kmeans(df, vector, wanted, seed)
    clustered = predict_clusters(df, model, vector)
    sizes = clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    metrics = sizes.agg(
        F.sum("n").alias("n_samples"),
        F.lit(model.getK()).alias("n_clusters"),
        F.lit(float(model.summary.trainingCost)).alias("inertia"),
        F.lit(squared_silhouette(clustered, vector, "cluster_id")).cast("double").alias("silhouette_score"),
        F.map_from_entries(F.collect_list(F.struct("cluster_id", "n"))).alias("cluster_sizes"),
    )
    run = run_stamp(now)
    save_clusters(clustered, model, metrics, root, run)
    return run


def embedding_log_entry(jobs: DataFrame, seconds: float) -> DataFrame:
    """Totals of an embedding run over the postings."""
    n = jobs.agg(F.count(F.lit(1)).alias("n"))
    return n.select(embedding_run(F.col("n"), F.lit(float(seconds))).alias("r")).select("r.*")
