"""Columnar tables, versioned artifacts and saved cluster models."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_table(df: DataFrame, path: str, output_format: str = "parquet") -> None:
    """Overwrite a Parquet (zstd) or CSV table; arrays become JSON text in CSV."""
    if output_format == "parquet":
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return
    nested = ("array", "map", "struct")
    flat = df.select(
        *[
            (F.to_json(c) if kind.startswith(nested) else F.col(c)).alias(c)
            for c, kind in df.dtypes
        ]
    )
    flat.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


#: Quotes inside a value are doubled and values may hold newlines; blanks at their ends stay.
CSV_OPTIONS = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that write_table wrote as CSV."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def read_table(spark: SparkSession, path: str, hint: str = "") -> DataFrame:
    """Parquet table; a missing path is reported with what to run first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no table at {path}. {hint}".strip()) from error


def run_stamp(now: dt.datetime) -> str:
    return now.strftime("%Y%m%d_%H%M%S")


def write_version(df: DataFrame, path: str, run_id: str) -> None:
    """Add one version of a table as a partition of its own."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").option(
        "compression", "zstd"
    ).parquet(path)


def latest_version(versions: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Rows of the lexicographically greatest run; prunes to its partition when laid out by run."""
    newest = versions.agg(F.max(run_id).alias("newest")).scalar()
    return versions.filter(F.col(run_id) == newest)


def read_latest(spark: SparkSession, path: str, hint: str = "") -> DataFrame:
    return latest_version(read_table(spark, path, hint))


def save_clusters(
    clustered: DataFrame, model: KMeansModel, metrics: DataFrame, root: str, run_id: str
) -> None:
    """Clustered table, model and metrics under one run id."""
    write_version(clustered, f"{root}/job_clusters", run_id)
    model.write().overwrite().save(f"{root}/models/{run_id}")
    metrics.withColumn("run_id", F.lit(run_id)).write.mode("append").json(f"{root}/metrics")


def load_model(root: str, run_id: str) -> KMeansModel:
    return KMeansModel.load(f"{root}/models/{run_id}")


def write_clustered(df: DataFrame, path: str, cluster: str = "cluster_id") -> None:
    """A serving table with one partition per cluster; a large cluster's rows are written by all tasks that hold them."""
    df.write.mode("overwrite").partitionBy(cluster).option("compression", "zstd").parquet(path)


MANIFEST = "run_id string, artifact string, path string, rows long"


def save_run(spark: SparkSession, root: str, run_id: str, artifacts: dict[str, DataFrame]) -> None:
    """Tables of one run, committed as one: the manifest that names them is written last.

    A run that stops before has no manifest and is not seen by readers; saving it again
    overwrites what it left.
    """
    counted = {}
    for name, table_ in artifacts.items():
        seen = Observation(f"saved_{name}")
        path = f"{root}/{name}/run_id={run_id}"
        table_.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd").parquet(path)
        counted[name] = (path, seen.get["n"])
    entries = [(run_id, name, path, n) for name, (path, n) in counted.items()]
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifests/{run_id}")


def committed_runs(spark: SparkSession, root: str) -> DataFrame:
    """Manifest entries of all complete runs; a root without any has none."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{root}/manifests")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def load_run(spark: SparkSession, root: str, run_id: str | None = None) -> dict[str, DataFrame]:
    """The tables of a complete run, by default of the latest."""
    runs = committed_runs(spark, root)
    wanted = run_id if run_id is not None else runs.agg(F.max("run_id")).first()[0]
    entries = runs.filter(F.col("run_id") == wanted).collect() if wanted is not None else []
    if not entries:
        raise FileNotFoundError(f"no complete run {run_id or ''} below {root}")
    return {e["artifact"]: spark.read.parquet(e["path"]) for e in entries}
