"""Structured Streaming counterparts of landing, deduplication, metrics and latest state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vacantia.operators.rows import to_canonical
from vacantia.operators.selection import filter_complete, filter_identified
from vacantia.schema import LANDED


def stream_landed(
    spark: SparkSession, directory: str, schema: T.StructType = LANDED, files_per_batch: int = 1_000
) -> DataFrame:
    """Postings from new JSON-lines files below a directory."""
    return (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(directory)
    )


def landed_to_canonical(stream: DataFrame) -> DataFrame:
    """Row-local mapping of landed postings to the canonical schema."""
    canonical = to_canonical(stream)
    return filter_complete(filter_identified(canonical, "job_id"))


def drop_repeats(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str = "7 days") -> DataFrame:
    """First row per key within the watermark delay; later repeats are dropped.

    Repeats inside one Arrow batch go before the shuffle, so that a key with a
    third of all rows does not send them all to the task that holds its state.
    """
    keys = list(keys)

    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.select(keys).to_pandas(types_mapper=pd.ArrowDtype)
            yield batch.filter(pa.array(~named.duplicated().to_numpy()))

    local = stream.mapInArrow(first_rows, stream.schema)
    timed = local.withColumn("event_time", F.col(event_time).cast("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(keys)


def windowed_search_stats(
    stream: DataFrame,
    *,
    event_time: str,
    kind: str,
    duration: str,
    failed: str = "error",
    window: str = "1 hour",
    delay: str = "1 hour",
) -> DataFrame:
    """Count, mean duration and failures per time window and search type."""
    timed = stream.withColumn("event_time", F.col(event_time).cast("timestamp"))
    return (
        timed.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", window).alias("w"), F.col(kind).alias("kind"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(duration).alias("avg_duration"),
            F.count_if(F.col(kind) == failed).alias("errors"),
        )
        .select(F.col("w.start").alias("window_start"), "kind", "n", "avg_duration", "errors")
    )


def append_parquet(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Exactly-once append of new rows."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def update_parquet(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Changed rows of every batch, each batch in its own partition.

    A batch that is run again after a failure overwrites its partition, so the
    table stays exact. newest_values() reads the current value per key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def newest_values(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value of the latest batch per key of an update_parquet() table."""
    values = [c for c in table.columns if c not in keys and c != "batch_id"]
    newest = F.max_by(F.struct(*values), F.col("batch_id")).alias("s")
    return table.groupBy(*keys).agg(newest).select(*keys, "s.*")


def latest_state_stream(stream: DataFrame, key: str, updated_at: str, values: Sequence[str], tie: str | None = None) -> DataFrame:
    """Newest entry per key as a streaming aggregation; state holds one row per key."""
    order = F.struct(updated_at, tie) if tie else F.col(updated_at)
    newest = F.max_by(F.struct(updated_at, *values), order).alias("s")
    return stream.groupBy(key).agg(newest).select(key, "s.*")
