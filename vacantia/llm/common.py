"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{folder}/{table}.parquet")
    return frame.select(*columns) if columns else frame


def byte_texts(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) in slices of about ``limit`` bytes; null is empty, no text is cut."""
    column = column.cast(pa.binary())
    start, size = 0, 0
    for row, length in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        size += length
        if size >= limit or row + 1 == len(column):
            yield start, [x or b"" for x in column.slice(start, row + 1 - start).to_pylist()]
            start, size = row + 1, 0


#: Names of the text column inside a task: dropped after its use, or passed on.
TEXT, KEPT_TEXT = "__text", "__kept_text"


def chosen(frame: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...], made: tuple[str, ...]) -> DataFrame:
    """Id and text under fixed names, and the columns to pass on but for those an operator makes."""
    passed = [F.col(f"`{c}`") for c in keep if c not in made and c != text_col]
    text = KEPT_TEXT if text_col in keep and text_col not in made else TEXT
    return frame.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias(text), *passed)


def named(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return frame.withColumnsRenamed({"__id": id_col, KEPT_TEXT: text_col})


def text_of(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(TEXT if TEXT in batch.schema.names else KEPT_TEXT)


def passed_on(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.select([n for n in batch.schema.names if n != TEXT])
