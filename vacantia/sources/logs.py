"""Append-only JSON-lines logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vacantia.operators.ranking import last_entries
from vacantia.sources.json_files import reader_with_corrupt, well_formed


def append_log(df: DataFrame, directory: str) -> None:
    df.write.mode("append").json(directory)


def read_log(spark: SparkSession, directory: str, schema: T.StructType) -> DataFrame:
    """All well-formed entries; blank and malformed lines are left out, a missing log is empty."""
    try:
        entries = reader_with_corrupt(spark.read, schema).json(directory)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return well_formed(entries, schema)


def tail_log(spark: SparkSession, directory: str, schema: T.StructType, n: int) -> DataFrame:
    """The n newest entries by timestamp, newest first."""
    return last_entries(read_log(spark, directory, schema), "timestamp", n)
