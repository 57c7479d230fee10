"""JSON scans that keep well-formed records only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def reader_with_corrupt(reader: DataFrameReader, schema: T.StructType) -> DataFrameReader:
    fields = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return reader.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)


def well_formed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.filter(F.col(CORRUPT).isNull() & reads(schema.fieldNames()[0])).drop(CORRUPT)


def reads(column: str) -> Column:
    """Always true, but keeps a data column in the scan.

    Spark refuses a JSON scan that is pruned to the corrupt-record column, as a
    plain count() would be.
    """
    return F.length(F.coalesce(F.col(column).cast("string"), F.lit(""))) >= 0
