"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import decimal
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6) + 0.0
    if isinstance(value, bool):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def spark_rows(df):
    order = sorted(df.columns)
    return order, sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)


def duck_rows(con, sql):
    rel = con.sql(sql)
    order = sorted(rel.columns)
    index = [rel.columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in index) for r in rel.fetchall()), key=key)


def difference(df, con, sql, timed=False):
    """None when equal, else a short description; with timed=True also the Spark seconds."""
    start = time.time()
    columns, ours = spark_rows(df)
    seconds = time.time() - start
    problem = _difference(columns, ours, *duck_rows(con, sql))
    return (problem, seconds) if timed else problem


def _difference(columns, ours, expected_columns, expected):
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if len(ours) != len(expected):
        return f"rows {len(ours)} != {len(expected)}"
    for a, b in zip(ours, expected):
        if a != b:
            return f"{columns}: {str(a)[:600]} != {str(b)[:600]}"
    return None if ours else "no rows"
