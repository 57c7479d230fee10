"""Row-local expressions on array columns, evaluated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.bind import once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def squared_norm(a: Column) -> Column:
    return F.aggregate(
        a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector is all zeros."""
    scale = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.coalesce(F.try_divide(dot(a, b), scale), F.when(a.isNotNull() & b.isNotNull(), 0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")),
        F.lit(0.0),
        lambda acc, d: acc + d * d,
    )


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def unit(a: Column) -> Column:
    """L2-normalised vector; an all-zero vector stays as it is."""

    def scaled(norm: Column) -> Column:
        return F.transform(
            a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double"))
        )

    return once(F.sqrt(squared_norm(a)), scaled)
