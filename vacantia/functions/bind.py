"""Evaluate a value once per row and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value bound to a lambda variable.

    Expressions inside higher-order functions are not shared by the code
    generator, so a costly value written twice is computed twice.
    """
    return F.get(F.transform(F.array(value), body), 0)
