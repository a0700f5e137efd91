"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance
