"""Vector expressions that stay in the JVM; for pairs of moderate number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def proximity(i: Column, j: Column, sigma: float) -> Column:
    return F.exp(-F.pow((i - j).cast("double"), F.lit(2.0)) / (2.0 * sigma * sigma))


def blend(cos: Column, near: Column, weight: float) -> Column:
    return F.round(weight * F.greatest(F.lit(0.0), cos) + (1.0 - weight) * near, 6)


def least_gap(a: Column, b: Column) -> Column:
    """The least distance between an id of one list and one of the other, null if either has none."""
    return F.array_min(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: F.abs(x - y)))))


def list_proximity(a: Column, b: Column, sigma: float) -> Column:
    """Nearness of two nodes that stand for several chunks each, 0 if either has none."""
    return F.coalesce(F.exp(-F.pow(least_gap(a, b).cast("double"), F.lit(2.0)) / (2.0 * sigma * sigma)), F.lit(0.0))
