"""Column builders on vectors of floats: summed in order as doubles, inside code generated by Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either is null, of no length, or the lengths differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), 1 - dot(a, b) / size)


def l2_squared(a: Column, b: Column) -> Column:
    difference = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(difference, F.lit(0.0), lambda s, x: s + x * x))


def distance_score(distance: Column) -> Column:
    """A distance of 0 to 2 as a score of 1 to 0, clamped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2))
