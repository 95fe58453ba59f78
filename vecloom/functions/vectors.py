"""Vector algebra as column functions, and block distances for hot loops.

Distances are squared L2, as everywhere in this engine; thresholds compare with them. ``euclidean`` gives the root.
All functions return null when an argument is null; ``checked`` raises on a wrong dimension.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def add(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: a.cast("double") + b.cast("double"))


def sub(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: a.cast("double") - b.cast("double"))


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scale(v: Column, s: float | Column) -> Column:
    return F.transform(v, lambda a: a.cast("double") * (s if isinstance(s, Column) else F.lit(float(s))))


def sq_dist(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a.cast("double") - b.cast("double")), F.lit(0.0), lambda s, x: s + x * x)


def euclidean(u: Column, v: Column) -> Column:
    return F.sqrt(sq_dist(u, v))


def splat(x: float | Column, dim: int | Column) -> Column:
    return F.array_repeat(x if isinstance(x, Column) else F.lit(float(x)), dim if isinstance(dim, Column) else F.lit(dim))


def least_element(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: F.least(a, b))


def greatest_element(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: F.greatest(a, b))


def equal(u: Column, v: Column) -> Column:
    return u == v


def position(v: Column) -> Column:
    """x and y of a 2-D vector (null where absent)."""
    return F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y"))


def checked(v: Column, dim: int) -> Column:
    """The vector itself; raises when its dimension is not ``dim`` or an element is null."""
    bad = (F.size(v) != dim) | F.exists(v, lambda a: a.isNull())
    return F.when(v.isNotNull() & bad, F.raise_error(F.lit(f"invalid size: expected {dim} elements"))).otherwise(v)
