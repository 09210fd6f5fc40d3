"""Vector expressions, exact, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector is at distance 1 from all."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / size)


def largest_delta(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def is_unit(v: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(norm(v) - 1) <= tolerance + 1e-5
