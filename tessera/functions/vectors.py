"""Vector arithmetic on arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def unit(v: Column) -> Column:
    """Divided by its length; the zero vector stays."""
    return F.transform(v, lambda x: x / F.when(norm(v) > 0, norm(v)).otherwise(F.lit(1.0)))


def unit_eps(v: Column, eps: float = 1e-12) -> Column:
    return F.transform(v, lambda x: x / (norm(v) + eps))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; null if either vector is zero."""
    return F.when((norm(a) > 0) & (norm(b) > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))


def padded(v: Column, zeros: int) -> Column:
    """The vector with zeros after it, which changes no linear map fitted on it."""
    return F.concat(v, F.array_repeat(F.lit(0.0), zeros))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b|; 0 for two empty sets."""
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
