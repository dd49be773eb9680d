"""Arithmetic on vectors held as arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(wide(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def add(a: Column, b: Column, weight: float = 1.0) -> Column:
    return F.zip_with(wide(a), wide(b), lambda x, y: x + y * F.lit(weight))


def mean(vectors: list[Column]) -> Column:
    total = wide(vectors[0])
    for v in vectors[1:]:
        total = add(total, v)
    return F.transform(total, lambda x: x / F.lit(float(len(vectors))))


def softmax(values: Column) -> Column:
    """Shifted by the largest value, so no exponent overflows."""
    raised = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))
