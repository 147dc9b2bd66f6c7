"""Vectors as arrays of doubles, and movement between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclid(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def between(previous: Column, other: Column) -> Column:
    """How much nearer to the other than to the previous state: 1 / (1 + e ** (other - previous))."""
    return 1 / (1 + F.exp(other - previous))


def away(previous: Column, other: Column, apart: Column) -> Column:
    """How far beyond both: a logistic in (other + previous) / apart - 1, at most 100.

    Where the two coincide, a point on them has 0.5 and any other 1.
    """
    ratio = F.least(F.try_divide(other + previous, apart) - 1, F.lit(100.0))
    same = F.when(other + previous == 0, 0.5).otherwise(1.0)
    return F.when(apart == 0, same).otherwise(1 / (1 + F.exp(-ratio)))
