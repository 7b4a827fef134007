"""Distances between vectors as column expressions, in double precision; smaller is closer."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(str, Enum):
    L2 = "l2"  # squared
    DOT = "dot"  # negated
    COSINE = "cosine"  # negated dot product of normalised vectors

    @property
    def requires_normalization(self) -> bool:
        return self is Metric.COSINE


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _sum(F.zip_with(a, b, square))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, F.try_divide(x.cast("double"), n)).otherwise(x.cast("double")))


def distance(metric: Metric | str, a: Column, b: Column) -> Column:
    """Cosine takes vectors as they are and normalises both."""
    metric = Metric(metric)
    if metric is Metric.L2:
        return l2_squared(a, b)
    if metric is Metric.DOT:
        return -dot(a, b) + F.lit(0.0)
    length = norm(a) * norm(b)
    return F.when(length > 0, -F.try_divide(dot(a, b), length) + F.lit(0.0)).otherwise(F.lit(0.0))
