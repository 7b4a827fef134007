"""Scalar quantization to a byte per dimension, and distances to quantized vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvane.functions.distance import Metric


def fit(rows: DataFrame, vector_col: str = "vector") -> DataFrame:
    """One row: ``mins`` and ``scales`` ((max - min) / 255) by dimension; empty for no rows."""
    parts = rows.select(F.posexplode(vector_col).alias("pos", "x")).groupBy("pos").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
    every = F.array_sort(F.collect_list(F.struct("pos", F.col("lo"), ((F.col("hi") - F.col("lo")) / F.lit(255.0)).alias("scale"))))
    return parts.agg(every.alias("d")).select(F.transform("d", lambda s: s["lo"]).alias("mins"), F.transform("d", lambda s: s["scale"]).alias("scales"))


def encode(vector: Column, mins: Column, scales: Column) -> Column:
    """Codes 0..255 (half away from zero, clamped); 0 for a dimension of one value."""
    def code(x: Column, i: Column) -> Column:
        s = F.element_at(scales, i + 1)
        c = F.round(F.try_divide(x.cast("double") - F.element_at(mins, i + 1), s))
        return F.when(s > 0, F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)).cast("int")).otherwise(F.lit(0))

    return F.transform(vector, code)


def decode(codes: Column, mins: Column, scales: Column) -> Column:
    return F.transform(codes, lambda c, i: F.element_at(mins, i + 1) + F.element_at(scales, i + 1) * c)


def adc(metric: Metric | str, query: Column, codes: Column, mins: Column, scales: Column) -> Column:
    """The distance of a full-precision query to a quantized vector."""
    from sparkvane.functions.distance import dot, l2_squared

    there = decode(codes, mins, scales)
    return l2_squared(query, there) if Metric(metric) is Metric.L2 else -dot(query, there) + F.lit(0.0)


def quantized(rows: DataFrame, vector_col: str = "vector") -> DataFrame:
    """``rows`` with ``codes``, ``mins`` and ``scales``; the one row of parameters is broadcast."""
    both = rows.crossJoin(F.broadcast(fit(rows, vector_col)))
    return both.withColumn("codes", encode(F.col(vector_col), F.col("mins"), F.col("scales")))
