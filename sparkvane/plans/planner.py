"""Statistics of metadata and the choice of how to run a filtered search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvane.functions.metadata import Field

from .filters import Eq, Filter, Range

BUCKETS = 64
SCAN_FACTOR, SCAN_FRACTION, OVER_FETCH, FETCH_CAP = 16, 0.05, 5, 8


def postings(df: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """``value`` (as a grouping key), ``ids`` sorted and ``n`` of each value of a field."""
    rows = df.select(Field(df, key).key().alias("value"), F.col(id_col).alias("id")).where("value is not null")
    return rows.groupBy("value").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("n"))


def facet_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows of each value of a field; counted before they are shuffled."""
    return df.select(Field(df, key).key().alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def eq_cardinality(df: DataFrame, where: Filter) -> DataFrame:
    """``upper``: the least number of records that one of the Eq predicates matches."""
    counts = [F.count_if(p.column(df)) for p in where.must if isinstance(p, Eq)]
    upper = F.least(*counts) if len(counts) > 1 else counts[0] if counts else F.count("*")
    return df.agg(upper.alias("upper"))


def histogram(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` (from 1), ``lo``, ``hi`` of all numbers, and ``n``: equal widths from least to greatest."""
    values = df.select(Field(df, key).number.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = values.crossJoin(F.broadcast(bounds))  # one row
    number = F.least(F.coalesce(F.expr(f"width_bucket(v, lo, hi, {buckets})"), F.lit(1)), F.lit(buckets))
    return rows.groupBy(number.cast("int").alias("bucket"), "lo", "hi").agg(F.count("*").alias("n"))


def range_estimate(counts: DataFrame, low: float, high: float, buckets: int = BUCKETS) -> DataFrame:
    """``lower`` and ``upper`` bounds of the records in a closed range, from a histogram:
    whole buckets within it, and all that it touches."""
    width = (F.col("hi") - F.col("lo")) / buckets
    a, b = F.col("lo") + (F.col("bucket") - 1) * width, F.col("lo") + F.col("bucket") * width
    # bounds of buckets are rounded: a little more is touched, a little less is inside
    slack = F.abs(width) * 1e-9
    inside = (a - slack >= F.lit(float(low))) & (b + slack <= F.lit(float(high)))
    touched = (b + slack >= F.lit(float(low))) & (a - slack <= F.lit(float(high)))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return counts.agg(total(inside).alias("lower"), total(touched).alias("upper"))


def enumerate_range(df: DataFrame, key: str, low: float, high: float, id_col: str = "id") -> DataFrame:
    """Ids in a closed range, by value."""
    f = Field(df, key)
    return df.where(f.within(low, high)).select(F.col(id_col).alias("id"), f.number.alias("value")).orderBy("value", "id")


def count_up_to(df: DataFrame, where: Filter, limit: int) -> int | None:
    """The number of matches, or None if there are more than ``limit``; each partition stops early."""
    n = where.apply(df).limit(limit + 1).count()
    return n if n <= limit else None


@dataclass(frozen=True)
class Plan:
    arm: str  # all, empty, scan or post
    matches: int | None
    limit: int


def plan(df: DataFrame, where: Filter, k: int, n: int | None = None) -> Plan:
    """Without a filter all records; else an exact filtered scan if at most max(16 k, 5 % of
    the records) match (counted exactly, up to that limit), else a search that over-fetches."""
    if k <= 0:
        return Plan("empty", 0, 0)
    if not where.must:
        return Plan("all", None, 0)
    if any(isinstance(p, Range) and p.min is not None and p.max is not None and p.min > p.max for p in where.must):
        return Plan("empty", 0, 0)
    n = df.count() if n is None else n
    limit = max(SCAN_FACTOR * k, int(SCAN_FRACTION * n))
    found = count_up_to(df, where, limit)
    return Plan("empty" if found == 0 else "scan" if found is not None else "post", found, limit)


def over_fetch(k: int, ef: int, share: float) -> int:
    """How many candidates to fetch for a filter that this share of the records passes."""
    return int(min(max(OVER_FETCH * k / max(share, 1e-9), ef, 2 * k), max(FETCH_CAP * ef, 4 * k)))
