"""Filtered search by plan: exact over the matches, or an over-fetching graph search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvane.functions.distance import Metric
from sparkvane.plans.filters import Filter
from sparkvane.plans.planner import Plan, over_fetch, plan

from .ann import EF_SEARCH, search_index
from .search import top_k


def search(base: DataFrame, query: Sequence[float], k: int = 10, where: Filter | None = None, metric: Metric | str = Metric.L2, index: DataFrame | None = None, ef: int = EF_SEARCH) -> tuple[DataFrame, Plan]:
    """``(id, distance)`` and the plan. ``base`` has id, vector and metadata.

    With an index, a filter that many records pass is applied to the candidates of a wider
    graph search; if fewer than ``2 k`` survive, the exact scan answers after all.
    """
    where = where or Filter()
    how = plan(base, where, k)
    if how.arm == "empty":
        return base.limit(0).select("id", F.lit(0.0).alias("distance")), how
    spark = base.sparkSession
    if index is not None and how.arm in ("all", "post"):
        one = spark.createDataFrame([(0, [float(x) for x in query])], "qid long, query array<double>")
        if how.arm == "all":
            return search_index(index, one, k, metric, ef).select("id", "distance"), how
        matching = where.apply(base).select("id")
        wide = over_fetch(k, ef, matching.count() / max(base.count(), 1))
        near = search_index(index, one, wide, metric, wide).select("id", "distance")
        kept = near.join(matching, "id", "left_semi").orderBy("distance", "id").limit(2 * k)
        rows = kept.collect()  # at most 2 k
        if len(rows) >= 2 * k:
            return spark.createDataFrame(rows[:k], kept.schema), how
    return top_k(base, query, k, metric, where), how
