"""Ground truth, recall and latency figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import knn_batch

ground_truth = knn_batch


def recall_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``recall``: the mean over queries of hits among the first ``k`` over min(k, truth's size);
    1.0 without queries or truth. Both are ``(qid, id, rank)``."""

    def first(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("rank") <= k).groupBy("qid").agg(F.collect_set("id").alias(name))

    both = first(truth, "want").join(first(results, "got"), "qid", "left")
    hits = F.size(F.array_intersect("want", F.coalesce("got", F.array().cast(both.schema["want"].dataType))))
    return both.agg(F.coalesce(F.avg(hits / F.least(F.lit(k), F.size("want"))), F.lit(1.0)).alias("recall"))


def latency(seconds: DataFrame, column: str) -> DataFrame:
    """Nearest-rank p50 and p99, and the mean."""
    return seconds.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})").alias("p50"), F.expr(f"percentile_disc(0.99) WITHIN GROUP (ORDER BY {column})").alias("p99"), F.avg(column).alias("mean"))
