"""Exact k-nearest-neighbour search, ordered by (distance, id)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkvane.functions.distance import Metric, distance
from sparkvane.plans.filters import Filter

#: Queries that one pass over the base holds in a broadcast variable; more go in blocks.
QUERY_BLOCK = 4096
#: Rows and queries that are multiplied at once, components of pairs that are compared at once, and
#: results that a task holds before it passes them on: a few dozen MB at any number of rows and queries.
ROWS, COLUMNS, PAIRS, HELD = 2048, 512, 1 << 20, 1 << 19
#: What a distance by products may be off, as a share of the square of both lengths' sum.
SLACK = 1e-9


class DimensionError(ValueError):
    pass


def top_k(base: DataFrame, query: Sequence[float], k: int = 10, metric: Metric | str = Metric.L2, where: Filter | None = None,
          id_col: str = "id", vector_col: str = "vector", dim: int | None = None) -> DataFrame:
    """``(id, distance)`` of the ``k`` records nearest to one query; all for a larger ``k``.

    Records without a vector, or whose vector has null components, are not found. A record of
    another dimension than the query is an error.
    """
    if dim is not None and len(query) != dim:
        raise DimensionError(f"the query has {len(query)} dimensions, not {dim}")
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = sound(where.apply(base) if where else base, vector_col, len(query))
    rows = rows.select(F.col(id_col).alias("id"), distance(metric, F.col(vector_col), q).alias("distance"))
    return rows.orderBy("distance", "id").limit(k)


def sound(base: DataFrame, vector_col: str, dim: int) -> DataFrame:
    """Records with a vector of ``dim`` components, none null. Other dimensions raise when they are read."""
    v = F.col(vector_col)
    wrong = F.raise_error(F.concat(F.lit(f"DimensionError: queries have {dim} dimensions, a record "), F.size(v).cast("string")))
    fits = F.when(F.size(v) == dim, ~F.exists(v, lambda x: x.isNull())).otherwise(wrong.cast("boolean"))
    return base.where(v.isNotNull() & F.when(v.isNotNull(), fits).otherwise(False))


def allowed(base: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Records whose id is in ``ids``."""
    return base.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_semi")


def alive(base: DataFrame, tombstones: DataFrame, id_col: str = "id") -> DataFrame:
    """Records whose id is not in ``tombstones``."""
    return base.join(tombstones.select(F.col(tombstones.columns[0]).alias(id_col)), id_col, "left_anti")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query, of ``(qid, id, distance)``, with ``rank`` from 1."""
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_nearest(parts: Sequence[DataFrame], k: int) -> DataFrame:
    """The union of results of several sources: an id counts once, by its least distance."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return ranked(union.groupBy("qid", "id").agg(F.min("distance").alias("distance")), k)


def exact(metric: Metric, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of rows of ``x`` to one query; cosine expects normalised rows."""
    return ((x - q) ** 2).sum(1) if metric is Metric.L2 else -(x @ q) + 0.0


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(-1, keepdims=True))
    return np.where(n > 0, x / np.where(n > 0, n, 1), x)


def matrix_of(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column without nulls as a matrix; rows of different lengths are an error."""
    size = np.diff(column.offsets.to_numpy())
    dim = int(size[0]) if dim is None and len(size) else dim or 0
    if (size != dim).any():
        raise DimensionError(f"queries have {dim} dimensions, a record {size[size != dim][0]}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _first(query: np.ndarray, far: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of each query's ``k`` nearest by (distance, id), not a number last, and for each place whether it is its
    query's ``k``-th. Ids of kinds that Arrow may order unlike Spark leave ties at the ``k``-th."""
    t, last = ids.type, np.isnan(far)
    known = pa.types.is_integer(t) or pa.types.is_string(t) or pa.types.is_binary(t) or pa.types.is_decimal(t) or pa.types.is_temporal(t)
    keys = {"query": query, "last": last.astype(np.int8), "far": np.where(last, 0.0, far)} | ({"id": ids} if known else {})
    order = pc.sort_indices(pa.table(keys), sort_keys=[(c, "ascending") for c in keys], null_placement="at_start").to_numpy()
    own = query[order]
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(own)))
    at = np.arange(len(own)) - np.repeat(begin, size)
    keep = at < k
    if not known:
        value = np.where(last, np.inf, far)[order]
        keep |= value <= np.repeat(value[begin + np.minimum(size, k) - 1], size)
    return order[keep], (at == k - 1)[keep]


def nearest(batches: Iterator[pa.RecordBatch], ids: pa.Array, q: np.ndarray, k: int, metric: Metric) -> Iterator[pa.RecordBatch]:
    """``qid``, ``id``, ``distance`` of the ``k`` nearest rows of all batches to each query (``q`` as rows, with
    ``ids``), and of a few more; memory depends on ``ROWS``, ``COLUMNS``, ``PAIRS`` and ``HELD`` only.

    Products find the rows that may be nearer than the ``k``-th so far (``cut``); these are compared exactly.
    """
    if k <= 0 or not len(q):
        return
    length = np.sqrt((q * q).sum(1))
    cut = np.full(len(q), np.inf)
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
    count, bound = 0, min(HELD, max(1 << 16, 2 * k * len(q)))

    def out() -> pa.RecordBatch:
        query, far, own = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held])
        keep, is_last = _first(query, far, own, k)
        query, far, own = query[keep], far[keep], own.take(pa.array(keep))
        cut[query[is_last]] = np.fmin(cut[query[is_last]], far[is_last])
        held[:] = [(query, far, own)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(query)), own, pa.array(far)], ["qid", "id", "distance"])

    for b in batches:
        for a in range(0, b.num_rows, ROWS):
            rows = b.slice(a, ROWS)
            x = matrix_of(rows.column("vector"), q.shape[1])
            x = unit(x) if metric is Metric.COSINE else x
            square = (x * x).sum(1)
            for c in range(0, len(q), COLUMNS):
                y, most = q[c : c + COLUMNS], cut[c : c + COLUMNS]
                near = y @ x.T
                near *= -1
                if metric is Metric.L2:
                    near *= 2
                    near += square
                    near += (length[c : c + COLUMNS] ** 2)[:, None]
                slack = SLACK * (1 + (length[c : c + COLUMNS] + np.sqrt(square.max())) ** 2)
                # not a number is never beyond the limit
                may = ~(near > (most + slack)[:, None])
                if len(x) > k and may.sum() > 2 * k * len(y):
                    may &= ~(near > (np.partition(near, k - 1, axis=1)[:, k - 1] + slack)[:, None])
                query, row = np.nonzero(may)
                step = max(1, PAIRS // max(1, q.shape[1]))
                for i in range(0, len(row), step):
                    r, n = row[i : i + step], query[i : i + step]
                    far = ((x[r] - y[n]) ** 2).sum(1) if metric is Metric.L2 else -(x[r] * y[n]).sum(1) + 0.0
                    ok = ~(far > most[n])
                    held.append(((n[ok] + c).astype(np.int32), far[ok], rows.column("id").take(pa.array(r[ok]))))
                    count += int(ok.sum())
                    if count > bound:
                        found = out()
                        count = found.num_rows
                        if 4 * count > 3 * bound:
                            # too many to hold; the limits stay
                            yield found
                            held.clear()
                            count = 0
    if held:
        yield out()


def blocks(asked: DataFrame, kind) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, matrix) of at most ``QUERY_BLOCK`` queries at a time; a partition of queries is the most the
    driver holds besides."""
    held: list = []
    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            yield _block(held, kind)
            held = []
    if held:
        yield _block(held, kind)


def _block(held: list, kind) -> tuple[pa.Array, np.ndarray]:
    dim = len(held[0][1])
    for _, q in held:
        if len(q) != dim:
            raise DimensionError(f"queries have {dim} and {len(q)} dimensions")
    return pa.array([r[0] for r in held], to_arrow_type(kind)), np.array([r[1] for r in held], np.float64)


def knn_batch(base: DataFrame, queries: DataFrame, k: int = 10, metric: Metric | str = Metric.L2, id_col: str = "id", vector_col: str = "vector", qid_col: str = "qid", query_col: str = "query") -> DataFrame:
    """``(qid, id, distance, rank)`` for every query.

    Queries are broadcast in blocks of bounded size, one after the other as the driver reads
    them; each task multiplies its rows with a block and passes on about ``k`` rows a query (see
    :func:`nearest`), so what is shuffled does not grow with the base's rows but with its
    partitions. Queries and records without a vector or with null components are not
    matched; two dimensions are an error.
    """
    metric = Metric(metric)
    qid_type = queries.schema[qid_col].dataType
    asked = queries.select(F.col(qid_col).alias("qid"), F.col(query_col).cast("array<double>").alias("query"))
    asked = asked.where(F.col("query").isNotNull() & ~F.exists("query", lambda x: x.isNull()))
    rows = base.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    schema = f"qid {qid_type.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, distance double"
    found = base.sparkSession.createDataFrame([], schema)
    for ids, matrix in blocks(asked, qid_type):
        shared = base.sparkSession.sparkContext.broadcast((ids, unit(matrix) if metric is Metric.COSINE else matrix))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from nearest(batches, *shared.value, k, metric)

        found = found.unionByName(rows.mapInArrow(scan, schema))
    return ranked(found, k)
