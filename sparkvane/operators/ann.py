"""Approximate search: an immutable neighbour graph per segment, searched in fan-out.

A segment (of bounded size) is one row: ids, vectors and links. Links of a node are chosen
among its nearest so that none is closer to a chosen one than to the node, filled up to
``m`` with the rest, and made mutual up to twice that. A search walks each segment's graph
with a beam of ``ef`` and merges the segments' results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sparkvane.functions.distance import Metric

from .search import blocks, exact, ranked, unit

M, EF_CONSTRUCTION, EF_SEARCH, SEGMENT_ROWS = 16, 200, 50, 20_000
#: Distances between rows of a segment that are held at once (8 MB), and queries whose results are.
DISTANCES, ANSWERS = 1 << 20, 256


def _near(metric: Metric, x: np.ndarray, a: int, b: int) -> np.ndarray:
    s = x[a:b] @ x.T
    s *= -1
    if metric is Metric.L2:
        s *= 2
        s += (x * x).sum(1)
        s += (x[a:b] * x[a:b]).sum(1)[:, None]
    return s


def build_links(x: np.ndarray, metric: Metric, m: int = M, ef: int = EF_CONSTRUCTION) -> np.ndarray:
    """Neighbours of each row, as a matrix filled with -1."""
    n = len(x)
    chosen: list[list[int]] = []
    step = max(1, DISTANCES // max(1, n))
    for a in range(0, n, step):
        d = _near(metric, x, a, min(n, a + step))
        e = min(n - 1, ef)
        for i, row in enumerate(d, a):
            row[i - 0] = np.inf
            near = np.argpartition(row, e - 1)[:e] if 0 < e < n else np.zeros(0, np.int64)
            near = near[np.argsort(row[near], kind="stable")]
            among = ((x[near][:, None] - x[near][None]) ** 2).sum(2) if metric is Metric.L2 and len(near) <= 64 else None
            kept: list[int] = []
            rest: list[int] = []
            for p, j in enumerate(near.tolist()):
                if len(kept) == m:
                    break
                if not kept:
                    kept.append(j)
                    continue
                to = among[p][[int(np.flatnonzero(near == q)[0]) for q in kept]] if among is not None else exact(metric, x[kept], x[j])
                (kept if (to > row[j]).all() else rest).append(j)
            chosen.append(kept + rest[: m - len(kept)])
    links = [set(c) for c in chosen]
    for i, c in enumerate(chosen):
        for j in c:
            if len(links[j]) < 2 * m:
                links[j].add(i)
    out = np.full((n, 2 * m), -1, np.int32)
    for i, c in enumerate(links):
        out[i, : len(c)] = sorted(c)
    return out


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, metric: Metric, ef: int) -> list[tuple[float, int]]:
    seen = set(entries.tolist())
    d = exact(metric, x[entries], q)
    todo = [(v, int(i)) for v, i in zip(d.tolist(), entries)]
    heapq.heapify(todo)
    best = [(-v, -i) for v, i in todo]
    heapq.heapify(best)
    while len(best) > ef:
        heapq.heappop(best)
    while todo:
        v, i = heapq.heappop(todo)
        if len(best) >= ef and v > -best[0][0]:
            break
        new = [j for j in links[i].tolist() if j >= 0 and j not in seen]
        if not new:
            continue
        seen.update(new)
        for w, j in zip(exact(metric, x[new], q).tolist(), new):
            if len(best) < ef or w < -best[0][0]:
                heapq.heappush(todo, (w, j))
                heapq.heappush(best, (-w, -j))
                if len(best) > ef:
                    heapq.heappop(best)
    return sorted((-v, -i) for v, i in best)


def build_index(base: DataFrame, metric: Metric | str = Metric.L2, id_col: str = "id", vector_col: str = "vector", m: int = M, ef_construction: int = EF_CONSTRUCTION, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per segment: ``segment``, ``ids``, ``vectors``, ``links`` (bytes), ``dim``."""
    metric = Metric(metric)
    segments = max(1, -(-base.count() // segment_rows))
    rows = base.select(F.pmod(F.xxhash64(id_col), F.lit(segments)).cast("int").alias("segment"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        x = unit(x) if metric is Metric.COSINE else x
        return pa.table({"segment": t["segment"][:1].cast(pa.int32()), "ids": pa.array([t["id"].to_numpy().tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary()), "links": pa.array([build_links(x, metric, m, ef_construction).tobytes()], pa.binary()), "dim": pa.array([x.shape[1]], pa.int32())})

    return rows.groupBy("segment").applyInArrow(build, "segment int, ids binary, vectors binary, links binary, dim int")


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, metric: Metric | str = Metric.L2, ef: int = EF_SEARCH, qid_col: str = "qid", query_col: str = "query", m: int = M) -> DataFrame:
    """``(qid, id, distance, rank)``; ``ef`` is at least ``k``. The query set is broadcast."""
    metric = Metric(metric)
    asked = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(query_col).cast("array<double>").alias("query"))
    got = list(blocks(asked, LongType()))
    ids = [i for block, _ in got for i in block.to_pylist()]
    q = np.concatenate([x for _, x in got]) if got else np.zeros((0, 0))
    shared = index.sparkSession.sparkContext.broadcast((ids, unit(q) if metric is Metric.COSINE and len(q) else q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        for b in batches:
            for i in range(b.num_rows):
                own, dim = np.frombuffer(b.column("ids")[i].as_py(), np.int64), b.column("dim")[i].as_py()
                x = np.frombuffer(b.column("vectors")[i].as_py(), np.float64).reshape(-1, dim)
                links = np.frombuffer(b.column("links")[i].as_py(), np.int32).reshape(len(x), -1)
                entries = np.unique(np.linspace(0, len(x) - 1, min(len(x), 8)).astype(np.int64))
                for a in range(0, len(qids), ANSWERS):
                    out = [(n, int(own[j]), v) for n, y in zip(qids[a : a + ANSWERS], q[a : a + ANSWERS]) for v, j in beam(x, links, y, entries, metric, max(ef, k))[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["qid", "id", "distance"])

    return ranked(index.mapInArrow(scan, "qid long, id long, distance double"), k)
