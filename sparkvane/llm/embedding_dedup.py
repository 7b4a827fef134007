"""Embedding near-dedup with spherical-cap filters.

A filter direction is the concatenation of one codeword from each block of a random product
code; there are ``size ** blocks`` of them, never listed. A vector is list-decoded to all
directions whose inner product with it exceeds ``alpha``: blocks are joined one by one, and
partial sums that even the best rest cannot lift to ``alpha`` go. Vectors that share a
direction are candidates and are verified in double precision.

``alpha`` and the number of directions follow the number of vectors: a direction is expected
to hold ``PER_FILTER`` unrelated vectors, a vector to be in ``FILTERS`` directions of each of
``CODES`` codes. How many it is in depends on how its length falls on a code's blocks, so
each code has a random rotation of its own; with one code alone, one pair in ten of cosine
0.95 was lost, with eight none of 1,500.

Each vector of a bucket is compared with the bucket's first. Those that this leaves in several
components are compared with each other by matrix products, in blocks; no pairs are listed.

Degrees are counted within components, where all links are: vectors within half the angle
of the component's centroid are all linked, which needs no comparison; the others are
compared with the whole component, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import attach, hot_keys, least_ids, link_buckets, sharing, with_sides
from ._spark import materialize, ship

PER_FILTER, FILTERS, CODES = 0.05, 16, 8
BLOCK, MEET = 1024, 512
#: Numbers that the codes a worker keeps may have, and the scores of one block at a time.
HELD, SCORES = 1 << 24, 1 << 22


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(float64 values with NaN for nulls, offsets) of a list column."""
    column = column.cast(pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def units(rows: DataFrame) -> DataFrame:
    """``vec_id``, ``unit``: the vector over its norm as float64 bytes, or null if the vector is
    null, empty, zero, or has components that are null or not finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = _flat(b.column("embedding"))
            out = []
            for i, missing in enumerate(b.column("embedding").is_null().to_pylist()):
                x = flat[offsets[i] : offsets[i + 1]]
                top = np.abs(x).max() if len(x) and not missing else 0
                if top > 0 and np.isfinite(top):
                    x = x / top  # no overflow in the norm
                    out.append((x / math.sqrt(x @ x)).tobytes())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "unit"])

    return rows.mapInArrow(run, "vec_id long, unit binary")


class Code:
    """A product code for ``n`` vectors of ``d`` dimensions."""

    def __init__(self, n: int, d: int, number: int):
        p = min(0.05, PER_FILTER / max(n, 1))
        self.alpha = NormalDist().inv_cdf(1 - p)
        total = FILTERS / p
        # always two: with three, filters fall so unevenly on vectors that near pairs share none
        self.blocks = min(d, 2)
        self.size = math.ceil(total ** (1 / self.blocks))
        rng = np.random.default_rng((11, d, number))
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        self.parts = np.array_split(np.arange(d), self.blocks)
        self.words = [rng.normal(size=(len(x), self.size)) for x in self.parts]

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Per row of ``x`` (unit vectors), the numbers of all directions beyond alpha."""
        x = x @ self.rotation
        scores = [x[:, p] @ w for p, w in zip(self.parts, self.words)]
        best = np.stack([s.max(1) for s in scores], 1)
        rest = best[:, ::-1].cumsum(1)[:, ::-1]
        out = []
        for i in range(len(x)):
            total, number = np.zeros(1), np.zeros(1, np.int64)
            for k, s in enumerate(scores):
                need = self.alpha - (rest[i, k + 1] if k + 1 < self.blocks else 0)
                own = np.flatnonzero(s[i] >= need - total.max(initial=-np.inf)) if len(total) else np.zeros(0, np.int64)
                added = total[:, None] + s[i][own]
                a, b = np.nonzero(added >= need)
                total, number = added[a, b], number[a] * self.size + own[b]
            out.append(number)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _keys(nodes: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[int, int], Code] = {}
        for b in batches:
            size = np.array([len(x) // 8 for x in b.column("unit").to_pylist()], np.int64)
            for d in np.unique(size).tolist():
                own = b.filter(pa.array(size == d))
                for i in range(CODES):
                    code = codes.get((d, i)) or Code(n, d, i)
                    if CODES * d * code.size <= HELD:
                        codes[d, i] = code  # larger ones are made anew for each batch
                    rows = max(1, min(512, SCORES // code.size))
                    for a in range(0, own.num_rows, rows):
                        part = own.slice(a, rows)
                        got = code.decode(_matrix(part.column("unit")))
                        count = np.array([len(y) for y in got])
                        # code and dimension are part of the key: only vectors of one dimension meet
                        key = (np.concatenate(got) * CODES + i) * 65537 + d
                        yield pa.RecordBatch.from_arrays([pa.array(key), part.column("node").take(pa.array(np.repeat(np.arange(len(got)), count)))], ["key", "node"])

    return nodes.mapInArrow(run, "key long, node long")


def _centroids(of: DataFrame) -> DataFrame:
    """``component``, ``centre`` (unit, bytes) from sums that each task has combined."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, (own, at) = _padded(b.column("unit"))[0], np.unique(b.column("component").to_numpy(), return_inverse=True)
                total = np.zeros((len(own), x.shape[1]))
                np.add.at(total, at, x)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(total), pa.list_(pa.float64()))], ["component", "total"])

    parts = of.select("component", "unit").mapInArrow(sums, "component long, total array<double>")
    parts = parts.select("component", F.posexplode("total").alias("pos", "x")).groupBy("component", "pos").agg(F.sum("x").alias("x"))
    return parts.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre"))


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, filled up with zeros to one dimension; their own dimensions)."""
    rows = column.to_pylist()
    dim = np.array([len(x) // 8 for x in rows], np.int64)
    if len(rows) and (dim == dim[0]).all():
        return _matrix(column), dim
    out = np.zeros((len(rows), dim.max(initial=0)))
    for i, x in enumerate(rows):
        out[i, : dim[i]] = np.frombuffer(x, np.float64)
    return out, dim


def _core(of: DataFrame, threshold: float) -> DataFrame:
    """Adds ``core``: within half the threshold's angle of the centre."""
    half = math.cos(math.acos(threshold) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            core = []
            for x, c in zip(b.column("unit").to_pylist(), b.column("centre").to_pylist()):
                x, c = np.frombuffer(x, np.float64), np.array(c)[: len(x) // 8]
                core.append(bool(x @ c >= half * math.sqrt(c @ c)))
            yield pa.RecordBatch.from_arrays([b.column("component"), b.column("node"), b.column("weight"), b.column("unit"), pa.array(core, pa.bool_())], ["component", "node", "weight", "unit", "core"])

    return of.mapInArrow(run, "component long, node long, weight long, unit binary, core boolean")


def _meet(t: pa.Table, threshold: float) -> pa.Table:
    """Links between the components (``part``) of each bucket of a table."""
    key, node, part = (t[c].to_numpy() for c in ("key", "node", "part"))
    x, dim = _padded(t["unit"].combine_chunks())
    order = np.lexsort((node, key))
    order = order[np.append(True, (np.diff(key[order]) != 0) | (np.diff(node[order]) != 0))[: len(order)]]  # a block that meets itself
    first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)[: len(order)])
    size = np.diff(np.append(first, len(order)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in np.unique(size[size > 1]).tolist():
        step = max(1, (1 << 20) // (s * max(s, x.shape[1])))
        buckets = first[size == s]
        for i in range(0, len(buckets), step):
            own = order[buckets[i : i + step, None] + np.arange(s)]
            y, label, d = x[own], part[own], dim[own]
            hit = (y @ y.transpose(0, 2, 1) >= threshold) & (label[:, :, None] < label[:, None, :]) & (d[:, :, None] == d[:, None, :])
            at, p, q = np.nonzero(hit)
            # one link for two components of a bucket is enough
            _, few = np.unique(np.stack([at, label[at, p], label[at, q]]), axis=1, return_index=True)
            a.append(node[own[at[few], p[few]]])
            b.append(node[own[at[few], q[few]]])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _degrees(of: DataFrame, threshold: float) -> DataFrame:
    """``node``, ``linked``: the weight of the other nodes that a node is linked with.
    ``of``: component, node, weight, unit, of components of two nodes or more."""
    of = materialize(_core(of.join(_centroids(of), "component"), threshold), "members")
    # within the core all are linked
    inner = of.where("core").groupBy("component").agg(F.sum("weight").alias("all"))
    linked = of.where("core").join(inner, "component").select("node", (F.col("all") - F.col("weight")).alias("linked"))
    # the others against all, in blocks
    sizes = of.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("ka"), F.ceil(F.count_if(~F.col("core")) / BLOCK).alias("kr")).where("kr > 0")
    dealt = of.join(sizes, "component").withColumn("h", F.xxhash64("node"))
    rest = dealt.where("not core").select("component", F.pmod("h", "kr").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("j"), F.lit(0).alias("side"), "node", "weight", "unit", "core")
    every = dealt.select("component", F.explode(F.sequence(F.lit(0), F.col("kr") - 1)).alias("i"), F.pmod("h", "ka").alias("j"), F.lit(1).alias("side"), "node", "weight", "unit", "core")

    def run(t: pa.Table) -> pa.Table:
        side = t["side"].to_numpy()
        node, weight, core = (t[c].to_numpy() for c in ("node", "weight", "core"))
        x = _matrix(t["unit"].combine_chunks())
        r, a = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hit = (x[r] @ x[a].T >= threshold) & (node[r][:, None] != node[a])
        mine, theirs = hit @ weight[a], hit.T @ weight[r]
        inner = np.flatnonzero(core[a])
        return pa.table({"node": np.concatenate([node[r], node[a][inner]]), "linked": np.concatenate([mine, theirs[inner]])})

    crossed = rest.unionByName(every).groupBy("component", "i", "j").applyInArrow(run, "node long, linked long")
    return linked.unionByName(crossed).groupBy("node").agg(F.sum("linked").alias("linked"))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per vector row: ``vec_id``, ``n_links`` (other vectors of cosine ``threshold`` or
    more), ``component_id`` (the smallest id that links reach), ``kept`` (this id is it).

    Vectors that are null, empty or zero, or have components that are null or not finite,
    link with nothing; so do vectors of different dimensions with each other. Rows that
    repeat an id count as vectors of their own, with links of their own, but are in one
    component. A row without id links with nothing and is kept. A cosine of exactly
    ``threshold`` links. Ids are integers. Other columns are not read.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    made = materialize(units(rows).withColumns({"h1": F.xxhash64("unit"), "h2": F.xxhash64(F.lit("unit"), F.col("unit"))}), "units")
    valid = made.where(F.col("unit").isNotNull() & F.col("vec_id").isNotNull())
    # equal vectors are one node, numbered in a table that later steps read
    equal = valid.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("unit").alias("unit"))
    nodes = materialize(equal.withColumn("node", F.monotonically_increasing_id()), "nodes")
    units_of = nodes.select("node", "unit")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cosine = np.array([x @ y if len(x) == len(y) else -1.0 for x, y in ((np.frombuffer(p, np.float64), np.frombuffer(q, np.float64)) for p, q in zip(b.column("a_unit").to_pylist(), b.column("b_unit").to_pylist()))])
                yield b.filter(pa.array(cosine >= threshold)).select(["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        return with_sides(pairs, units_of).select("a", "b", "a_unit", "b_unit").mapInArrow(confirm, "a long, b long")

    def run(t: pa.Table) -> pa.Table:
        return _meet(t, threshold)

    def meet(rest: DataFrame) -> DataFrame:
        return rest.join(units_of, "node").groupBy("group").applyInArrow(run, "a long, b long")

    keys = materialize(_keys(units_of, nodes.count()), "keys")  # decoding is not done twice
    found = materialize(link_buckets(keys, verify, meet, MEET), "found")
    degrees = _degrees(nodes.join(found, "node").select("component", "node", "weight", "unit"), threshold)
    named = least_ids(nodes.select("node", "least"), found, sharing(valid.select("vec_id", "h1", "h2"), nodes, "vec_id", ["h1", "h2"]))
    of = nodes.drop("unit").join(named, "node").join(degrees, "node", "left")
    of = of.select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    ok = F.col("unit").isNotNull() & F.col("vec_id").isNotNull()
    out = attach(made.where(ok).select("vec_id", "h1", "h2"), of, ["h1", "h2"], hot_keys(valid, "h1")[1]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(made.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE vector AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
unit AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM vector
    WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM unit p JOIN unit q ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
    WHERE list_inner_product(p.v, q.v) / (p.n * q.n) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.id LEFT JOIN degree d ON e.vec_id = d.a
"""
