"""Links to components, and shared buckets to links, without collecting either."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialize

#: A key with more than ``1/HUBS`` of all rows, and ``HOT_ROWS``, is hot; there are fewer than ``HUBS``.
HUBS, HOT_ROWS = 512, 500
#: Links that one task joins in memory, about 150 bytes each; it reads them by ``CHUNK``.
LINKS, CHUNK = 1 << 21, 1 << 19


def _hot(key: str) -> Column:
    return F.expr(f"approx_top_k({key}, {2 * HUBS}, {32 * HUBS})")


def hot_keys(rows: DataFrame, key: str) -> tuple[int, list[int]]:
    """(number of rows, hot values of an integer column), by a mergeable heavy-hitter sketch; its
    error only steers where rows go."""
    n, top = rows.agg(F.count("*"), _hot(key)).first()
    return n, _hottest(n, top)


def _hottest(n: int, top: list | None) -> list[int]:
    return [r.item for r in top or [] if r.item is not None and r["count"] > max(HOT_ROWS, n // HUBS)]


def attach(rows: DataFrame, values: DataFrame, on: str | list[str], hot: list[int]) -> DataFrame:
    """``rows`` joined with ``values``, which has one row per key. Keys whose first column is in
    ``hot`` are joined by broadcast, so no task gets all rows of one."""
    on = [on] if isinstance(on, str) else on
    if not hot:
        return rows.join(values, on)
    is_hot = F.col(on[0]).isin(hot)
    return rows.where(is_hot).join(F.broadcast(values.where(is_hot)), on).unionByName(rows.where(~is_hot).join(values.where(~is_hot), on))


def with_sides(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with the columns of ``side(node, ..)`` of either, named ``a_..`` and ``b_..``;
    ``a`` may be the same node very often."""
    names = [c for c in side.columns if c != "node"]
    pairs = materialize(pairs, "pairs")
    _, hot = hot_keys(pairs, "a")
    of_a, of_b = (side.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in names]) for x in "ab")
    return attach(pairs.join(of_b, "b"), of_a, "a", hot)


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links ``(u, v)``, sorted, and the smallest node that links reach from each."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def _stars(links: DataFrame, names: tuple[str, str], itself: bool) -> DataFrame:
    """The links ``(u, v)`` of each partition, as one from each node to the smallest it reaches there;
    ``itself``: also of that smallest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        new = 0

        def join() -> None:
            held[0], held[1] = ([x] for x in least_reached(*map(np.concatenate, held)))

        for batch in batches:
            for own, c in zip(held, ("u", "v")):
                own.append(batch.column(c).to_numpy(zero_copy_only=False))
            new += batch.num_rows
            if new >= CHUNK:
                join()
                new = 0
        join()
        keep = slice(None) if itself else held[0][0] != held[1][0]
        out = pa.RecordBatch.from_arrays([pa.array(x[0][keep]) for x in held], list(names))
        yield from (out.slice(i, 1 << 16) for i in range(0, out.num_rows, 1 << 16))

    return links.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node that links reach) of every node in
    ``links(a, b)``.

    Each partition joins its own links first, which leaves fewer of them than it has nodes. Up to
    ``LINKS`` of what remains are joined by one task. More are joined by several tasks of about
    ``LINKS`` each as long as that halves them, and else by :func:`_alternating`.
    """
    links = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = materialize(_stars(links, ("u", "v"), False), "links")
    n, before = links.count(), None
    while n > LINKS and (before is None or 2 * n <= before):
        links = materialize(_stars(links.coalesce(-(-n // max(1, LINKS))), ("u", "v"), False), "links")
        n, before = links.count(), n
    return _stars(links.coalesce(1), ("node", "component"), True) if n <= LINKS else _alternating(links)


def _alternating(links: DataFrame) -> DataFrame:
    """:func:`components` of ``links(u, v)``, ``u`` the larger, by alternating large and small stars.

    Minima are combined before they are shuffled, and those of hubs reach their links by
    broadcast; each round is a table, and rounds end when the links stand still.
    """
    links = materialize(links.distinct(), "links")
    seen = None
    while True:
        both = links.union(links.select("v", "u"))
        *now, top = both.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long")), _hot("u")).first()
        if now == seen or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v")).distinct()
        seen, hot = now, _hottest(now[0], top)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = attach(both.where("v > u"), least, "u", hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "links")
        # a node has no more rows here than before
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = attach(large, least, "u", hot).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        links = materialize(small.union(least.select("u", "m")).distinct(), "links")


def bucket_members(keys: DataFrame) -> DataFrame:
    """``key``, ``node``, ``pivot`` (the smallest node of the key) of ``keys(key, node)``, for keys of
    two nodes or more. ``keys`` is a table: it is read more than once."""
    buckets = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    return materialize(attach(keys, buckets, "key", hot_keys(keys, "key")[1]), "members")


def remaining(members: DataFrame, found: DataFrame, block: int) -> DataFrame | None:
    """What pivots leave open: the nodes of a bucket but its pivot, if they are in more than
    one component of ``found``. ``group``, ``key``, ``node``, ``part`` (component); buckets of more than
    ``block`` nodes are dealt over blocks, of which each two meet in a group of their own;
    others share groups. None if there is nothing."""
    rest = members.where("node != pivot").join(found, "node", "left")
    rest = materialize(rest.select("key", "node", F.coalesce("component", "node").alias("part")), "rest")
    sizes = rest.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    rest = materialize(attach(rest, sizes.select("key", F.ceil(F.col("n") / block).alias("blocks")), "key", hot_keys(rest, "key")[1]), "rest")
    n = rest.count()
    if not n:
        return None
    dealt = rest.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shared = F.pmod(F.xxhash64("key"), F.lit(max(1, 2 * n // block)))
    group = F.when(F.col("blocks") == 1, shared).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return dealt.select(group.alias("group"), "key", "node", "part")


def link_buckets(keys: DataFrame, verify: Callable[[DataFrame], DataFrame], meet: Callable[[DataFrame], DataFrame], block: int) -> DataFrame:
    """``node``, ``component`` of the nodes that are linked, of all pairs of nodes that share a
    key in ``keys(key, node)``.

    Pairs of a bucket are not listed. First each node meets the smallest node of each of its
    buckets: ``verify`` gets and returns ``(a, b)``. What these links join needs no more looks
    within; what is :func:`remaining` goes to ``meet``, which returns links ``(a, b)`` between
    the components of a bucket. Every pair that shares a bucket is thus linked, in one
    component already, or refused.
    """
    members = bucket_members(keys)
    pairs = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    found = materialize(components(verify(pairs)), "found")
    rest = remaining(members, found, block)
    if rest is None:
        return found
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(meet(rest)))


def least_ids(nodes: DataFrame, found: DataFrame, twice: DataFrame) -> DataFrame:
    """``node``, ``component_id``: the smallest id that links reach, of every node.

    ``nodes(node, least)`` has each node's smallest id; ``found(node, component)`` comes from links
    and ``twice(a, b)`` holds nodes that share an id.
    """
    found = materialize(found, "found")
    if not twice.isEmpty():
        found = materialize(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(twice)), "found")
    of = nodes.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return attach(of.select("node", "component"), ids, "component", hot_keys(found, "component")[1]).select("node", "component_id")


def sharing(rows: DataFrame, nodes: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """``(a, b)``: nodes that share an id. ``rows`` has ``id_col`` and the key columns that make a
    node; ``nodes`` has ``node`` and these. Few ids have more than one node."""
    several = F.lit(False)
    for k in keys:
        several = several | (F.col(f"_low_{k}") < F.col(f"_high_{k}"))
    twice = rows.groupBy(id_col).agg(*[F.min(k).alias(f"_low_{k}") for k in keys], *[F.max(k).alias(f"_high_{k}") for k in keys]).where(several).select(id_col)
    pairs = materialize(rows.select(id_col, *keys).join(twice, id_col, "left_semi").distinct().join(nodes.select("node", *keys), keys).select(id_col, "node"), "sharing")
    first = pairs.groupBy(id_col).agg(F.min("node").alias("a"))
    return attach(pairs, first, id_col, hot_keys(pairs, id_col)[1]).where("a != node").select("a", F.col("node").alias("b"))
