import json
import os
import shutil
import subprocess
import sys
import tracemalloc
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkvane import queries as engine
from sparkvane.functions.distance import Metric, distance, normalize
from sparkvane.operators import ann, evaluate, filtered, quantize, search
from sparkvane.plans import planner
from sparkvane.plans.filters import Eq, Filter, Range
from sparkvane.sources import vectors
from sparkvane.streaming import store

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def vecs(spark, n, dim, seed=42):
    rng = np.random.default_rng(seed)
    rows = rng.uniform(-1, 1, (n, dim))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id long, vector array<double>"), rows


def test_distances_and_zero_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 2.0], [3.0, -1.0])], "a array<double>, b array<double>")
    got = df.select(*[distance(m, F.col("a"), F.col("b")).alias(m.value) for m in Metric], normalize(F.col("a")).alias("n"), normalize(F.col("b")).alias("z")).collect()
    assert got[0].l2 == 25 and got[0].dot == 0 and got[0].cosine == 0 and got[0].n == [0.6, 0.8] and got[0].z == [0, 0]
    assert got[1].l2 == 13 and got[1].dot == -1 and abs(got[1].cosine + 1 / np.sqrt(50)) < 1e-12


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_batch_equals_single_and_numpy(spark, metric):
    df, x = vecs(spark, 500, 16)
    qs, q = vecs(spark, 5, 16, 43)
    got = search.knn_batch(df, qs.toDF("qid", "query"), 10, metric).orderBy("qid", "rank").collect()
    for i in range(5):
        d = ((x - q[i]) ** 2).sum(1) if metric == "l2" else -(x @ q[i]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q[i]) if metric == "cosine" else 1)
        want = np.lexsort((np.arange(500), d))[:10].tolist()
        assert [r.id for r in got if r.qid == i] == want
        assert [r.id for r in search.top_k(df, q[i], 10, metric).collect()] == want


def test_ties_edges_and_dimension(spark):
    df = spark.createDataFrame([(3, [1.0]), (1, [1.0]), (2, [5.0])], "id long, vector array<double>")
    assert [r.id for r in search.top_k(df, [1.0], 2).collect()] == [1, 3]
    assert search.top_k(df, [1.0], 0).collect() == [] and search.top_k(df, [1.0], 9).count() == 3
    assert search.top_k(df.limit(0), [1.0], 3).collect() == []
    with pytest.raises(search.DimensionError):
        search.top_k(df, [1.0, 2.0], 1, dim=1)


def test_null_and_ragged_vectors(spark):
    df = spark.createDataFrame([(1, [5.0]), (2, None), (3, [None]), (4, [1.0])], "id long, vector array<double>")
    assert [r.id for r in search.top_k(df, [0.0], 3).collect()] == [4, 1]
    one = spark.createDataFrame([("q", [0.0]), ("none", None)], "qid string, query array<double>")
    assert [(r.qid, r.id) for r in search.knn_batch(df, one, 3).orderBy("rank").collect()] == [("q", 4), ("q", 1)]
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 9.0])], "id long, vector array<double>").coalesce(1)
    two = spark.createDataFrame([(0, [1.0, 2.0])], "qid long, query array<double>")
    for found in (search.knn_batch(ragged, two, 2), search.top_k(ragged, [1.0, 2.0], 2)):
        with pytest.raises(Exception, match="DimensionError"):
            found.collect()
    assert search.knn_batch(df, two.limit(0), 2).collect() == []


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    df, x = vecs(spark, 40, 4)
    got = search.knn_batch(df, df.toDF("qid", "query"), 1).collect()
    assert sorted((r.qid, r.id) for r in got) == [(i, i) for i in range(40)]


def _peak(run) -> float:
    """MB that ``run`` holds at most."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("metric", list(Metric))
def test_batch_search_holds_tiles_only(metric):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(30_000, 8)), rng.normal(size=(search.QUERY_BLOCK, 8))
    x[20_000:20_100] = x[:100]  # ties between batches
    q = search.unit(q) if metric is Metric.COSINE else q
    batch = lambda a: pa.RecordBatch.from_arrays([pa.array(range(a, a + 10_000)), pa.array(list(x[a : a + 10_000]))], ["id", "vector"])
    batches, found = [batch(a) for a in (0, 10_000, 20_000)], []
    assert _peak(lambda: found.extend(search.nearest(iter(batches), pa.array(range(len(q))), q, 10, metric))) < 120  # one block of distances was 134
    got = pa.Table.from_batches(found).sort_by([("qid", "ascending"), ("distance", "ascending"), ("id", "ascending")])
    assert got.num_rows == 10 * len(q)
    x = search.unit(x) if metric is Metric.COSINE else x
    for i in range(0, len(q), 500):
        far = search.exact(metric, x, q[i])
        assert got["id"].to_pylist()[10 * i : 10 * i + 10] == np.lexsort((np.arange(len(x)), far.round(12)))[:10].tolist()


def test_batch_search_passes_on_what_it_cannot_hold(monkeypatch):
    monkeypatch.setattr(search, "HELD", 100)
    x, q = np.zeros((5_000, 2)), np.zeros((40, 2))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5_000)), pa.array(list(x))], ["id", "vector"])
    got = pa.Table.from_batches(search.nearest(iter([batch]), pa.array(range(40)), q, 10, Metric.L2)).sort_by([("qid", "ascending"), ("id", "ascending")])
    for i in range(40):
        assert got.filter(pa.compute.equal(got["qid"], i))["id"].to_pylist()[:10] == list(range(10))


def test_not_a_number_comes_last(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, [nan, 1.0]), (1, [3.0, 0.0]), (2, [1.0, 0.0]), (3, [float("inf"), 0.0])], "id long, vector array<double>").coalesce(1)
    q = spark.createDataFrame([(7, [0.0, 0.0])], "qid long, query array<double>")
    assert [r.id for r in search.knn_batch(df, q, 4).orderBy("rank").collect()] == [2, 1, 3, 0]
    assert [r.id for r in search.knn_batch(df, q, 1).collect()] == [2]


def test_graph_is_built_from_few_distances_at_once():
    x = np.random.default_rng(5).normal(size=(6000, 4))
    assert _peak(lambda: ann.build_links(x, Metric.L2, m=4, ef=8)) < 45  # 512 rows and all others were 77


def test_filter_truth_table(spark):
    rows = ['{"x":3}', '{"x":3.0}', '{"x":"3"}', '{"x":true}', "{}", None, '{"a.b":1}', '{"x":null}', '{"x":-0.0}']
    df = spark.createDataFrame(list(enumerate(rows)), "id int, m string").select("id", F.try_parse_json("m").alias("metadata"))

    def ids(*must):
        return sorted(r.id for r in Filter(must).apply(df).collect())

    assert ids(Eq("x", 3)) == ids(Eq("x", 3.0)) == [0, 1] and ids(Eq("x", "3")) == [2] and ids(Eq("x", True)) == [3]
    assert ids() == list(range(9)) and ids(Eq("a.b", 1)) == [6] and ids(Range("x", 0, 3)) == [0, 1, 8] and ids(Range("x", 5, 1)) == []
    assert ids(Range("x", None, 2.5)) == [8] and ids(Eq("x", 3), Range("x", 4, None)) == [] and ids(Eq("x", float("nan"))) == []
    plain = spark.createDataFrame([(1, float("nan"), True), (2, 2.0, False)], "id int, v double, b boolean")
    assert Filter((Eq("v", float("nan")),)).apply(plain).count() == 0 and Filter((Eq("b", 1),)).apply(plain).count() == 0
    assert Filter.from_json(Filter((Eq("x", 3), Range("y", 1, None))).to_json()) == Filter((Eq("x", 3), Range("y", 1, None)))
    with pytest.raises(ValueError):
        Filter.from_json({"must": [{"op": "or"}]})


def test_planner_arms_and_histogram(spark):
    df = spark.range(2000).select("id", F.col("id").alias("v"))
    for m, arm in ((1, "scan"), (160, "scan"), (161, "post"), (0, "empty")):
        assert planner.plan(df, Filter((Range("v", 0, m - 1),)), 10).arm == arm
    counts = planner.histogram(df, "v")
    assert counts.agg(F.sum("n")).first()[0] == 2000
    for lo, hi in ((0, 10), (100, 999), (1500, 5000), (7, 7)):
        r = planner.range_estimate(counts, lo, hi).first()
        assert r.lower <= df.where(F.col("v").between(lo, hi)).count() <= r.upper
    assert planner.histogram(df.withColumn("v", F.lit(5)), "v").first()["bucket"] == 1
    assert planner.count_up_to(df, Filter((Range("v", 0, 9),)), 10) == 10 and planner.count_up_to(df, Filter((Range("v", 0, 10),)), 10) is None


def test_quantizer(spark):
    df, x = vecs(spark, 300, 8)
    df = df.withColumn("vector", F.concat("vector", F.array(F.lit(2.0))))
    got = quantize.quantized(df).select("vector", "scales", quantize.decode(F.col("codes"), F.col("mins"), F.col("scales")).alias("back"), "codes").collect()
    for r in got:
        assert sum((a - b) ** 2 for a, b in zip(r.vector, r.back)) <= sum((s / 2) ** 2 for s in r.scales) + 1e-9 and r.codes[-1] == 0


def test_graph_recall_and_filtered_search(spark):
    df, _ = vecs(spark, 1200, 16)
    df = df.withColumn("g", F.col("id") % 2)
    qs, q = vecs(spark, 20, 16, 43)
    qs = qs.toDF("qid", "query")
    index = ann.build_index(df, segment_rows=700).cache()
    assert index.count() == 2
    assert evaluate.recall_at_k(ann.search_index(index, qs, 10, ef=100), search.knn_batch(df, qs, 10), 10).first()[0] >= 0.95
    where = Filter((Eq("g", 1),))
    found, how = filtered.search(df, q[0], 10, where, index=index, ef=100)
    want = [r.id for r in search.top_k(df, q[0], 10, where=where).collect()]
    assert how.arm == "post" and len({r.id for r in found.collect()} & set(want)) >= 9
    assert [r.id for r in filtered.search(df, q[0], 10, Filter((Range("id", 0, 30),)), index=index)[0].collect()] == [r.id for r in search.top_k(df, q[0], 10, where=Filter((Range("id", 0, 30),))).collect()]


@pytest.mark.parametrize("name", ["ann_topk", "quant_recall"])
def test_recall_rests_on_every_fiftieth_row(spark, monkeypatch, name):
    seen = []
    batch, walk = search.knn_batch, ann.search_index
    monkeypatch.setattr(search, "knn_batch", lambda base, queries, *a, **b: seen.append((queries, b)) or batch(base, queries, *a, **b))
    monkeypatch.setattr(ann, "search_index", lambda index, queries, *a, **b: seen.append((queries, b)) or walk(index, queries, *a, **b))
    assert engine.QUERIES[name](spark, "/root/testdata/sf0.1").first().recall_holds
    assert len(seen) == 2
    for queries, options in seen:
        assert sorted(r.qid for r in queries.select("qid").collect()) == list(range(0, 2000, 50)) and not options


def test_recall_edges(spark):
    empty = spark.createDataFrame([], "qid long, id long, rank int")
    assert evaluate.recall_at_k(empty, empty, 10).first()[0] == 1.0
    truth = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], empty.schema)
    assert evaluate.recall_at_k(truth.where("id = 1"), truth, 10).first()[0] == 0.5


def test_vector_files(spark, tmp_path):
    vectors.register(spark)
    rows = np.arange(40, dtype=np.float32).reshape(10, 4)
    raw = vectors.to_bytes(rows)
    (tmp_path / "a.fvecs").write_bytes(raw)
    got = spark.read.format("fvecs").option("rowsPerPartition", 3).load(str(tmp_path / "a.fvecs")).orderBy("id").collect()
    assert [r.vector for r in got] == rows.tolist()
    assert spark.read.format("fvecs").option("limit", 3).load(str(tmp_path / "a.fvecs")).count() == 3
    assert vectors.read_shared(spark, str(tmp_path / "a.fvecs")).count() == 10
    (tmp_path / "b.fvecs").write_bytes(vectors.to_bytes(rows[:3] + 100))
    (tmp_path / "c.fvecs").write_bytes(b"")
    (tmp_path / "d.fvecs").write_bytes(raw)
    got = vectors.read_shared(spark, str(tmp_path / "*.fvecs")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(23)) and [r.vector for r in got] == [*rows.tolist(), *(rows[:3] + 100).tolist(), *rows.tolist()]
    near = np.arange(12, dtype=np.int32).reshape(4, 3) - 5
    (tmp_path / "n.ivecs").write_bytes(np.concatenate([np.full((4, 1), 3, np.int32), near], 1).astype("<i4").tobytes())
    for got in (spark.read.format("ivecs").option("rowsPerPartition", 3).load(str(tmp_path / "n.ivecs")), vectors.read_shared(spark, str(tmp_path / "n.ivecs"), "int")):
        assert [tuple(r) for r in got.orderBy("id").collect()] == list(enumerate(near.tolist()))
    for bad in (raw[:-3], raw + vectors.to_bytes(rows[:1, :2]), b"\0\0\0\0", raw[:2]):
        with pytest.raises(vectors.VectorFileError):
            vectors.parse(bad)
    assert len(vectors.parse(raw[:-3], first=3)) == 3
    a, b = (vectors.random_vectors(spark, 50, 6).repartition(n).orderBy("id").collect() for n in (1, 7))
    assert a == b and all(-1 <= x < 1 for r in a for x in r.vector)


def test_collection(spark, tmp_path):
    def rows(*r):
        return spark.createDataFrame(r, "id long, vector array<float>, metadata string")

    def ids(*r):
        return spark.createDataFrame([(i,) for i in r], "id long")

    c = store.Collection(spark, f"file://{tmp_path}/c", 2)
    c.insert(rows((1, [1.0, 2.0], '{"v":1}'), (2, [0.0, 0.0], None)))
    for bad, error in ((rows((1, [0.0, 0.0], None)), store.DuplicateId), (rows((5, [0.0, 0.0], None), (5, [0.0, 0.0], None)), store.DuplicateId), (rows((6, [1.0], None)), store.WrongDimension)):
        with pytest.raises(error):
            c.insert(bad)
    with pytest.raises(store.MissingId):
        c.delete(ids(9))
    c.delete(ids(1))
    assert c.checkpoint() == 1
    c.insert(rows((1, [9.0, 9.0], '{"v":2}')))
    c.insert(rows((3, [3.0, 3.0], None)))
    again = store.Collection(spark, f"file://{tmp_path}/c", 77, "dot")
    assert (again.dim, again.metric, again.count(), again.replayed["applied"]) == (2, Metric.L2, 3, 2)
    assert [r.id for r in Filter((Eq("v", 2),)).apply(again.live()).collect()] == [1] and again.get(1).first()["vector"] == [9.0, 9.0]
    (tmp_path / "c/log/notes.txt").write_text("mine")
    # a damaged commit ends the log, also for sound commits after it
    again.insert(rows((4, [4.0, 4.0], None)))
    (tmp_path / "c/log/000000000004.json").write_text("{}")
    cut = store.Collection(spark, f"file://{tmp_path}/c", 2)
    assert sorted(r.id for r in cut.live().collect()) == [1, 2] and "commit 4" in cut.replayed["truncated"]
    cut.max_segments = 1
    cut.checkpoint()
    cut.verify()
    cut.compact()
    assert sorted(r.id for r in store.Collection(spark, f"file://{tmp_path}/c", 2).live().collect()) == [1, 2]
    assert (tmp_path / "c/log/notes.txt").exists() and len(list((tmp_path / "c/segments").iterdir())) == 1
    assert cut.stats().first()["len"] == 2
    (tmp_path / "c/manifest.json").write_text(json.dumps({"check": 1, "body": {}}))
    with pytest.raises(store.StoreError):
        store.Collection(spark, f"file://{tmp_path}/c", 2)


def _ids(c):
    return sorted(r.id for r in c.live().collect())


def test_crash_at_every_step(spark, tmp_path, monkeypatch):
    """A writer dies before or after each change of files; reopening shows the state before or
    after the operation, loses nothing that was noted, and goes on."""
    class Dead(Exception):
        pass

    def rows(*ids):
        return spark.createDataFrame([(i, [float(i)], None) for i in ids], "id long, vector array<float>, metadata string")

    first = f"file://{tmp_path}/first"
    c = store.Collection(spark, first, 1, max_segments=1)
    c.insert(rows(1, 2))
    c.checkpoint()
    c.insert(rows(3))
    cases = {"insert": (lambda c: c.insert(rows(4)), {(1, 2, 3), (1, 2, 3, 4)}), "checkpoint": (lambda c: c.checkpoint(), {(1, 2, 3)})}
    steps = {"insert": (("_write", 1), ("_write_json", 1)), "checkpoint": (("_write", 1), ("_write", 2), ("_write_json", 1), ("collect_garbage", 1))}
    for name, (run, allowed) in cases.items():
        for method, nth in steps[name]:
            for after in (False, True):
                place = tmp_path / f"{name}-{method}-{after}-{nth}"
                shutil.copytree(tmp_path / "first", place)
                c = store.Collection(spark, f"file://{place}", 1, max_segments=1)
                calls, real = [], getattr(store.Collection, method)

                def dying(self, *a, real=real, calls=calls, after=after, nth=nth, **k):
                    calls.append(1)
                    if len(calls) == nth and not after:
                        raise Dead
                    out = real(self, *a, **k)
                    if len(calls) == nth:
                        raise Dead
                    return out

                with monkeypatch.context() as m:
                    m.setattr(store.Collection, method, dying)
                    try:
                        run(c)
                    except Dead:
                        pass
                before = sorted(str(x) for x in place.rglob("*"))
                again = store.Collection(spark, f"file://{place}", 1, max_segments=1)
                assert tuple(_ids(again)) in allowed and before == sorted(str(x) for x in place.rglob("*"))
                again.insert(rows(9))
                assert 9 in _ids(store.Collection(spark, f"file://{place}", 1))


def test_damage_is_kept_apart(spark, tmp_path):
    def rows(*ids):
        return spark.createDataFrame([(i, [float(i)], None) for i in ids], "id long, vector array<float>, metadata string").coalesce(1)

    path = f"file://{tmp_path}/c"
    c = store.Collection(spark, path, 1)
    for i in (1, 2, 3):
        c.insert(rows(i))
    (bad,) = (tmp_path / "c/log/000000000002").glob("*.parquet")
    bad.write_bytes(bad.read_bytes()[:-1] + b"x")
    (bad.parent / f".{bad.name}.crc").unlink()
    for _ in range(2):  # reading changes nothing
        c = store.Collection(spark, path, 1)
        assert _ids(c) == [1] and "commit 2" in c.replayed["truncated"]
    c.insert(rows(7))
    assert _ids(store.Collection(spark, path, 1)) == [1, 7]
    assert len(list((tmp_path / "c/quarantine").rglob("*.parquet"))) == 2
    c.checkpoint()
    (segment,) = (tmp_path / "c/segments").iterdir()
    part = max(segment.glob("*.parquet"), key=lambda x: x.stat().st_size)
    raw = part.read_bytes()
    part.write_bytes(raw[:-9] + bytes([raw[-9] ^ 1]) + raw[-8:])
    (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(store.StoreError):
        store.Collection(spark, path, 1).verify()
    part.write_bytes(raw[:-9])
    with pytest.raises(store.StoreError):
        store.Collection(spark, path, 1)
    for x in (tmp_path / "c").glob("*manifest*"):
        x.unlink()
    with pytest.raises(store.StoreError, match="no manifest"):
        store.Collection(spark, path, 1)
    assert segment.exists()


def test_search_of_a_collection(spark, tmp_path):
    df, x = vecs(spark, 300, 8)
    c = store.Collection(spark, f"file://{tmp_path}/c", 8, seal_rows=1000, sync="group:20")
    c.insert(df.withColumn("metadata", F.format_string('{"g":%d}', F.col("id") % 3)))
    live = {i: v for i, v in enumerate(x.astype(np.float32).astype(float))}

    def want(q, k, ids):
        return sorted(ids, key=lambda i: (((live[i] - q) ** 2).sum(), i))[:k]

    q = x[5] + 0.01
    assert [r.id for r in c.search(q, 10).collect()] == want(q, 10, live)
    json_filter = {"must": [{"op": "eq", "key": "g", "value": 1}]}
    assert [r.id for r in c.search(q, 5, json_filter).collect()] == want(q, 5, [i for i in live if i % 3 == 1])
    assert c.explain_filter(json_filter, 5).arm == "post" and c.explain_filter(None).arm == "all" and c.explain_filter(json_filter, 10).arm == "scan"
    c.build_index()
    c.delete(spark.createDataFrame([(5,), (6,)], "id long"))
    live = {i: v for i, v in live.items() if i not in (5, 6)}
    c.insert(spark.createDataFrame([(900, q.tolist(), None)], "id long, vector array<double>, metadata string"))
    live[900] = q.astype(np.float32).astype(float)
    c = store.Collection(spark, f"file://{tmp_path}/c", 8)
    found = [r.id for r in c.search(q, 10).collect()]
    assert found[0] == 900 and not {5, 6} & set(found) and len(set(found) & set(want(q, 10, live))) >= 9
    assert len(c.search(q, 400).collect()) == 299 and c.search(q, 0).collect() == []
    with pytest.raises(search.DimensionError):
        c.search([1.0], 3)
    row = c.stats().first()
    assert row.len == 299 and row.indexed and row.wal_bytes > 0 and row.buffer == 303 and 0 < row.tombstone_ratio < 0.02
    for bad in ("group", "often", "group:x"):
        with pytest.raises(store.StoreError):
            store.SyncPolicy(bad)
    # seal threshold and compaction of dead records
    c.seal_rows = 1
    c.delete(spark.createDataFrame([(i,) for i in range(100, 290)], "id long"))
    assert len(c.manifest["segments"]) == 1 and c.manifest["segments"][0]["rows"] == c.count() == 109 and not c.log


def test_stream(spark, tmp_path):
    schema = "seq long, op string, id long, vector array<float>, metadata string"
    spark.createDataFrame([(1, "insert", 1, [1.0], None), (2, "delete", 1, None, None), (3, "insert", 2, [2.0], None), (4, "insert", 1, [3.0], None)], schema).coalesce(1).write.parquet(f"{tmp_path}/ops")
    c = store.Collection(spark, f"file://{tmp_path}/c", 1)
    store.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/ops"), c, f"{tmp_path}/state").awaitTermination()
    assert sorted((r.id, r.vector[0]) for r in c.live().collect()) == [(1, 3.0), (2, 2.0)]


def test_entry_without_the_corpus_operators(tmp_path):
    """Without the corpus folders, or these and the pipeline, the other queries are there."""
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.engine.QUERIES), set(e.oracle_sql()) <= set(e.queries()))"
    for gone in (("sparkvane/llm",), ("sparkvane/llm", "corpus_pipeline.py"), ("sparkvane/llm/*.py",)):
        place = tmp_path / str(len(list(tmp_path.iterdir())))
        place.mkdir()
        for name in ("__spark_entry__.py", "corpus_pipeline.py", "sparkvane"):
            if (ROOT / name).exists():
                (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, place / name)
        for name in gone:
            for x in place.glob(name):
                shutil.rmtree(x) if x.is_dir() else x.unlink()
        out = subprocess.run([sys.executable, "-c", code], cwd=place, env=os.environ | {"PYTHONPATH": str(place)}, capture_output=True, text=True)
        assert out.stdout.split() == ["True", "True"], out.stderr


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 100  # 10 of 500 ids are divisible by 50
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["knn_cosine_batch", "topk_l2_single", "filtered_topk_and", "filter_variant_props_range", "quantize_encode", "range_histogram", "live_view_replay", "planner_arms", "store_roundtrip", "store_stats", "collection_search"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "labels", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = engine.QUERIES[name](spark, DATA)
    want = con.execute(engine.SQL[name])
    names = [c[0] for c in want.description]
    rows = sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))
    assert rows == sorted(map(repr, want.fetchall()))
