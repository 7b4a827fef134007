"""The engine's queries over the test tables, with DuckDB SQL for each that SQL can express.
Batch searches take every row whose id is divisible by 50 as a query.

Where the metric matters, embeddings are rescaled by their label: the raw ones all have norm 1.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.functions.distance import Metric, normalize
from sparkvane.operators import ann, evaluate, filtered, quantize, search
from sparkvane.plans import planner
from sparkvane.plans.filters import Eq, Filter, Range
from sparkvane.streaming.store import Collection, last_operations

K = 10


def _base(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label"))).alias("vector"), "label")


def _queries(base: DataFrame) -> DataFrame:
    return base.where("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("id"), "value", "event_type", F.parse_json("props").alias("metadata"))


def _first(base: DataFrame) -> list[float]:
    return [float(x) for x in base.where("id = 0").first()["vector"]]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


_SQL_BASE = "base AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (1 + label)) AS vector, label FROM embeddings)"


def _sql_sum(a: str, b: str, term: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {term}))"


def _sql_distance(metric: str, a: str, b: str) -> str:
    if metric == "l2":
        return _sql_sum(a, b, "(z[1] - z[2]) * (z[1] - z[2])")
    product = _sql_sum(a, b, "z[1] * z[2]")
    if metric == "dot":
        return f"-({product})"
    return f"-({product}) / sqrt(({_sql_sum(a, a, 'z[1] * z[2]')}) * ({_sql_sum(b, b, 'z[1] * z[2]')}))"


def _batch(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        base = _base(spark, d)
        return _rounded(search.knn_batch(base, _queries(base), K, metric))

    return run


def _batch_sql(metric: str, where: str = "true", from_: str = "base") -> str:
    return f"""WITH {_SQL_BASE}, d AS (SELECT q.id AS qid, b.id, {_sql_distance(metric, 'b.vector', 'q.vector')} AS distance FROM {from_} b, base q WHERE q.id % 50 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM d)
SELECT qid, id, round(distance, 6) + 0.0 AS distance, rank::INT AS rank FROM r WHERE rank <= {K}"""


def _single(where: Filter | None = None, k: int = K, metric: str = "l2"):
    def run(spark: SparkSession, d: str) -> DataFrame:
        base = _base(spark, d)
        return _rounded(search.top_k(base, _first(base), k, metric, where))

    return run


def _single_sql(where: str = "true", k: int = K, metric: str = "l2") -> str:
    return f"""WITH {_SQL_BASE} SELECT b.id, round({_sql_distance(metric, 'b.vector', 'q.vector')}, 6) + 0.0 AS distance
FROM base b, base q WHERE q.id = 0 AND {where} ORDER BY {_sql_distance(metric, 'b.vector', 'q.vector')}, b.id LIMIT {k}"""


def _normalized(spark, d):
    return _base(spark, d).select("id", F.posexplode(normalize(F.col("vector"))).alias("pos", "x")).select("id", "pos", F.round("x", 9).alias("x"))


def _allow(spark, d):
    base = _base(spark, d)
    ids = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").select("doc_id")
    return _rounded(search.top_k(search.allowed(base, ids), _first(base), K))


def _tombstones(spark, d):
    base = _base(spark, d)
    dead = base.where("id % 5 = 0").select("id")
    return _rounded(search.knn_batch(search.alive(base, dead), _queries(base), K))


def _planned(where: Filter):
    def run(spark, d):
        base = _base(spark, d)
        return _rounded(filtered.search(base, _first(base), K, where)[0])

    return run


def _variant(where: Filter):
    def run(spark, d):
        return where.apply(_events(spark, d)).select("id")

    return run


def _numeric(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_linenumber").alias("line"))


def _histogram(spark, d):
    return planner.histogram(_numeric(spark, d), "price").select("bucket", "n")


def _estimate(spark, d):
    rows = _numeric(spark, d)
    truth = rows.agg(F.count_if(F.col("price").between(20000, 50000)).alias("truth"))
    both = planner.range_estimate(planner.histogram(rows, "price"), 20000, 50000).crossJoin(truth)
    return both.select((F.col("lower") <= F.col("truth")).alias("lower_holds"), (F.col("upper") >= F.col("truth")).alias("upper_holds"), "truth")


def _fit(spark, d):
    p = quantize.fit(_base(spark, d)).select(F.arrays_zip("mins", "scales").alias("z"))
    return p.select(F.posexplode("z").alias("pos", "z")).select("pos", F.round("z.mins", 9).alias("lo"), F.round("z.scales", 12).alias("scale"))


def _encode(spark, d):
    q = quantize.quantized(_base(spark, d))
    return q.select("id", F.posexplode("codes").alias("pos", "code")).groupBy("id").agg(F.sum("code").alias("total"), F.sum(F.col("code") * (F.col("pos") + 1)).alias("weighted"))


_SQL_QUANT = f"""{_SQL_BASE}, x AS (SELECT id, unnest(vector) AS x, generate_subscripts(vector, 1) AS pos FROM base),
p AS (SELECT pos, min(x) AS lo, (max(x) - min(x)) / 255.0::DOUBLE AS scale FROM x GROUP BY pos),
c AS (SELECT id, x.pos, x, lo, scale, CASE WHEN scale > 0 THEN least(greatest(round((x - lo) / scale), 0), 255)::INT ELSE 0 END AS code FROM x JOIN p ON x.pos = p.pos)"""


def _adc(spark, d):
    base = _base(spark, d)
    q = F.array(*[F.lit(x) for x in _first(base)])
    rows = quantize.quantized(base).select("id", quantize.adc(Metric.L2, q, F.col("codes"), F.col("mins"), F.col("scales")).alias("distance"))
    return _rounded(rows.orderBy("distance", "id").limit(K))


def _quant_recall(spark, d):
    base = _base(spark, d)
    queries = _queries(base)
    near = quantize.quantized(base).withColumn("vector", quantize.decode(F.col("codes"), F.col("mins"), F.col("scales")))
    return evaluate.recall_at_k(search.knn_batch(near, queries, K), search.knn_batch(base, queries, K), K).select((F.col("recall") >= 0.95).alias("recall_holds"))


def _recall(spark, d):
    base = _base(spark, d)
    queries = _queries(base)
    return evaluate.recall_at_k(search.knn_batch(base.where("id % 4 <> 0"), queries, K), search.knn_batch(base, queries, K), K).select(F.round("recall", 9).alias("recall"))


def _merge(spark, d):
    base = _base(spark, d)
    queries = _queries(base)
    parts = [search.knn_batch(base.where(f"id % 4 in ({i}, {(i + 1) % 4})"), queries, K).drop("rank") for i in range(4)]
    return _rounded(search.merge_nearest(parts, K))


def _replay(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    log = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "delete").otherwise("insert").alias("op"), "value")
    return last_operations(log).select("id", "seq", "value")


def _ann(spark, d):
    base = _base(spark, d)
    queries = _queries(base)
    found = ann.search_index(ann.build_index(base), queries, K)
    return evaluate.recall_at_k(found, search.knn_batch(base, queries, K), K).select((F.col("recall") >= 0.95).alias("recall_holds"))


def _arms(spark, d):
    base = _base(spark, d)
    n = base.count()
    wheres = [Filter(), Filter((Eq("label", 99),)), Filter((Range("id", 0, 20),)), Filter((Range("id", 0, None),)), Filter((Range("id", 9, 3),))]
    rows = [(i, planner.plan(base, w, K, n).arm) for i, w in enumerate(wheres)]
    return spark.createDataFrame(rows, "query int, arm string")


def _collection(spark, d):
    """A collection that goes when the application ends: most rows are inserted, some of these
    deleted, that is sealed, the rest is inserted, and all is opened again."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"))
    dim = rows.agg(F.max(F.size("vector")).alias("dim")).first()["dim"] or 1
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkvane-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/collection-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    c = Collection(spark, path, dim, seal_rows=1 << 62)  # sealed by the checkpoint only
    c.insert(rows.where("id % 10 <> 0"))
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    c.delete(rows.where("id % 10 <> 0 and id % 7 = 0").select("id"))
    c.checkpoint()
    c.insert(rows.where("id % 10 = 0"))
    return Collection(spark, path, dim)


def _roundtrip(spark, d):
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _collection(spark, d).live().select("id", F.expr("variant_get(metadata, '$.label', 'int')").alias("label"), F.round(total, 6).alias("total"))


def _store_stats(spark, d):
    return _collection(spark, d).stats().select(F.col("len").alias("live"), "segments", "log_commits", "buffer", "generation", "replay_applied")


def _collection_search(spark, d):
    query = [float(x) for x in spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id = 0").first()["embedding"]]
    return _rounded(_collection(spark, d).search(query, K, Filter((Range("label", 2, 5),))))


def _dot(a, b):
    return _sql_sum(a, b, "z[1] * z[2]")


_EQ, _RANGE = Filter((Eq("label", 3),)), Filter((Range("label", 2, 5),))
_AND = Filter((Eq("label", 3.0), Range("id", 10, 400)))

QUERIES = {
    "knn_l2_batch": _batch("l2"),
    "knn_dot_batch": _batch("dot"),
    "knn_cosine_batch": _batch("cosine"),
    "topk_l2_single": _single(),
    "topk_dot_single": _single(metric="dot"),
    "topk_cosine_single": _single(metric="cosine"),
    "topk_k_gt_n": _single(k=100_000),
    "topk_k_zero": _single(k=0),
    "normalize_vectors": _normalized,
    "filtered_topk_eq": _single(_EQ),
    "filtered_topk_range": _single(_RANGE),
    "filtered_topk_and": _single(_AND),
    "filtered_topk_empty": _single(Filter((Eq("label", "3"),))),
    "planned_topk": _planned(_AND),
    "filter_json_form": lambda s, d: _single(Filter.from_json(_AND.to_json()))(s, d),
    "filter_variant_props_eq": _variant(Filter((Eq("k", 7.0),))),
    "filter_variant_props_range": _variant(Filter((Range("k", 10, 19.5),))),
    "filter_variant_props_kind": _variant(Filter((Eq("k", "7"),))),
    "filter_typed_column": _variant(Filter((Range("k", None, 50),))),
    "allow_set_semi": _allow,
    "tombstone_anti": _tombstones,
    "postings": lambda s, d: planner.postings(_base(s, d), "label").select("value", F.array_join("ids", ",").alias("ids"), "n"),
    "facet_counts": lambda s, d: planner.facet_counts(_events(s, d), "k"),
    "eq_cardinality": lambda s, d: planner.eq_cardinality(_numeric(s, d), Filter((Eq("line", 1), Eq("line", 7)))),
    "range_histogram": _histogram,
    "range_estimate_bounds": _estimate,
    "range_enumerate": lambda s, d: planner.enumerate_range(_numeric(s, d), "price", 20000, 21000),
    "quantizer_fit": _fit,
    "quantize_encode": _encode,
    "adc_topk": _adc,
    "quant_recall": _quant_recall,
    "recall_at_k": _recall,
    "merge_dedup_topk": _merge,
    "live_view_replay": _replay,
    "ann_topk": _ann,
    "planner_arms": _arms,
    "store_roundtrip": _roundtrip,
    "store_stats": _store_stats,
    "collection_search": _collection_search,
}

#: The records of ``_collection`` that are live.
_LIVE = "(vec_id % 10 = 0 OR vec_id % 7 <> 0)"

SQL = {
    **{f"knn_{m}_batch": _batch_sql(m) for m in ("l2", "dot", "cosine")},
    **{f"topk_{m}_single": _single_sql(metric=m) for m in ("l2", "dot", "cosine")},
    "topk_k_gt_n": _single_sql(k=100_000),
    "topk_k_zero": _single_sql(k=0),
    "normalize_vectors": f"""WITH {_SQL_BASE}, n AS (SELECT id, vector, sqrt({_dot('vector', 'vector')}) AS n FROM base)
SELECT id, generate_subscripts(vector, 1)::INT - 1 AS pos, round(unnest(list_transform(vector, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END)), 9) AS x FROM n""",
    "filtered_topk_eq": _single_sql("b.label = 3"),
    "filtered_topk_range": _single_sql("b.label BETWEEN 2 AND 5"),
    "filtered_topk_and": _single_sql("b.label = 3 AND b.id BETWEEN 10 AND 400"),
    "filtered_topk_empty": _single_sql("false"),
    "planned_topk": _single_sql("b.label = 3 AND b.id BETWEEN 10 AND 400"),
    "filter_json_form": _single_sql("b.label = 3 AND b.id BETWEEN 10 AND 400"),
    "filter_variant_props_eq": "SELECT event_id AS id FROM events WHERE (props::JSON ->> 'k')::DOUBLE = 7",
    "filter_variant_props_range": "SELECT event_id AS id FROM events WHERE (props::JSON ->> 'k')::DOUBLE BETWEEN 10 AND 19.5",
    "filter_variant_props_kind": "SELECT event_id AS id FROM events WHERE false",
    "filter_typed_column": "SELECT event_id AS id FROM events WHERE (props::JSON ->> 'k')::DOUBLE <= 50",
    "allow_set_semi": _single_sql("b.id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "tombstone_anti": _batch_sql("l2", "b.id % 5 <> 0"),
    "postings": "SELECT 'n:' || label::DOUBLE AS value, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids, count(*) AS n FROM embeddings GROUP BY label",
    "facet_counts": "SELECT 'n:' || k AS value, count(*) AS n FROM (SELECT (props::JSON ->> 'k')::DOUBLE AS k FROM events) WHERE k IS NOT NULL GROUP BY k",
    "eq_cardinality": "SELECT least(count(*) FILTER (WHERE l_linenumber = 1), count(*) FILTER (WHERE l_linenumber = 7)) AS upper FROM lineitem",
    "range_histogram": """WITH b AS (SELECT min(l_extendedprice)::DOUBLE AS lo, max(l_extendedprice)::DOUBLE AS hi FROM lineitem)
SELECT least(greatest(floor(64 * (l_extendedprice::DOUBLE - lo) / (hi - lo)), 0), 63)::INT + 1 AS bucket, count(*) AS n FROM lineitem, b GROUP BY 1""",
    "range_estimate_bounds": "SELECT true AS lower_holds, true AS upper_holds, count(*) FILTER (WHERE l_extendedprice BETWEEN 20000 AND 50000) AS truth FROM lineitem",
    "range_enumerate": "SELECT l_orderkey AS id, l_extendedprice::DOUBLE AS value FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 21000",
    "quantizer_fit": f"WITH {_SQL_QUANT} SELECT pos::INT - 1 AS pos, round(lo, 9) AS lo, round(scale, 12) AS scale FROM p",
    "quantize_encode": f"WITH {_SQL_QUANT} SELECT id, sum(code)::BIGINT AS total, sum(code * pos)::BIGINT AS weighted FROM c GROUP BY id",
    "adc_topk": f"""WITH {_SQL_QUANT}, q AS (SELECT unnest(vector) AS q, generate_subscripts(vector, 1) AS pos FROM base WHERE id = 0)
SELECT c.id, round(sum((q - (lo + scale * code)) * (q - (lo + scale * code))), 6) + 0.0 AS distance FROM c JOIN q ON c.pos = q.pos GROUP BY c.id ORDER BY sum((q - (lo + scale * code)) * (q - (lo + scale * code))), c.id LIMIT {K}""",
    "recall_at_k": f"""WITH {_SQL_BASE}, d AS (SELECT q.id AS qid, b.id, {_sql_distance('l2', 'b.vector', 'q.vector')} AS distance FROM base b, base q WHERE q.id % 50 = 0),
t AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM d),
r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM d WHERE id % 4 <> 0),
h AS (SELECT t.qid, count(r.id) / least({K}, count(*))::DOUBLE AS share FROM t LEFT JOIN r ON t.qid = r.qid AND t.id = r.id AND r.rank <= {K} WHERE t.rank <= {K} GROUP BY t.qid)
SELECT round(avg(share), 9) AS recall FROM h""",
    "merge_dedup_topk": _batch_sql("l2"),
    "live_view_replay": "SELECT user_id AS id, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 3 <> 0",
    # what the search promises; the queries measure it
    "quant_recall": "SELECT true AS recall_holds",
    "ann_topk": "SELECT true AS recall_holds",
    "planner_arms": f"""WITH c AS (SELECT count(*) AS n, [count(*) FILTER (WHERE label = 99), count(*) FILTER (WHERE vec_id BETWEEN 0 AND 20), count(*) FILTER (WHERE vec_id >= 0)] AS found FROM embeddings),
m AS (SELECT unnest([1, 2, 3]) AS query, unnest(found) AS found, greatest(16 * {K}, floor(0.05 * n)) AS most FROM c)
SELECT 0::INT AS query, 'all' AS arm UNION ALL SELECT 4::INT, 'empty'
UNION ALL SELECT query::INT, CASE WHEN found = 0 THEN 'empty' WHEN found <= most THEN 'scan' ELSE 'post' END FROM m""",
    "store_roundtrip": f"SELECT vec_id AS id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings WHERE {_LIVE}",
    "store_stats": f"""SELECT count(*) FILTER (WHERE {_LIVE}) AS live, 1::INT AS segments, 1::INT AS log_commits, count(*) FILTER (WHERE vec_id % 10 = 0) AS buffer,
1::INT AS generation, 1::INT AS replay_applied FROM embeddings""",
    "collection_search": f"""WITH base AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vector, label FROM embeddings)
SELECT b.id, round({_sql_distance('l2', 'b.vector', 'q.vector')}, 6) + 0.0 AS distance FROM base b, base q
WHERE q.id = 0 AND b.label BETWEEN 2 AND 5 AND {_LIVE.replace('vec_id', 'b.id')} ORDER BY {_sql_distance('l2', 'b.vector', 'q.vector')}, b.id LIMIT {K}""",
}
