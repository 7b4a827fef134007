"""Line dedup: lines that many documents share stay in one document only.

Built-in functions only. Lines become 128-bit keys; keys are range-partitioned with a
secondary sort by document and position, and one pass over each sorted range streams first
occurrences. The result is a compressed keep bitmap (runs of kept lines) per document; text
is never sorted or grouped.

A key that holds more than ``1/HOT`` of all lines would fill one range. Those (at most
``2 * HOT`` of them, found with a mergeable heavy-hitter sketch, which steers only where rows go)
are counted with map-side combining and joined back by broadcast of their few counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import carried, materialize, shuffle_partitions

#: A key with more than this share of lines is counted apart.
HOT = 512
#: ``[\x20\x09-\x0D]``
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line, stripped of ASCII white space at both ends, with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def keep_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, carry: list[str] = ()) -> DataFrame:
    """One row per document row: ``doc_id``, ``text``, ``n_lines``, ``n_dropped`` and ``runs``,
    the kept lines as an array of (start, length).

    A line is dropped if its key has at least ``min_chars`` code points, occurs in at least
    ``min_docs`` documents, and this is not the largest id among them. Null or empty text is
    one empty line. Rows of one id count as one document. A null id is a document of its
    own, below all others. The columns ``carry`` come along as a struct ``_carried``; others are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carried(carry))
    lines = base.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    # two independent 64-bit hashes: one column's hash seeds the next one's
    lines = lines.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"))
    lines = materialize(lines, "lines")

    n, top = lines.agg(F.count("*"), F.expr(f"approx_top_k(h1, {2 * HOT}, {32 * HOT})")).first()
    hot = [r.item for r in top or [] if r["count"] * HOT > n]
    cold = lines.where(~F.col("h1").isin(hot)) if hot else lines
    order = [F.col("doc_id").desc_nulls_last(), F.col("pos")]
    by_key = Window.partitionBy("h1", "h2")
    stream = by_key.orderBy(*order)
    cold = cold.repartitionByRange(shuffle_partitions(docs.sparkSession), "h1", "h2")
    # secondary sort: documents of a key come largest first, so the first row's document keeps the line
    cold = cold.withColumn("keeper", F.first("doc_id").over(stream)).withColumn("nth", F.dense_rank().over(by_key.orderBy(F.col("doc_id").desc_nulls_last())))
    cold = cold.withColumn("n_docs", F.max("nth").over(by_key)).select("doc_id", "version", "pos", "keeper", "n_docs")
    found = cold
    if hot:
        few = lines.where(F.col("h1").isin(hot))
        counts = few.groupBy("h1", "h2").agg((F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n_docs"), F.max("doc_id").alias("keeper"))
        found = found.unionByName(few.join(F.broadcast(counts), ["h1", "h2"]).select("doc_id", "version", "pos", "keeper", "n_docs"))
    drops = found.where((F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = drops.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("dropped")).withColumnsRenamed({"doc_id": "d", "version": "v"})

    base = base.withColumn("version", F.xxhash64("text"))
    out = base.join(drops, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
    out = out.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
    out = out.withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    starts = F.concat(F.array(F.lit(0)), F.transform("dropped", lambda x: x + 1))
    ends = F.concat("dropped", F.array(F.col("n_lines").cast("int")))
    runs = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length"))), lambda r: r["length"] > 0)
    return out.select("doc_id", "text", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), runs.alias("runs"), *(["_carried"] if carry else []))


def kept_text() -> Column:
    """The kept lines of ``text`` by ``runs``, joined by newlines."""
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    return F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, carry: list[str] = ()) -> DataFrame:
    """:func:`keep_runs` applied: ``doc_id``, ``n_lines``, ``n_dropped``, ``runs``, ``kept``."""
    out = keep_runs(docs, id_col, text_col, min_chars, min_docs, carry)
    return out.select("doc_id", "n_lines", "n_dropped", "runs", kept_text().alias("kept"), *(["_carried"] if carry else []))


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM base),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
