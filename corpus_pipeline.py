"""A training corpus from raw documents: language ID, line dedup, near-dedup,
decontamination, packing. Each stage reads what the stage before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import decontaminate, language_id, line_dedup, minhash_dedup, packing
from sparkvane.llm._spark import BROADCAST_BYTES, materialize

#: Completed phrases a letter beyond which a text is in none of the learned languages.
MOST_PHRASES = 0.75


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _like(docs: DataFrame, out: DataFrame, text: str, **columns) -> DataFrame:
    """``out`` with the columns of ``docs``: the new text, what it carried, and some replaced."""
    values = {c: F.col(f"_carried.`{c}`") for c in _others(docs)} | {"doc_id": F.col("doc_id"), "text": F.col(text), "n_chars": F.char_length(text).cast("long")} | columns
    return out.select(*[values[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, which becomes ``lang``; those without letters or of
    text that no language explains go."""
    out = language_id.identify(docs, language_id.learn(docs), carry=_others(docs))
    out = out.where((F.col("lang_pred") != "und") & (F.col("rate") <= MOST_PHRASES))
    return _like(docs, out, "text", lang=F.col("lang_pred"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go; every document stays, if with less text."""
    return _like(docs, line_dedup.dedup_lines(docs, carry=_others(docs)), "kept")


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays.
    Rows that share an id stay or go together; rows without an id stay."""
    gone = materialize(minhash_dedup.near_copies(docs).where("not kept").select("doc_id").distinct(), "gone")
    # 40 bytes an id: broadcast up to the bound, else Spark joins by shuffles
    small = 40 * gone.count() <= BROADCAST_BYTES
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others, benchmark passages do."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _like(docs, decontaminate.decontaminate(docs, items, carry=_others(docs)), "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_near_copies),
    ("decontaminate", remove_benchmark),
    ("packing", pack),
]

#: Models and similarities are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the pieces and places of what they keep.

    Null and empty texts, and those without letters, go at the first stage. Rows of one id are
    judged by their own text, but near copies by id; equal rows with one id all stay. Rows without
    an id go through all stages. Columns of any other names are carried up to packing. Empty
    tables give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if i == len(STAGES) - 1 else materialize(out, name)
    return docs
