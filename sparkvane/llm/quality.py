"""Quality classifier: regularised quadratic discriminant analysis.

Documents become statistics of their bytes, words and lines, transformed to be roughly normal.
Each class has its mean and a covariance shrunk towards the pooled covariance and its
diagonal; a score is the posterior from the difference of the Mahalanobis log-densities, with
the Cholesky factors computed once. The class moments are sums over all labelled rows that
are not held out, combined before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import materialize, ship

#: Shares of the pooled covariance, and of a multiple of the identity, in a class's.
POOL, RIDGE = 0.2, 0.02

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!", "?", "|", "#$%&*@^~+=", "<>/\\_`", "()[]{}", "'\"", ":;-"]
_GROUP = np.full(256, len(_GROUPS), np.int64)  # other control bytes
for _i, _g in enumerate(_GROUPS):
    _GROUP[[ord(c) for c in _g]] = _i
_GROUP[128:] = len(_GROUPS) + 1
_K = len(_GROUPS) + 2
_LINE = np.ones(256, bool)
_LINE[10] = False


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def _logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (whole - part + 0.5))


def _distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct values, times of the most frequent) of each text."""
    out = np.zeros((len(first) - 1, 2), np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            x = np.sort(values[a:b])
            edge = np.append(np.flatnonzero(x[1:] != x[:-1]) + 1, b - a)
            out[i] = len(edge), np.diff(np.append(0, edge)).max()
    return out[:, 0], out[:, 1]


def statistics(column: pa.Array) -> np.ndarray:
    """The transformed statistics of each whole text, one row a text."""
    data, offsets = _text.buffers(column)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    groups = np.bincount(doc * _K + _GROUP[data], minlength=len(n) * _K).reshape(-1, _K)
    h, start, end, first = _text.words(data, offsets, _text.NOT_SPACE)
    words = np.diff(first)
    size = end - start
    of = np.repeat(np.arange(len(n)), words)

    def per_word(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=x, minlength=len(n))

    short, long = per_word(size <= 1), per_word(size >= 12)
    upper = per_word(_GROUP[data[start]] == 1) if len(start) else np.zeros(len(n))
    closed = per_word(_GROUP[data[end - 1]] == 6) if len(start) else np.zeros(len(n))
    squares = per_word(size.astype(float) ** 2)
    kinds, top = _distinct(h, first)
    lines, _, _, line_first = _text.words(data, offsets, _LINE)
    n_lines = np.diff(line_first)
    line_kinds, line_top = _distinct(lines, line_first)
    mean = per_word(size) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(words, 1) - mean**2, 0))
    columns = [np.log1p(n), np.log1p(words), np.log1p(mean), np.log1p(spread), np.log1p(words / np.maximum(n_lines, 1)), np.log1p(n_lines)]
    columns += [_logit(groups[:, i], n) for i in range(_K)]
    columns += [_logit(x, words) for x in (short, long, upper, closed, kinds, top)]
    columns += [_logit(line_kinds, n_lines), _logit(line_top, n_lines)]
    return np.stack(columns, 1).astype(np.float64)


class Discriminant:
    """Quadratic discriminant from (rows, sum, sum of outer products) of either class."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        self.share = moments[1][0] / max(moments[0][0] + moments[1][0], 1) if sum(m[0] for m in moments.values()) else 0.5
        self.trained = min(m[0] for m in moments.values()) >= 2
        if not self.trained:
            return
        d = len(moments[0][1])
        self.scale, scatter = np.ones(d), {}
        n = sum(m[0] for m in moments.values())
        means = {c: s / k for c, (k, s, _) in moments.items()}
        for c, (k, s, o) in moments.items():
            scatter[c] = o / k - np.outer(means[c], means[c])
        pooled = sum(moments[c][0] / n * scatter[c] for c in moments)
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        self.parts = {}
        for c, (k, _, _) in moments.items():
            cov = ((1 - POOL) * scatter[c] + POOL * pooled) / np.outer(self.scale, self.scale)
            cov = (1 - RIDGE) * cov + RIDGE * max(np.trace(cov) / d, 1e-3) * np.eye(d)
            root = np.linalg.cholesky(cov)
            # the inverse factor is kept: a density is one product and a sum of squares
            self.parts[c] = means[c] / self.scale, np.linalg.inv(root).T, -np.log(np.diag(root)).sum() + math.log(k / n)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        if not self.trained:
            return np.full(len(x), self.share)
        log = {c: -0.5 * (((x / self.scale - m) @ w) ** 2).sum(1) + b for c, (m, w, b) in self.parts.items()}
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``x`` (statistics as float64 bytes)."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for y in batches for s in _text.slices(y, "text")):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.tobytes() for r in statistics(b.column("text"))], pa.binary())], ["doc_id", "x"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x binary")


def fit(made: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """From :func:`features` and (doc_id, label) rows; labels other than 0 and 1 are not used."""
    labels = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float64).reshape(b.num_rows, -1)
                y = b.column("label").to_numpy()
                for c in np.unique(y).tolist():
                    z = x[y == c]
                    total[c] = total.get(c, 0) + np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        for c, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c, np.int32)), pa.array(np.arange(len(v))), pa.array(v)], ["label", "pos", "value"])

    sums = made.join(labels, "doc_id").select("label", "x").mapInArrow(run, "label int, pos long, value double")
    rows = sums.groupBy("label", "pos").agg(F.sum("value").alias("value")).collect()  # a fixed number of sums
    d = statistics(pa.array([""])).shape[1]
    flat = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
    for r in rows:
        flat[r.label][r.pos] = r.value
    return Discriminant({c: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for c, v in flat.items()})


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """One row per document row: ``doc_id``, ``score`` (probability of label 1).

    A null text is empty and is scored. Ids without labels, labels without documents and null
    labels are not learned from; repeated labels count each time. Without two labelled rows
    of either class, the score is the share of label 1 (0.5 without labels). Other columns
    are not read.
    """
    made = materialize(features(docs, id_col, text_col), "features")
    model = docs.sparkSession.sparkContext.broadcast(fit(made, labels, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.value.score(x))], ["doc_id", "score"])

    return made.mapInArrow(run, f"doc_id {made.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    out = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
