"""Toxicity: subword-bag embeddings averaged into a linear softmax.

Words, with a mark at either end, give character n-grams; each hashes to an embedding. The
average of a text's embeddings goes into a softmax over the two classes; embeddings and
softmax are trained jointly in numpy, on a bounded sample of labelled rows and misspelt copies
of them. An unseen misspelling shares n-grams, and so its vectors, with the word it stands for
or with other misspellings of it. Embeddings of n-grams that tell the classes apart little more
than chance are held near zero by a prior, for there are very many of them.

Texts are averaged by passages of ``PASSAGE`` words, so that a few words weigh the same in a
text of any length; a text's score is that of its most toxic passage, in training as in use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import ship

#: Bounds of the sample: labelled rows a class (whole texts, those whose ids have the smallest
#: hashes), and the length of texts that may be in it.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 32_768
NGRAMS, BITS, SIZE = (3, 4, 5, 6), 20, 8
PASSAGE, EPOCHS, RATE, DECAY, BATCH = 32, 20, 0.05, 1e-4, 64
#: Misspelt copies of each sampled text of either class that are learned from too.
COPIES = (1, 2)
#: An embedding is scaled by how sure its n-gram tells the classes apart, as a prior: one half
#: where the shares of texts that hold it differ by this many standard errors, less towards
#: none and more beyond. Scales below ``FLOOR`` are zero.
EVIDENCE, POWER, FLOOR = 6.0, 4, 0.01
_U = np.uint64


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its passage, text of each passage); passages without n-grams
    don't appear in the second."""
    data, offsets = _text.buffers(column)
    n = len(offsets) - 1
    # texts apart by two marks; a mark stands for whatever is between words
    data = np.insert(data, np.repeat(offsets[:-1], 2), 32)
    offsets = offsets + 2 * np.arange(n + 1)
    data = np.append(data, np.full(8, 32, np.uint8))
    inside = _text.ALNUM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    word = np.cumsum(first) - 1  # of word bytes and of the marks after them
    words = np.diff(np.append(0, np.cumsum(first))[offsets])
    per = np.maximum(-(-words // PASSAGE), 1)
    base = np.cumsum(per) - per
    doc = np.repeat(np.arange(n), words)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(words) - words, words)
    passage_of_word = base[doc] + nth // PASSAGE
    text = np.repeat(np.arange(n), per)
    value = np.where(inside, _text.BYTE_VALUES[data], _U(0x2545F4914F6CDD1D))
    buckets, passages = [], []
    up, down = _text._BYTES.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(value * up[: len(data)], out=total[1:])
    run = np.append(0, np.cumsum(inside))
    for k in NGRAMS:
        m = len(data) - k + 1
        if m > 0 and len(doc):
            # all but the first and last byte are of one word
            at = np.flatnonzero((run[k - 1 : m + k - 1] - run[1 : m + 1] == k - 2) & (word[1 : m + 1] >= 0))
            h = _text.mix((total[at + k] - total[at]) * down[at] ^ _U(k))
            buckets.append((h >> _U(64 - BITS)).astype(np.int64))
            passages.append(passage_of_word[word[at + 1]])
    if not buckets:
        z = np.zeros(0, np.int64)
        return z, z, text
    return np.concatenate(buckets), np.concatenate(passages), text


def misspelt(text: str, rng: np.random.Generator) -> str:
    """A copy with two neighbouring letters swapped in each run of four ASCII letters or more."""
    data = np.frombuffer(text.encode(), np.uint8).copy()
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], letter, [0]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    start, size = start[end - start >= 4], (end - start)[end - start >= 4]
    at = start + (rng.random(len(start)) * (size - 1)).astype(np.int64)
    data[at], data[at + 1] = data[at + 1].copy(), data[at].copy()
    return data.tobytes().decode()


def evidence(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """The scale of each n-gram's embedding: ``x / (1 + x)`` with ``x`` the power ``POWER`` of the
    difference between the classes' shares of texts that hold it, in ``EVIDENCE`` standard errors."""
    held = np.zeros((2, 1 << BITS))
    for i in range(0, len(texts), 16):
        g, p, t = grams(pa.array(texts[i : i + 16], pa.string()))
        own = np.unique(g << 4 | t[p])
        for c in (0, 1):
            held[c] += np.bincount(own[labels[i + (own & 15)] == c] >> 4, minlength=1 << BITS)
    sizes = np.array([[(labels == c).sum()] for c in (0, 1)])
    mean = held.sum(0) / sizes.sum()
    error = np.sqrt(mean * (1 - mean) * (1 / sizes).sum())
    x = (np.abs(held[1] / sizes[1] - held[0] / sizes[0]) / np.maximum(error, 1e-9) / EVIDENCE) ** POWER
    scale = x / (1 + x)
    return np.where(scale < FLOOR, 0, scale).astype(np.float32)


class Bags:
    """A linear softmax over averaged subword embeddings, trained jointly."""

    def __init__(self, texts: list[str], labels: np.ndarray, seed: int = 5):
        self.share = float(labels.mean()) if len(labels) else 0.5
        self.trained = len(labels) > 0 and 0 < self.share < 1
        if not self.trained:
            return
        rng = np.random.default_rng(seed)
        texts, labels = list(texts), labels.tolist()
        for text, c in [*zip(texts, labels)]:
            texts += [misspelt(text, rng) for _ in range(COPIES[c])]
            labels += [c] * COPIES[c]
        labels = np.array(labels)
        scale = evidence(texts, labels)
        known = np.flatnonzero(scale)
        scale = scale[known][:, None]
        # known n-grams by passage, all n-grams counted
        number = np.full(1 << BITS, -1, np.int32)
        number[known] = np.arange(len(known))
        held, ends, every, text = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [], []
        for i in range(0, len(texts), 16):
            g, p, t = grams(pa.array(texts[i : i + 16], pa.string()))
            every.append(np.bincount(p, minlength=len(t)))
            text.append(t + i)
            g, p = number[g], p[number[g] >= 0]
            g = g[g >= 0][np.argsort(p, kind="stable")]
            ends.append(ends[-1][-1] + np.cumsum(np.bincount(p, minlength=len(t))))
            held.append(g)
        held, ends, text = np.concatenate(held), np.concatenate(ends), np.concatenate(text)
        every = np.maximum(np.concatenate(every), 1)[:, None]
        table = rng.normal(0, 0.01, (len(known), SIZE)).astype(np.float32)
        out = rng.normal(0, 1, (SIZE, 2)).astype(np.float32)
        bias = np.zeros(2, np.float32)
        weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)[text][:, None]
        target = np.eye(2, dtype=np.float32)[labels[text]]
        moment = [[np.zeros_like(w), np.zeros_like(w)] for w in (table, out, bias)]
        touched = np.zeros(len(known), np.int32)
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            # the most toxic passage of each text stands for it
            total = np.append(0, np.cumsum(((table * scale) @ (out[:, 1] - out[:, 0]))[held], dtype=np.float64))
            score = (total[ends[1:]] - total[ends[:-1]]) / every[:, 0]
            pick = np.lexsort((score, text))
            pick = rng.permutation(pick[np.append(text[pick][1:] != text[pick][:-1], True)])
            for a in range(0, len(pick), BATCH):
                b = pick[a : a + BATCH]
                n = ends[b + 1] - ends[b]
                if not n.sum():
                    continue
                step += 1
                own = held[np.repeat(ends[b] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
                rows, where = np.unique(own, return_inverse=True)
                touched[rows] += 1
                bag = np.bincount(np.repeat(np.arange(len(b)), n) * len(rows) + where, minlength=len(b) * len(rows))
                bag = bag.reshape(len(b), -1).astype(np.float32) / every[b].astype(np.float32)
                mean = bag @ (table[rows] * scale[rows])
                logits = mean @ out + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                error = (p - target[b]) * weight[b] / len(b)
                back = (bag.T @ (error @ out.T)) * scale[rows] + DECAY * table[rows]
                for w, at, grad, (m1, m2), t in ((table, rows, back, moment[0], touched[rows][:, None]), (out, slice(None), mean.T @ error, moment[1], step), (bias, slice(None), error.sum(0), moment[2], step)):
                    m1[at] = 0.9 * m1[at] + 0.1 * grad
                    m2[at] = 0.99 * m2[at] + 0.01 * grad**2
                    w[at] -= rate * (m1[at] / (1 - 0.9**t)) / (np.sqrt(m2[at] / (1 - 0.99**t)) + 1e-8)
        # for two classes, an embedding acts by one number
        self.weight = np.zeros(1 << BITS, np.float32)
        self.weight[known] = (table * scale) @ (out[:, 1] - out[:, 0])
        self.bias = float(bias[1] - bias[0])

    def score(self, column: pa.Array) -> np.ndarray:
        """The probability of class 1 of each text."""
        if not self.trained:
            return np.full(len(column), self.share)
        b, p, t = grams(column)
        n = np.bincount(p, minlength=len(t))
        logit = np.bincount(p, self.weight[b], len(t)) / np.maximum(n, 1) + self.bias
        out = np.full(len(column), -np.inf)
        np.maximum.at(out, t, np.where(n > 0, logit, min(self.bias, 0.0)))
        return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Bags:
    """From whole texts of at most ``SAMPLE_ROWS`` labelled ids of either class not held out, and of
    at most ``SAMPLE_CHARS`` characters each (longer ones are not in the sample).

    Ids labelled both 0 and 1 are not learned from. An id that documents repeat counts once,
    with the text of the smallest hash; equal labels that repeat count once.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("z")).where("y = z")
    first = [rows.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS) for c in (0, 1)]  # each task passes on its first ones
    few = {r.id: r.y for r in first[0].union(first[1]).collect()}
    if not few:
        return Bags([], np.zeros(0, np.int64))
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.where(F.col("id").isin([*few]) & (F.char_length("text") <= SAMPLE_CHARS))
    got = docs.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()  # a row for each sampled id
    got.sort(key=lambda r: r.id)
    return Bags([r.text for r in got], np.array([few[r.id] for r in got], np.int64))


def score_toxicity(docs: DataFrame, model: Bags, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id``, ``score`` (probability of label 1).

    A null text or one without words has the score of no evidence, below 0.5. With labelled
    rows of one class only, the score is the share of label 1 (0.5 without labels). Other
    columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in _text.slices(x, "text")):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(b.column("text")))], ["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score_toxicity(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
