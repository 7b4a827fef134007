"""Sequence packing: shortest-pack-first over the length histogram.

Documents become token ids (and a closing id 0) and are cut into pieces of at most one
sequence. The histogram of piece lengths (at most ``size`` entries) goes to the driver, where
lengths are placed from long to short, each on the shortest packs it fits, as counts of
packing patterns. Pieces then find their places in the patterns by their rank among those
of equal length: each task numbers its pieces by length as it cuts them, and the numbers of
pieces of earlier tasks are added, so no pieces are sorted or gathered by length.

Token ids are those of the ``tokenizers`` library. A text is split by the library's rules with
array operations, and each distinct part is encoded once per worker and kept in a bounded
cache; texts with characters beyond the basic plane, unassigned ones or the text of a special
token are encoded whole by the library.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import materialize, ship

_OTHER, _LETTER, _DIGIT, _SPACE, _ODD = range(5)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Parts that a worker keeps.
CACHE = 400_000


def _classes() -> np.ndarray:
    out = np.full(0x10000, _OTHER, np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        out[c] = _LETTER if kind[0] == "L" else _DIGIT if kind[0] == "N" else _ODD if kind in ("Cn", "Cs") else _OTHER
    out[_WHITE] = _SPACE
    return out


class Encoder:
    """Texts to ids of a byte-level BPE of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.classes = _classes()
        rng = np.random.default_rng(3)
        self.values = rng.integers(1, 1 << 63, 0x10000, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.slot_key, self.slot = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids)."""
        if len(self.known) > CACHE:
            self.clear()
        data, offsets = _text.buffers(column)
        raw = data.tobytes()
        text = raw.decode()
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        odd = set()
        if len(c):
            kind = self.classes[np.minimum(c, 0xFFFF)]
            kind[c > 0xFFFF] = _ODD
            at = np.flatnonzero(kind == _ODD)
            odd.update((np.searchsorted(first, at, "right") - 1).tolist())
            kind[at] = _OTHER
        for s in self.special:
            p = raw.find(s)
            while p >= 0:
                odd.add(int(np.searchsorted(offsets, p, "right")) - 1)
                p = raw.find(s, p + 1)
        if not len(c):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start = self._starts(c, kind, first)
        place, count = self._places(text, np.minimum(c, 0xFFFF), start)
        ends = np.append(0, np.cumsum(count))
        ids = self.ids[np.repeat(place - ends[:-1], count) + np.arange(ends[-1])]
        bounds = ends[np.searchsorted(start, first)]
        if odd:
            parts = [self.whole(raw[offsets[i] : offsets[i + 1]].decode()) if i in odd else ids[bounds[i] : bounds[i + 1]] for i in range(len(column))]
            return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return ids, bounds

    def _starts(self, c: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the library's pattern starts a part: runs of letters, digits, others or white
        space; of white space before a run the last character stands apart, or joins the
        run if it is a space; contractions stand apart after a run."""
        n = len(c)
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        change = np.empty(n, bool)
        change[0] = True
        change[1:] = kind[1:] != kind[:-1]
        change |= edge[:n]
        start = change.copy()
        after = np.flatnonzero(change[1:] & ~edge[1:n] & (kind[:-1] == _SPACE)) + 1
        start[after - 1] = True
        start[after[c[after - 1] == 32]] = False
        marks = np.flatnonzero((c == 39) & change)
        marks = marks[edge[marks] | (c[marks - 1] != 32)]
        for letters in ("s", "t", "re", "ve", "m", "ll", "d"):
            here = marks[marks + len(letters) < n]
            for i, x in enumerate(letters, 1):
                here = here[(c[here + i] == ord(x)) & ~edge[here + i]]
            start[here + 1] = False
            end = here + 1 + len(letters)
            end = end[end < n]
            start[end[(kind[end] == _LETTER)]] = True
        return np.flatnonzero(start)

    def _places(self, text: str, c: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each part are in ``self.ids``, and how many."""
        up, down = _text._BYTES.upto(len(c) + 1)
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(self.values[c] * up[: len(c)], out=total[1:])
        end = np.append(start[1:], len(c))
        h = _text.mix((total[end] - total[start]) * down[start])
        slot = (h >> np.uint64(44)).astype(np.int64)
        found = self.slot[slot]
        miss = np.flatnonzero(self.slot_key[slot] != h)
        if len(miss):
            own, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            known = self.known
            new = [i for i, x in enumerate(own.tolist()) if x not in known]
            at = miss[at[new]]
            parts = [text[i:j] for i, j in zip(start[at].tolist(), end[at].tolist())]
            encoded = [e.ids for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]
            count = np.array([len(x) for x in encoded], np.int64)
            if len(count) and count.max() >> 24:
                raise ValueError("a part of 2**24 ids or more")
            ends, more = self.used + np.cumsum(count), int(count.sum())
            if self.used + more > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(more, len(self.ids)), np.uint32)])
            self.ids[self.used : self.used + more] = np.fromiter(chain.from_iterable(encoded), np.uint32, more)
            self.used += more
            known.update(zip(own[new].tolist(), (ends - count << 24 | count).tolist()))
            got = np.array([known[x] for x in own.tolist()], np.int64)
            found[miss] = got[back]
            self.slot_key[slot[miss]], self.slot[slot[miss]] = h[miss], found[miss]
        return found >> 24, found & 0xFFFFFF


def encoder(path: str) -> Encoder:
    return _text.kept(path, lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer: str, size: int, keep_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, if asked for, ``ids`` (as
    little-endian unsigned 32-bit integers) of each piece of at most ``size`` ids; ``task``, which
    cut it, and ``nth``, its number from 0 among the task's pieces of this length. To be written
    before it is used: numbers hold for one run of the tasks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, numbers = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in _text.parts(batches, "text", keeps=tokenizer):
            if not batch.num_rows:
                continue
            ids, ends = encoder(tokenizer).encode(batch.column("text"))
            doc, start, length, crc, tokens, raw = [], [], [], [], [], []
            for i in range(batch.num_rows):
                own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(0)).astype("<u4").tobytes()
                n = len(own) // 4
                for a in range(0, n, size):
                    part = own[4 * a : 4 * (a + size)]
                    doc.append(i)
                    start.append(a)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    tokens.append(n)
                    raw.append(part)
            out = [batch.column("doc_id").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
            nth = []
            for x in length:
                nth.append(numbers[x])
                numbers[x] += 1
            out += [pa.array(np.full(len(doc), task, np.int32)), pa.array(nth, pa.int64())]
            out += [pa.array(raw, pa.binary())] if keep_ids else []
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth", "ids"][: len(out)])

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long" + (", ids binary" if keep_ids else "")
    return docs.mapInArrow(run, schema)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Shortest-pack-first: (lengths, number of packs) that together hold the histogram."""
    packs: dict[int, list[list]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in packs if r >= length and packs[r]), default=None)
            if room is None:
                packs.setdefault(size - length, []).append([(length,), left])
                break
            pack = packs[room][-1]
            n = min(left, pack[1])
            pack[1] -= n
            left -= n
            if not pack[1]:
                packs[room].pop()
            packs.setdefault(room - length, []).append([(*pack[0], length), n])
    return [(p, n) for room in sorted(packs) for p, n in packs[room] if n]


def _layout(histogram: dict[int, int], size: int) -> tuple[np.ndarray, ...]:
    """For each (length, pattern): the first rank, copies in a pack, first sequence, offset.

    A step of the placing either ends a length or replaces a pattern, so there are at most ``size``
    patterns; one has fewer than ``sqrt(2 * size)`` distinct lengths. For 1024, this is at most
    46,000 rows or 2 MB.
    """
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in patterns(histogram, size):
        offset = 0
        for length in dict.fromkeys(lengths):
            copies = lengths.count(length)
            rows.append((length, used.get(length, 0), copies, base, offset))
            used[length] = used.get(length, 0) + n * copies
            offset += length * copies
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return (table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (its place there) and, if asked for,
    ``ids``. Null or empty text is the closing id alone. Equal rows are packed apart. Other
    columns are not read. A run of letters or the like of 2**24 ids or more is an error.
    ``tokenizer`` is the path of a ``tokenizers`` file on every executor.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = materialize(pieces(docs, tokenizer, size, keep_ids), "pieces")
    counts = materialize(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    layout = spark.sparkContext.broadcast(_layout(histogram, size))

    # ranks among equal lengths: the task's own number after those of earlier tasks
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    counts = counts.select("length", "task", before.alias("before"))  # a row for each task and length; Spark joins it as its size asks
    rows = cut.join(counts, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, copies, base, offset = layout.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, (length << 44) + rank, "right") - 1
            k = rank - first[i]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(base[i] + k // copies[i]), pa.array(offset[i] + k % copies[i] * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{c} {cut.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
