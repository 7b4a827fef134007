"""Benchmark decontamination: a hash set of normalised benchmark n-grams, scanned over
every word window of the documents; each hash hit is verified on the words themselves.

The set is sorted arrays of hashes and of places in one buffer of normalised benchmark text.
It is broadcast while these take at most ``broadcast_bytes``; beyond that, hashes of candidate
windows are shuffled and joined to the benchmark's by hash, and hits verified afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _text
from ._spark import BROADCAST_BYTES, carried, materialize, ship

#: Bits of a hash that filters look at: 16 places for each window, at most 64 MB of bits.
_LEAST_BITS, _MOST_BITS, _SECTION_BITS = 16, 29, 20
#: Memory of a window and of an item in the broadcast set, beside the text.
_WINDOW_BYTES, _ITEM_BYTES = 32, 128


def _bits(windows: int) -> int:
    return int(min(max((16 * windows).bit_length(), _LEAST_BITS), _MOST_BITS))


def _low(data: bytes) -> bytes:
    return data.lower()  # A-Z only


def _normal(data: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    return _low(b" ".join(data[a:b] for a, b in zip(start, end)))


class Windows:
    """All windows of all items: for each window length, sorted hashes, and for each of these
    the item and where its words are in ``text``."""

    def __init__(self, texts: list[str], n: int):
        kept, at = [], 0
        found: dict[int, list[np.ndarray]] = {}
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            data = np.frombuffer(raw, np.uint8)
            h, s, e, _ = _text.words(data, np.array([0, len(data)]), _text.ALNUM)
            if not len(h):
                continue
            own = _normal(raw, s, e)  # words with one blank between
            first = at + np.append(0, np.cumsum(e - s + 1))[:-1]
            last = first + (e - s)
            w = min(n, len(h))
            x = _text.windows(h, w)
            found.setdefault(w, []).append(np.stack([x.view(np.int64), np.full(len(x), i), first[: len(x)], last[w - 1 :]]))
            kept.append(own)
            at += len(own) + 1
        self.text = b" ".join(kept)
        self.known = {}
        for w, parts in found.items():
            x, item, first, last = np.concatenate(parts, 1)
            x = x.view(np.uint64)
            order = np.lexsort((item, x))
            self.known[w] = x[order], item[order].astype(np.int32), first[order], last[order]

    def items(self, w: int, x: int, window: bytes) -> frozenset[int]:
        """The items that have a window of these words."""
        h, item, first, last = self.known[w]
        a, b = np.searchsorted(h, _text._U(x)), np.searchsorted(h, _text._U(x), "right")
        return frozenset(int(item[i]) for i in range(a, b) if self.text[first[i] : last[i]] == window)


def _item_windows(texts: list[str], n: int) -> Iterator[tuple[int, int, bytes, int]]:
    """(item, window length, normalised window, hash) of each item's windows."""
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        data = np.frombuffer(raw, np.uint8)
        h, s, e, _ = _text.words(data, np.array([0, len(data)]), _text.ALNUM)
        if len(h):
            w = min(n, len(h))
            for j, x in enumerate(_text.windows(h, w).tolist()):
                yield i, w, _normal(raw, s[j : j + w], e[j : j + w]), x


def _filter(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A flag per hash prefix: one look-up rules out almost every window."""
    out = np.zeros(1 << bits, bool)
    out[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
    return out


def _candidates(h: np.ndarray, first: np.ndarray, w: int, known: np.ndarray, flags: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers at which a known window of ``w`` words may start, hashes)."""
    x = _text.windows(h, w)
    at = np.flatnonzero(flags[(x >> np.uint64(64 - bits)).astype(np.int64)])
    k = np.minimum(np.searchsorted(known, x[at]), len(known) - 1)
    at = at[known[k] == x[at]]
    doc = np.searchsorted(first, at, "right") - 1
    at = at[at + w <= first[doc + 1]]
    return at, x[at]


def _spans(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _without(raw: bytes, spans: list[tuple[int, int]], start: np.ndarray, end: np.ndarray) -> str:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : start[a]])
        at = end[b - 1]
    return b"".join([*kept, raw[at:]]).decode()


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               ngram: int = 13, keep_text: bool = False, broadcast_bytes: int = BROADCAST_BYTES, carry: list[str] = ()) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_words``, ``spans`` (hit words as half-open
    ranges of word numbers), ``items`` (item ids as sorted strings) and, if asked for,
    ``cleaned``: the text without the spans.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
    lower-cased. An item of fewer than ``ngram`` words is one window; an item without words
    has none. Null texts have no words. Rows with equal ids are handled apart; items that share
    an id count as one, items without id hit words but are not in ``items``. The columns ``carry`` come along as a struct ``_carried``; others are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried(carry))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
    schema += ", cleaned string" if keep_text else ""
    schema = StructType([*StructType.fromDDL(schema), *(f for f in base.schema if f.name == "_carried")])
    columns = ["doc_id", "n_words", "spans", "items", *(["cleaned"] if keep_text else []), *(["_carried"] if carry else [])]
    if _memory(items) > broadcast_bytes:
        return _by_join(base, items, ngram, keep_text, schema, columns)

    rows = items.collect()
    names = [r.item for r in rows]
    index = spark.sparkContext.broadcast((names, Windows([r.text for r in rows], ngram)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, windows = index.value
        filters = {w: (x[0], _filter(x[0], _bits(len(x[0]))), _bits(len(x[0]))) for w, x in windows.known.items()}
        met: dict[tuple[int, bytes], frozenset[int]] = {}
        for batch in _text.parts(batches, "text"):
            column = batch.column("text")
            data, offsets = _text.buffers(column)
            h, start, end, first = _text.words(data, offsets, _text.ALNUM)
            hits: dict[int, list[tuple[int, int]]] = {}
            found: dict[int, set[int]] = {}
            if len(met) > 100_000:
                met.clear()
            for w, known in filters.items():
                for a, x in zip(*(y.tolist() for y in _candidates(h, first, w, *known))):
                    window = _low(b" ".join(data[p:q].tobytes() for p, q in zip(start[a : a + w], end[a : a + w])))
                    if (w, window) not in met:
                        met[w, window] = windows.items(w, x, window)
                    if own := met[w, window]:
                        d = int(np.searchsorted(first, a, "right")) - 1
                        hits.setdefault(d, []).append((a, a + w))
                        found.setdefault(d, set()).update(own)
            spans = {d: _spans(x) for d, x in hits.items()}
            out = [batch.column("doc_id"), pa.array(np.diff(first))]
            out.append(pa.array([[{"start": a - int(first[d]), "end": b - int(first[d])} for a, b in spans.get(d, ())] for d in range(len(column))], _SPAN))
            out.append(pa.array([sorted({names[i] for i in found.get(d, ()) if names[i] is not None}) for d in range(len(column))], pa.list_(pa.string())))
            if keep_text:
                texts = column.to_pylist() if spans else column
                for d, x in spans.items():
                    texts[d] = _without(data[offsets[d] : offsets[d + 1]].tobytes(), x, start - offsets[d], end - offsets[d])
                out.append(pa.array(texts, pa.string()) if spans else column)
            out += [batch.column("_carried")] if carry else []
            yield pa.RecordBatch.from_arrays(out, columns)

    return base.mapInArrow(scan, schema)


def _memory(items: DataFrame) -> int:
    """Bytes that :class:`Windows` of the items take."""
    word = F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    n, size, words = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(word), F.lit(0))).first()
    return n * _ITEM_BYTES + size + words * _WINDOW_BYTES


def _by_join(base: DataFrame, items: DataFrame, ngram: int, keep_text: bool, schema: StructType, columns: list[str]) -> DataFrame:
    """The same result without a broadcast set: windows of both sides meet by hash.

    Hashes of document windows pass a filter (16 flags a window, at most 64 MB) before they are
    shuffled; hot windows are spread by Spark's skew join. Words are compared last, so the
    text of windows is shuffled for hits only.
    """
    spark = base.sparkSession

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, texts = b.column("item").to_pylist(), b.column("text").to_pylist()
            for name, text in zip(names, texts):
                one = Windows([text], ngram)
                for w, (h, _, first, last) in one.known.items():
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(np.full(len(h), w, np.int32)), pa.array([one.text[p:q].decode() for p, q in zip(first, last)], pa.string()), pa.array(h.view(np.int64))], ["item", "w", "window", "h"])

    windows = items.mapInArrow(item_windows, "item string, w int, window string, h long")
    windows = materialize(windows.groupBy("h", "w", "window").agg(F.collect_set("item").alias("items")), "windows")
    sizes = {r.w: r["count"] for r in windows.groupBy("w").count().collect()}  # at most ngram rows
    bits = _bits(sum(sizes.values()))
    section = max(0, bits - _SECTION_BITS)

    def flags(t: pa.Table) -> pa.Table:
        out = np.zeros(1 << (bits - section), bool)
        out[t["low"].to_numpy()] = True
        return pa.table({"section": t["section"][:1], "flags": pa.array([np.packbits(out).tobytes()], pa.binary())})

    prefix = F.shiftrightunsigned("h", 64 - bits)
    low = prefix.bitwiseAND(F.lit((1 << (bits - section)) - 1))
    places = windows.select(F.shiftright(prefix, bits - section).alias("section"), low.alias("low")).distinct()
    held = np.zeros(1 << max(bits - 3, 0), np.uint8)
    part = 1 << (bits - section - 3)
    for r in places.groupBy("section").applyInArrow(flags, "section long, flags binary").collect():  # 2**section rows, 64 MB at most
        held[r.section * part : (r.section + 1) * part] = np.frombuffer(r.flags, np.uint8)
    packed = spark.sparkContext.broadcast(held)

    def document_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = packed.value
        for batch in _text.parts(batches, "text"):
            data, offsets = _text.buffers(batch.column("text"))
            h, start, end, first = _text.words(data, offsets, _text.ALNUM)
            for w in sizes:
                x = _text.windows(h, w)
                p = (x >> np.uint64(64 - bits)).astype(np.int64)
                at = np.flatnonzero((held[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1)
                doc = np.searchsorted(first, at, "right") - 1
                ok = at + w <= first[doc + 1]
                at, doc = at[ok], doc[ok]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(doc)), pa.array(at - first[doc]), pa.array(np.full(len(at), w, np.int32)), pa.array(x[at].view(np.int64))], ["row", "a", "w", "h"])

    # a row is known by its id and its text's hash: equal rows have equal windows
    keyed = base.withColumn("row", F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("v")))
    kind = keyed.schema["row"].dataType.simpleString()
    seen = keyed.select("row", "text").distinct().mapInArrow(document_windows, f"row {kind}, a long, w int, h long")
    hits = seen.join(windows, ["h", "w"]).groupBy("row").agg(F.collect_set(F.struct("a", "w", "window", "items")).alias("at"))
    joined = keyed.join(hits, keyed["row"].eqNullSafe(hits["row"]), "left").select(*base.columns, "at")
    carry = "_carried" in base.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.parts(batches, "text"):
            column = batch.column("text")
            data, offsets = _text.buffers(column)
            _, start, end, first = _text.words(data, offsets, _text.ALNUM)
            at, items = [], []
            for d, row in enumerate(batch.column("at").to_pylist()):
                s, e = start[first[d] : first[d + 1]], end[first[d] : first[d + 1]]
                sure = [x for x in row or () if _low(b" ".join(data[p:q].tobytes() for p, q in zip(s[x["a"] : x["a"] + x["w"]], e[x["a"] : x["a"] + x["w"]]))) == x["window"].encode()]
                at.append(_spans([(x["a"], x["a"] + x["w"]) for x in sure]))
                items.append(sorted({i for x in sure for i in x["items"]}))
            out = [batch.column("doc_id"), pa.array(np.diff(first)), pa.array([[{"start": a, "end": b} for a, b in x] for x in at], _SPAN), pa.array(items, pa.list_(pa.string()))]
            if keep_text:
                texts = column.to_pylist()
                for d, x in enumerate(at):
                    if x:
                        own = slice(first[d], first[d + 1])
                        texts[d] = _without(data[offsets[d] : offsets[d + 1]].tobytes(), x, start[own] - offsets[d], end[own] - offsets[d])
                out.append(pa.array(texts, pa.string()))
            out += [batch.column("_carried")] if carry else []
            yield pa.RecordBatch.from_arrays(out, columns)

    return joined.mapInArrow(finish, schema)


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.05, **options) -> DataFrame:
    """``doc_id``, ``text`` of the documents of which less than ``share`` of the words are
    hit, without the hit spans; the others go."""
    found = find_leaks(docs, benchmark, keep_text=True, **options)
    return found.where((n_hit() == 0) | (n_hit() < share * F.col("n_words"))).select("doc_id", F.col("cleaned").alias("text"), *(["_carried"] if options.get("carry") else []))


def query(spark, sf_dir: str) -> DataFrame:
    found = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.withColumn("n_hit", n_hit())
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH item AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
known AS (SELECT DISTINCT item_id::VARCHAR AS item, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS win FROM item),
doc AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
place AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS win
    FROM doc, (SELECT DISTINCT k FROM known)),
hit AS (SELECT doc_id, i, place.k, item FROM place JOIN known ON place.k = known.k AND place.win = known.win),
word AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256,
    coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN word h ON d.doc_id = h.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""
