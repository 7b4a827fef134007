"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed greedily into the
longest phrases that occur in a language's text; the language needing the fewest phrases,
each weighed by the logarithm of the length of what it can point into, wins. The automata
are completed to tables (on a mismatch the phrase ends and the next one begins with the
character), so all texts and languages are parsed in step with array look-ups. Long texts
are parsed in lanes of ``SPAN`` characters, whose parses are joined to that of the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _scan, _text
from ._spark import carried, ship

#: Labelled rows a language that are looked at, and the characters of text that are learned.
SAMPLE_ROWS, SAMPLE_CHARS = 64, 20_000
SPAN = 1024
#: Languages that may be learned; more are an error (each costs up to 10 MB in every worker).
LANGUAGES = 500
_OTHER, _GAP = 0, 1  # letters that no language has; everything that is no letter


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def normal(text: str) -> str:
    """Lower-cased letters; everything between is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def automaton(text: np.ndarray, width: int) -> np.ndarray:
    """The suffix automaton of a text of symbols, as a table: (next state * 2 + 1 if a phrase
    ends before this symbol) by state and symbol. The last state is that after a symbol which the
    text doesn't have: a phrase by itself, which no symbol can go on."""
    size = 2 * len(text) + 2
    follow = np.full((size, width), -1, np.int32)
    link, longest = [-1], [0]
    last = 0
    for c in text.tolist():
        own = len(link)
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and follow[p, c] < 0:
            follow[p, c] = own
            p = link[p]
        if p >= 0:
            q = int(follow[p, c])
            if longest[q] == longest[p] + 1:
                link[own] = q
            else:
                clone = len(link)
                link.append(link[q])
                longest.append(longest[p] + 1)
                follow[clone] = follow[q]
                while p >= 0 and follow[p, c] == q:
                    follow[p, c] = clone
                    p = link[p]
                link[q] = link[own] = clone
        last = own
    follow = follow[: len(link)]
    first = np.where(follow[0] >= 0, follow[0], len(link))
    out = np.where(follow >= 0, follow * 2, first * 2 + 1)
    out[0] = first * 2  # no phrase is open at the start
    return np.vstack([out, first * 2 + 1]).astype(np.int32)


class Model:
    """Automata of all languages in one table."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letters = sorted({c for t in samples.values() for c in t if c != " " and ord(c) < 0x10000})
        self.width = len(letters) + 2
        self.symbol = np.full(0x10000, _GAP, np.uint16)
        number = {c: i + 2 for i, c in enumerate(letters)}
        for c in range(0x10000):
            x = chr(c)
            if x.isalpha():
                self.symbol[c] = number.get(x.lower()[0], _OTHER)
        tables, self.roots, self.alone, self.weight = [], [], [], []
        for name in self.languages:
            text = np.array([number.get(c, _GAP) for c in samples[name]], np.int64)
            self.roots.append(sum(len(t) for t in tables))
            tables.append(automaton(text, self.width) + 2 * self.roots[-1])
            self.alone.append(self.roots[-1] + len(tables[-1]) - 1)
            self.weight.append(math.log2(len(text) + 2))
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def phrases(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by text and language, letters by text, completed phrases by text and language)."""
        data, offsets = _text.buffers(column)
        c = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        s = self.symbol[np.minimum(c, 0xFFFF)]
        for i in np.flatnonzero(c > 0xFFFF):
            s[i] = _OTHER if chr(c[i]).isalpha() else _GAP
        edge = np.zeros(len(c) + 1, bool)
        edge[first] = True
        letter = s != _GAP
        keep = letter.copy()
        keep[1:] |= ~letter[1:] & letter[:-1] & ~edge[1 : len(c)]  # one gap for many, none at the start
        total = np.append(0, np.cumsum(keep))
        letters = np.append(0, np.cumsum(letter))[first]
        s, first = s[keep], total[first]
        n = np.diff(first)
        lanes = -(-n // SPAN)
        doc = np.repeat(np.arange(len(n)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = first[doc] + nth * SPAN
        length = np.minimum(n[doc] - nth * SPAN, SPAN)
        out = np.ones((len(n), len(self.languages)), np.int64)  # the last phrase is open
        complete = np.zeros_like(out)  # but if it is a letter that the language doesn't have
        final = nth + 1 == np.repeat(lanes, lanes)

        def step(state: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            got = self.table[state * self.width + s[place]]
            return got >> 1, got & 1

        for i in range(0, len(self.languages), 8):
            root = np.array(self.roots[i : i + 8], np.int64)
            last = root
            for a, b in _scan.groups(length):
                follows = nth[a:b] > 0
                init = np.repeat(root[:, None], b - a, 1)
                if follows[0]:
                    follows[0], init[:, 0] = False, last
                count, state = _scan.scan(step, root, init, begin[a:b], length[a:b], follows)
                np.add.at(out, (doc[a:b, None], i + np.arange(len(root))), count.T)
                last = state[:, -1]
                ends = np.flatnonzero(final[a:b])
                complete[doc[a + ends][:, None], i + np.arange(len(root))] = (state[:, ends] == np.array(self.alone[i : i + 8])[:, None]).T
        return out, np.diff(letters), out - 1 + complete

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, completed phrases a letter) by text."""
        phrases, letters, complete = self.phrases(column)
        if not self.languages:
            return ["und"] * len(letters), np.zeros(len(letters)), np.zeros(len(letters))
        cost = phrases * np.array(self.weight)
        best = cost.argmin(1)
        least = np.take_along_axis(cost, best[:, None], 1)[:, 0]
        others = np.sort(cost, 1)[:, 1] if cost.shape[1] > 1 else 2 * least
        ok = letters > 0
        score = np.where(ok, 1 - least / np.maximum(others, 1e-9), 0.0)
        # the last phrase is open: a text that fits as a whole has completed none
        rate = np.where(ok, np.take_along_axis(complete, best[:, None], 1)[:, 0] / np.maximum(letters, 1), 0.0)
        return [self.languages[i] if y else "und" for i, y in zip(best, ok)], score, rate


def pieces(texts: list[tuple[int, str]]) -> list[str]:
    """Of each ``(hash, text)`` an equal share of ``SAMPLE_CHARS``, with a space after each; what
    short texts leave goes to the longer ones."""
    share, left = {}, SAMPLE_CHARS
    order = sorted(range(len(texts)), key=lambda i: len(texts[i][1]))
    for done, i in enumerate(order):
        share[i] = min(len(texts[i][1]), max(0, left // (len(texts) - done) - 1))
        left -= share[i] + 1
    out = []
    for i, (h, text) in enumerate(texts):
        at = h % (len(text) - share[i] + 1)
        out.append(text[at : at + share[i]])
    return [x for x in out if x]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of at most ``SAMPLE_ROWS`` rows a language (those whose ids have the smallest
    hashes) of rows not held out, up to ``SAMPLE_CHARS`` characters a language: short texts whole,
    and of each longer one a piece of equal length, from a place that the id's hash gives. An id that
    repeats counts once, with the text of the smallest hash. More than ``LANGUAGES`` languages
    are an error."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    nth = F.row_number().over(Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), id_col))
    few = rows.select(id_col, lang_col).withColumn("nth", nth).where(F.col("nth") <= SAMPLE_ROWS).select(id_col)
    picked = few.distinct().limit(LANGUAGES * SAMPLE_ROWS + 1).collect()
    if len(picked) > LANGUAGES * SAMPLE_ROWS:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not picked:
        return Model({})
    # one text for each language and id, that of the smallest hash
    rows = rows.where(F.col(id_col).isin([r[0] for r in picked])).select(F.col(lang_col).alias("l"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    rows = rows.groupBy("l", "i").agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("l", "i", "t", F.xxhash64("i").alias("h"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in rows.orderBy("h", "i").collect():
        texts.setdefault(r.l, []).append((r.h, normal(r.t)))
    return Model({k: " ".join(pieces(v)) for k, v in texts.items() if any(t for _, t in v)})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """One row per document row: ``doc_id``, ``text``, ``lang_pred``, ``score`` (how many per cent
    fewer weighed phrases than for the next language, 0 to 1) and ``rate`` (completed
    phrases a letter). Null texts and those without letters are ``und`` with score 0. Languages that tie
    go by name. Without labelled rows all is ``und``. The columns ``carry`` come
    along as a struct ``_carried``; others are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried(carry))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.parts(batches, "text"):
            if b.num_rows:
                languages, score, rate = shared.value.predict(b.column("text"))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(languages, pa.string()), pa.array(score), pa.array(rate)], [*names, "lang_pred", "score", "rate"])

    return docs.mapInArrow(run, StructType([*docs.schema, *StructType.fromDDL("lang_pred string, score double, rate double")]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
