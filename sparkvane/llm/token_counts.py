"""Token counts by a compiled finite-state tokenizer.

For byte-pair merging by piece score, the tokens of a prefix of a text determine those of
the next longer prefix: its last token is the one piece that ends there and that merging
leaves next to the last token of what comes before. Which pieces may still complete depends
on a bounded suffix only, so a deterministic transducer reads the text once; a transition
carries how the number of tokens changes. Transitions are compiled when first needed and
kept per worker, in a table of bounded size.

Texts are cut into chunks that run in step with array look-ups. No piece goes on after a word,
so at a word's first space the transducer is in its start state, and what a chunk that ends
there does to the state is a constant map. A chunk without such a place is cut anywhere; the
state maps of these chunks compose as :mod:`._scan` says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scan, _text
from ._spark import ship

MARK = "▁"
#: Least characters of a chunk that ends before a word, most of any, and states, transitions,
#: pieces and pairs of pieces that a worker keeps (and as many more as one segment adds).
CHUNK, MOST, STATES = 256, 1024, 300_000
_SLOTS = 21
_BIAS = 1 << 20


class Transducer:
    """Counts tokens as a ``sentencepiece`` BPE model with byte fallback does."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("pieces that go on after a word can't be cut at spaces")
        self.prefixes = {p[:i] for p in self.score for i in range(1, len(p))}
        self.clear()

    def clear(self) -> None:
        self.whole: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.states: list[tuple] = [((), None)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.known: dict[int, int] = {}
        self.keys, self.values = np.full(1 << _SLOTS, -1, np.int64), np.zeros(1 << _SLOTS, np.int64)

    def merge(self, text: str) -> list[str]:
        """The pieces of a text by merging, best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((-self.score[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def is_token(self, piece: str) -> bool:
        if piece not in self.whole:
            self.whole[piece] = piece in self.score and len(self.merge(piece)) == 1
        return self.whole[piece]

    def may_follow(self, a: str | None, b: str) -> bool:
        """Whether merging leaves these two tokens as they are."""
        if a is None:
            return True
        if (a, b) not in self.pairs:
            self.pairs[a, b] = self.merge(a + b) == [a, b]
        return self.pairs[a, b]

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """A state: for each suffix that may still become a piece, longest first, the token
        before it and how many tokens fewer end there; and the last token."""
        suffixes, last = state
        if char == MARK and last and last[-1] != MARK:
            suffixes, last = (), None
        grown = [(s + char, before, d) for s, before, d in suffixes] + [(char, last, 0)]
        for piece, before, d in grown:
            if self.is_token(piece) and self.may_follow(before, piece):
                more = d + 1
                return (tuple((s, b, x - more) for s, b, x in grown if s in self.prefixes), piece), more
        return self.states[0], len(char.encode())  # byte fallback; nothing merges with it

    def _bound(self, last: int) -> int:
        """Forgets what is compiled if it is much, but for one state; its number."""
        if max(len(self.states), len(self.known) // 4, len(self.whole), len(self.pairs)) <= STATES:
            return last
        state = self.states[last]
        self.clear()
        return self._number(state)

    def _number(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state]

    def _compile(self, key: int) -> int:
        if key not in self.known:
            state, more = self.step(self.states[key >> 21], chr(key & 0x1FFFFF))
            self.known[key] = self._number(state) << 21 | (more + _BIAS)
        return self.known[key]

    def _look_up(self, key: np.ndarray) -> np.ndarray:
        a = (key * np.int64(-7046029254386353131) >> np.int64(64 - _SLOTS)) & ((1 << _SLOTS) - 1)
        out = self.values[a]
        miss = np.flatnonzero(self.keys[a] != key)
        if len(miss):
            want = key[miss]
            b = (want * np.int64(-4417276706812531889) >> np.int64(64 - _SLOTS)) & ((1 << _SLOTS) - 1)
            out[miss] = self.values[b]
            still = np.flatnonzero(self.keys[b] != want)
            if len(still):
                own, back = np.unique(want[still], return_inverse=True)
                got = np.array([self._compile(k) for k in own.tolist()], np.int64)
                out[miss[still]] = got[back]
                at = (own * np.int64(-7046029254386353131) >> np.int64(64 - _SLOTS)) & ((1 << _SLOTS) - 1)
                other = (own * np.int64(-4417276706812531889) >> np.int64(64 - _SLOTS)) & ((1 << _SLOTS) - 1)
                at = np.where(self.keys[at] < 0, at, other)
                self.keys[at], self.values[at] = own, got
        return out

    def count(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        data, offsets = _text.buffers(column)
        c = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        full = np.flatnonzero(np.diff(first))
        out = np.zeros(len(column), np.int64)
        if not len(full):
            return out
        c = np.insert(np.where(c == 32, np.uint32(ord(MARK)), c), first[:-1][full], ord(MARK))  # the model's dummy prefix
        text = first[:-1][full] + np.arange(len(full))
        cut = c == ord(MARK)
        cut[1:] &= c[:-1] != ord(MARK)
        cut = np.flatnonzero(cut)
        cut = cut[np.append(True, np.diff(cut // CHUNK) > 0)]
        start = np.union1d(cut, text)
        length = np.diff(np.append(start, len(c)))
        parts = -(-length // MOST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(start, parts) + nth * MOST
        length = np.minimum(np.repeat(length, parts) - nth * MOST, MOST)

        def step(state: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            got = self._look_up((state << 21 | c[place].astype(np.int64)).ravel()).reshape(state.shape)
            return got >> 21, (got & 0x1FFFFF) - _BIAS

        last, root = 0, np.zeros(1, np.int64)
        for a, b in _scan.groups(length):
            last = self._bound(last)
            follows, init = nth[a:b] > 0, np.zeros((1, b - a), np.int64)
            if follows[0]:
                follows[0], init[0, 0] = False, last
            total, state = _scan.scan(step, root, init, start[a:b], length[a:b], follows)
            np.add.at(out, full[np.searchsorted(text, start[a:b], "right") - 1], total[0])
            last = int(state[0, -1])
        return out


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens``, without begin or
    end tokens; a null text is empty. Other columns are not read. ``model`` is the path of a
    sentencepiece BPE model (identity normalisation, dummy prefix, byte fallback) on every
    executor."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for x in batches for s in _text.slices(x, "text")):
            if b.num_rows:
                _, offsets = _text.buffers(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(compiled(model).count(b.column("text")))], ["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)
