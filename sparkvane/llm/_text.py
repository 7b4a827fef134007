"""Vectorised text kernels over Arrow string buffers.

A batch of texts is one UTF-8 byte buffer with offsets. Words are found with byte tables
and hashed with one prefix sum (a polynomial hash over random byte values, modulo 2**64),
so no Python code runs per word. Buffers are taken in segments of bounded size that end
between words; a text of any length costs memory in proportion to its words only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    out[1:] = _U(base)
    return np.cumprod(out)


class _Roll:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 12)
            self.up, self.down = _powers(self.base, self.n), _powers(self.inverse, self.n)
        return self.up, self.down


_BYTES, _WORDS = _Roll(_BASE), _Roll(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all bits of the sum."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def byte_values(seed: int = 1) -> np.ndarray:
    """A random 64-bit value per byte; A-Z share those of a-z."""
    v = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    v[65:91] = v[97:123]
    return v


BYTE_VALUES = byte_values()
#: ``[^\\x20\\x09-\\x0D]``
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: glibc keeps most of what numpy frees; other C libraries have no such call.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_KEPT: dict[str, Any] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """What tasks of one operator share in a worker, made when it is first asked for. It goes when the
    worker takes :func:`parts` for another one."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def parts(batches: Iterator[pa.RecordBatch], text: str, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """:func:`slices` of all batches of a task. Workers outlive tasks and stages, so what others left
    in this one but ``keeps`` goes before the first, and free memory after the last."""
    for key in [x for x in _KEPT if x != keeps]:
        del _KEPT[key]
    for batch in batches:
        yield from slices(batch, text)
    batch = None
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most ``most`` bytes of text, or a single longer row. Small
    pieces bound what a worker holds; after a batch, free Arrow memory goes back."""
    _, offsets = buffers(batch.column(text))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words (longest runs of bytes that ``table`` holds) of all texts: 64-bit hashes
    with A-Z lower-cased, start and end byte, and for each text the number of its first word
    (with one more entry at the end)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, _U), z, z, np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    hashes, starts, ends = [], [], []
    a = 0
    while a < n:
        b, step = min(n, a + SEGMENT), SEGMENT
        while b < n:  # back to the last place between two words
            cut = np.flatnonzero(~table[data[b - SEGMENT : b]] | edge[b - SEGMENT : b])
            if len(cut):
                b = b - SEGMENT + int(cut[-1])
                if b > a:
                    break
                b = a
            step += SEGMENT
            b = min(n, a + step)
        h, s, e = _segment(data[a:b], table, edge[a : b + 1])
        hashes.append(h)
        starts.append(s + a)
        ends.append(e + a)
        a = b
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets)


def _segment(data: np.ndarray, table: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _BYTES.upto(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start, end


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each word on; the caller leaves out those that pass
    the end of a text."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    if n == 1:
        return hashes
    out = np.empty(count, _U)
    for a in range(0, count, SEGMENT):
        part = hashes[a : min(len(hashes), a + SEGMENT + n - 1)]
        up, down = _WORDS.upto(len(part) + 1)
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(part * up[: len(part)], out=total[1:])
        k = len(part) - n + 1
        out[a : a + k] = mix((total[n:] - total[:k]) * down[:k])
    return out
