"""Vectorised text primitives on Arrow buffers: slices of bounded size, words, rolling hashes.

Texts are seen as UTF-8 bytes. A slice joins whole texts of at most SLICE_BYTES together (a longer
text is a slice of its own), so that memory follows the slice and not the Arrow batch. Workers outlive their tasks;
`thrifty` makes them give back what a task has freed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

U64 = np.uint64
_rng = np.random.default_rng(0x9E3779B9)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0xD1342543DE82EF95
BASE_INV = pow(BASE, -1, 2**64)
WORD_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: True on the bytes that are not in a word of ASCII letters, digits and bytes from 0x80.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, SLICE_BYTES + 1)
        if m > 4 * SLICE_BYTES:  # a very long text: not kept
            return _accumulate(BASE, m), _accumulate(BASE_INV, m)
        _pow, _inv = _accumulate(BASE, m), _accumulate(BASE_INV, m)
    return _pow[:n], _inv[:n]


def _accumulate(base: int, n: int) -> np.ndarray:
    a = np.full(n, base, U64)
    a[0] = 1
    return np.multiply.accumulate(a)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits (in place on a fresh array)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string or binary array, without copying; nulls are empty."""
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not (large or pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        raise TypeError(f"text must be string or binary, not {col.type}")
    _, offs, data = col.buffers()
    if offs is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offs, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of whole texts."""
    i = batch.schema.get_field_index(text)
    buf, off = text_buffers(batch.column(i))
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(a, b - a), buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _trim = None


def release() -> None:
    """Gives freed memory back to the system; else Arrow's pool and malloc keep some hundred MB for a worker's next task, whichever that is."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, with memory given back when it ends, in whatever way."""

    @wraps(run)
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return runs


class Hasher:
    """Rolling hash of any byte range of a buffer: equal bytes, equal value."""

    def __init__(self, buf: np.ndarray):
        p, self.inv = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(BYTE_CODE[buf] * p[:-1], out=self.sums[1:])

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inv[a] + (b - a).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        """Of the k bytes from each position."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inv[:n]) if n > 0 else np.zeros(0, U64)


class Words:
    """Words of each text: start, end (byte positions in the buffer), count by text, first word of each text."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE):
        self.inside = inside = ~separators[buf]
        edge = np.ones(len(buf) + 1, bool)  # edge[i]: i-1 and i are not in one run
        if len(buf):
            edge[1:-1] = inside[1:] != inside[:-1]
            edge[off] = True
        self.start = np.flatnonzero(inside & edge[:-1]) if len(buf) else np.zeros(0, np.int64)
        self.end = np.flatnonzero(inside & edge[1:]) + 1 if len(buf) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Of n consecutive word hashes from each word; the caller leaves out those that leave the text."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = h[:m] * WORD_MULT[0]
    for j in range(1, n):
        out += h[j : j + m] * WORD_MULT[j]
    return mix(out)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    d = s[1:][s[1:] == s[:-1]]
    if not len(d):
        return np.zeros(len(keys), bool)
    d = np.unique(d)
    i = np.searchsorted(d, keys)
    i[i == len(d)] = 0
    return d[i] == keys


def covered(start: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n cells lie in any of the ranges."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + length, -1)
    return np.cumsum(d[:-1]) > 0


def id_array(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
