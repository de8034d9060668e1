"""Word spans and 64-bit word hashes over Arrow string columns, without a Python object per word.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 text can be cut at those bytes. All
arrays cover a slice of whole documents of about ``SLICE_BYTES`` (a longer document is a slice of
its own), so memory does not depend on the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
HASH_BYTES = 1 << 20
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BYTE[_SPACE] = 0
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two xor-shift / multiply rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


@dataclass
class Slice:
    """Whole documents ``first .. first + n_docs`` of a batch."""

    first: int
    n_docs: int
    data: np.ndarray  # uint8
    bounds: np.ndarray  # n_docs + 1 byte positions in data

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of a string column; null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = arr.buffers()
    n = len(arr)
    if n == 0:
        return
    offsets = np.frombuffer(offs, np.int64)[arr.offset:arr.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield Slice(i, j - i, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # document of the slice
    hash: np.ndarray  # uint64
    first: np.ndarray  # n_docs + 1: positions of each document's words


def words(s: Slice, fold_case: bool = False) -> Words:
    """Spans and hashes of the words of a slice; ``fold_case`` reads A-Z as a-z."""
    inside = ~_SPACE[s.data]
    n = len(s.data)
    if not inside.any():
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), np.zeros(s.n_docs + 1, np.int64))
    edge = np.zeros(n + 1, bool)
    edge[s.bounds] = True  # no word crosses from one document into the next
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, s.bounds)
    doc = np.repeat(np.arange(s.n_docs), np.diff(first))
    return Words(start, end, doc, _hashes(s.data, start, end, _FOLDED if fold_case else _BYTE), first)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    power = powers(int((end - start).max()))
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + HASH_BYTES, "right")))
        at, last = start[i:j], end[j - 1]
        stop = np.append(at[1:], last)
        place = np.arange(at[0], last) - np.repeat(at, stop - at)
        np.minimum(place, len(power) - 1, out=place)  # only white space lies beyond the words
        out[i:j] = np.add.reduceat(table[data[at[0]:last]] * power[place], at - at[0])
        i = j
    return mix(out + (end - start).astype(np.uint64))


def windows(h: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (across documents too)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, p in enumerate(powers(width, U64(base))):
        out += h[k:k + n] * p
    return mix(out)
