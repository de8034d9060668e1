"""Packed arrays: byte strings and small numbers in few bytes, for what tasks send to one another."""

from __future__ import annotations

import numpy as np
import zstandard


def planes(a: np.ndarray) -> bytes:
    """uint32 values byte plane by byte plane, which compresses far better than value by value."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def pack(parts: list[bytes]) -> bytes:
    """Byte strings as lengths and content, compressed."""
    lengths = np.fromiter(map(len, parts), np.uint32, len(parts))
    return zstandard.ZstdCompressor(level=9).compress(
        np.uint32(len(parts)).tobytes() + planes(lengths) + b"".join(parts))


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, content) of packed byte strings."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    n = int(data[:4].view(np.uint32)[0])
    lengths = from_planes(data[4:4 + 4 * n])
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), data[4 + 4 * n:]


def pack_places(places: np.ndarray) -> bytes:
    """Places of a block of documents; those below 255 take one byte."""
    return pack([np.minimum(places, 255).astype(np.uint8).tobytes(), planes(places[places >= 255] - 255)])


def unpack_places(raw: bytes) -> np.ndarray:
    bounds, data = unpack(raw)
    low = data[bounds[0]:bounds[1]]
    places = low.astype(np.uint32)
    places[low == 255] += from_planes(data[bounds[1]:bounds[2]])
    return places


def gather(bounds: np.ndarray, content: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate content[bounds[p]:bounds[p + 1]] over ``places``; (bounds of the result, result)."""
    size = bounds[places + 1] - bounds[places]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(bounds[places] - ends[:-1], size)
    return ends, content[at]


class Places(dict):
    """Words in the order in which they were first seen."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n
