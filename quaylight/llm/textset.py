"""Shingle sets of whole texts, computed over flat byte buffers in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_RADIX = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64, at least n of them."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", _RADIX), ("down", pow(_RADIX, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `size` bytes, one document at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, and the n + 1 word offsets of the documents."""
    n = data.size
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    word = ~_SPACE[low]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[low] * up[:n], out=total[1:])
    return mix64((total[end] - total[start]) * down[start]), np.searchsorted(start, offsets)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of `width` words as sorted 64-bit hashes.

    A text of fewer words is one shingle of all its words; a text without words has none.
    """
    data, offsets = buffers(texts)
    mult = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(_RADIX)) | np.uint64(1)
    for a, b in chunks(offsets):
        hashes, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        m = max(0, hashes.size - width + 1)
        grams = np.zeros(m, np.uint64)
        for j in range(width):
            grams += hashes[j : j + m] * mult[j]
        grams = mix64(grams)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            if e - s >= width:
                yield np.unique(grams[s : e - width + 1])
            elif e > s:
                with np.errstate(over="ignore"):
                    whole = np.sum(hashes[s:e] * mult[: e - s], dtype=np.uint64) + np.uint64(e - s)
                yield mix64(np.array([whole], np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            else:
                yield np.zeros(0, np.uint64)
