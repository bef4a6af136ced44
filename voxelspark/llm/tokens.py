"""Vectorised word hashing over batches of whole texts.

A batch of texts becomes one byte buffer.  ``A``-``Z`` are lower-cased, words are the maximal runs of
bytes outside ``\\x20`` and ``\\x09``-``\\x0d``, and every word gets a 64-bit hash: a polynomial in an odd base modulo
2**64, read off prefix sums of the buffer, then mixed.  There is no Python loop per word or per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes worked on at once; a longer text makes a block of its own.
BLOCK_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _LOWER[raw]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shifts and odd multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.empty(n, np.uint64)
    up[0], inverse = 1, np.uint64(pow(int(BASE), -1, 1 << 64))
    up[1:] = BASE
    down = up.copy()
    down[1:] = inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below the next power of two over n."""
    return _powers(1 << max(20, int(n).bit_length()))


class Words:
    """The words of consecutive texts: ``hash`` per word, ``first[i]:first[i + 1]`` are those of text i, ``begin`` and ``close`` bound their bytes."""

    __slots__ = ("begin", "close", "first", "hash")

    def __init__(self, hash_: np.ndarray, first: np.ndarray, begin: np.ndarray, close: np.ndarray):
        self.hash, self.first, self.begin, self.close = hash_, first, begin, close


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.type not in (pa.large_binary(), pa.large_string()):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most so many bytes together, or one text alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(end, n)
        start = end


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, between: np.ndarray = _SPACE) -> Words:
    """Hashed words of the texts whose bytes are ``raw[offsets[i]:offsets[i + 1]]``.

    lower: whether A-Z count as a-z; between: for each byte, whether it stands between words.
    """
    n = len(raw)
    space = np.ones(n + 1, bool)
    space[:n] = between[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n + 1, bool)
    before[1:] = space[:-1]
    begin = np.flatnonzero(~space & (before | edge))
    # A word ends before the next space, or where the next text begins.
    close = np.flatnonzero(~before & (space | edge))
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(((_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashed = mix((total[close] - total[begin]) * down[begin])
    return Words(hashed, np.searchsorted(begin, offsets), begin, close)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles (with repeats) and their bounds per text.

    A text of one to k - 1 words has one shingle, its whole sequence; one without words has none.
    """
    n = np.diff(w.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    bound = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=bound[1:])
    if not bound[-1]:
        return np.empty(0, np.uint64), bound
    step = [np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64)) for j in range(k)]
    full = np.zeros(len(w.hash), np.uint64)
    size = max(0, len(full) - k + 1)
    for j in range(k):
        full[:size] += w.hash[j : j + size] * step[j]
    at = np.arange(bound[-1]) + np.repeat(w.first[:-1] - bound[:-1], count)
    out = mix(full[at])
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = w.hash[w.first[i] : w.first[i + 1]]
        out[bound[i]] = mix((own * np.array(step[: len(own)], np.uint64)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, bound


def distinct(values: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each range, and the new bounds."""
    out, size = [], np.zeros(len(bound), np.int64)
    for i in range(len(bound) - 1):
        own = np.sort(values[bound[i] : bound[i + 1]])
        if len(own) > 1:
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        out.append(own)
        size[i + 1] = len(own)
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.cumsum(size)


def run_hash(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of values[i:i + n] for each i."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: max(0, len(total) - n)]) if len(values) >= n else np.empty(0, np.uint64)


def text_blocks(column: pa.Array, most: int = BLOCK_BYTES, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(start, end, Words) over blocks of a column of texts."""
    raw, at = buffers(column)
    for start, end in blocks(at, most):
        yield start, end, words(raw[at[start] : at[end]], at[start : end + 1] - at[start], lower)
