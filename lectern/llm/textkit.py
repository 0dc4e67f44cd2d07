"""Vectorised text kernels over Arrow string columns: word spans, word hashes, shingles.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; A-Z are lower-cased before hashing.  These bytes never
occur inside a multi-byte UTF-8 sequence, so all kernels work on raw bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: One text slice handled at once, in bytes; a longer text forms a slice of its own.
SLICE_BYTES = 1 << 19
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xC2B2AE3D27D4EB4F | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 output function)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    is_space = np.zeros(256, bool)
    is_space[[0x20, *range(0x09, 0x0E)]] = True
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    codes[65:91] = codes[97:123]
    return ~is_space, codes


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("p", _BASE), ("q", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"], _powers["q"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (first is 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together; a longer text comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@lru_cache(maxsize=1)
def _letters_only() -> np.ndarray:
    keep = _tables()[0].copy()
    keep[[b for b in range(128) if not chr(b).isalnum()]] = False
    return keep


def words(data: np.ndarray, offsets: np.ndarray, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more entry at the end).

    ``bare`` takes ASCII punctuation and control characters as separators, too.
    """
    keep = _letters_only() if bare else _tables()[0]
    inside = keep[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start[first], end[last] = inside[first], inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; long inputs are folded in blocks so memory stays bounded."""
    _, codes = _tables()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(int(np.searchsorted(ends, at + SLICE_BYTES, side="right")), i + 1)
        stop = ends[j - 1]
        p, q = _power(int(stop - at))
        sums = np.empty(stop - at + 1, np.uint64)
        sums[0] = 0
        np.cumsum(codes[data[at:stop]] * p[: stop - at], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within each text, and each text's first index.

    A text with fewer words, but at least one, gives one hash of its whole sequence.
    """
    count = np.diff(bounds)
    size = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(size)])
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, np.uint64), out_bounds
    owner = np.repeat(np.arange(len(count)), size)
    at = np.arange(total) - out_bounds[:-1][owner] + bounds[:-1][owner]
    length = np.minimum(count, width)[owner]
    acc = np.zeros(total, np.uint64)
    factor = 1
    for k in range(width):
        live = length > k
        if live.all():
            acc += hashes[at + k] * np.uint64(factor)
        else:
            acc[live] += hashes[at[live] + k] * np.uint64(factor)
        factor = factor * _STEP & int(MASK)
    return mix(acc + length.astype(np.uint64)), out_bounds
