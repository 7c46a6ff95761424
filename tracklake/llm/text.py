"""Word spans and word hashes of UTF-8 texts, vectorised over an Arrow batch.

All functions work inside a task on bounded slices of one Arrow batch.  A word is a
maximal run of ASCII letters, digits and bytes of non-ASCII characters; lower-casing is
left to Spark (``lower``), so that it runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a binary or string column without a copy; null is empty."""
    n = len(column)
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (and 8192 rows), or of one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1), row + (1 << 13))
        yield row, end
        row = end


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows between ``offsets``: each word's start, end and 64-bit hash, and the word offsets of the rows."""
    base, n = int(offsets[0]), len(offsets) - 1
    b = buf[base : int(offsets[-1])]
    rel = offsets - base
    if len(b) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    is_word = _WORD[b]
    fresh = np.ones(len(b) + 1, bool)
    fresh[1:-1] = ~is_word[:-1]
    fresh[rel] = True  # a word never crosses two rows
    starts = np.flatnonzero(is_word & fresh[:-1])
    last = np.ones(len(b), bool)
    last[:-1] = ~is_word[1:]
    cut = rel[1:-1]
    last[cut[(cut > 0) & (cut <= len(b))] - 1] = True
    ends = np.flatnonzero(is_word & last) + 1
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):  # in blocks that end with a word
        lo = int(starts[done])
        to = max(done + 1, int(np.searchsorted(ends, lo + SLICE_BYTES, "right")))
        part = b[lo : int(ends[to - 1])]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[done:to] - lo, ends[done:to] - lo
        hashes[done:to] = mix((sums[e] - sums[s]) * down[s], 1)
        done = to
    return starts + base, ends + base, hashes, np.searchsorted(starts, rel).astype(np.int64)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and the row of each; a row of fewer words is one shingle."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(hashes)) - np.repeat(offsets[:-1], n)
    size = np.repeat(n, n)
    keep = (at + width <= size) | ((at == 0) & (size < width))
    where, short = np.flatnonzero(keep), (size < width)[keep]
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    out = np.zeros(len(where), np.uint64)
    for k in range(width):
        h = padded[where + k]
        if short.any():
            h = np.where(short & (k >= size[where]), np.uint64(k + 1), h)
        out = mix(out * np.uint64(31) + h, k + 2)
    return out, row[where]
