"""Word and shingle hashes of whole batches of texts as numpy arrays.

Words are runs of bytes that are no white space, A-Z lower-cased. A word's hash is a polynomial of its
bytes modulo 2**64, taken from running sums over the batch, then mixed; a shingle's is the same over
its words' hashes. Equal sequences hash alike in every batch and process.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quillforge.llm._common import raw_utf8

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)
_STEP = 1 << 16
SLICE = 1 << 18  # bytes of text handled at a time, so that arrays stay in the cache
_KEPT: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those for slices of the usual size are kept."""
    if n > SLICE + 1:
        return _all_powers(base, n)
    if base not in _KEPT:
        _KEPT[base] = _all_powers(base, SLICE + 1)
    return _KEPT[base][:n]


def _all_powers(base: int, n: int) -> np.ndarray:
    low = np.ones(min(n, _STEP), np.uint64)
    low[1:] = np.uint64(base)
    low = np.cumprod(low)
    if n <= _STEP:
        return low
    high = np.ones(-(-n // _STEP), np.uint64)
    high[1:] = np.uint64(pow(base, _STEP, 1 << 64))
    return (np.cumprod(high)[:, None] * low[None, :]).ravel()[:n]


@dataclass
class Words:
    """Of a batch: each word's hash, first byte and end, and where the words of each row begin."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # rows + 1


def words(column: pa.Array) -> Words:
    data, offsets = raw_utf8(column)
    n = len(data)
    gap = SPACE[data] if n else np.zeros(0, bool)
    # a word starts where the byte before is white space or of another row, and ends likewise
    begin, stop = ~gap, ~gap
    begin, stop = begin.copy(), stop.copy()
    begin[1:] &= gap[:-1]
    stop[:-1] &= gap[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begin[edge] |= ~gap[edge]
    stop[edge - 1] |= ~gap[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    value = LOWER[data].astype(np.uint64) + np.uint64(1)
    value *= powers(_B, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    del value
    h = (sums[end] - sums[start]) * powers(_INV, n + 1)[start]
    return Words(mix(h ^ (end - start).astype(np.uint64)), start, end, np.searchsorted(start, offsets))


_C = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)], np.uint64)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-word windows of the batch, where the windows of each row begin); a row of fewer words has none."""
    n = len(w.hash)
    sizes = np.diff(w.first)
    counts = np.maximum(sizes - k + 1, 0)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h += w.hash[j : n - k + 1 + j] * _C[j]
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(w.first[:-1] - first[:-1], counts) + np.arange(first[-1])
    return mix(h[at] + np.uint64(k)), first


def whole(w: Words, i: int, j: int) -> np.ndarray:
    """The hash of words i to j as one shingle."""
    n = j - i
    return mix((w.hash[i:j] * _C[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))


def packed(s: np.ndarray) -> bytes:
    """A set as 48 bits of each hash: what two texts of n shingles share by chance is n**2 / 2**48."""
    return np.sort(s & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; with fewer words the whole sequence is one; without words empty."""
    w = words(column)
    h, first = shingles(w, k)
    out = []
    for r in range(len(w.first) - 1):
        if first[r + 1] > first[r]:
            out.append(np.unique(h[first[r] : first[r + 1]]))
        elif w.first[r + 1] > w.first[r]:
            out.append(whole(w, w.first[r], w.first[r + 1]))
        else:
            out.append(h[:0])
    return out
