"""NumPy kernels over the contiguous UTF-8 buffer of an Arrow string column.

Every kernel works on one block of whole documents at a time (``blocks``), so
the memory of a Python worker is bounded by the block size, or by the largest
single document where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def _splitmix(x: int) -> int:
    x = (x + _ODD) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


#: A random 64-bit value for each byte.
BYTE_HASH = np.array([_splitmix(i + 1) for i in range(256)], dtype=np.uint64)
_BASE = _splitmix(12345) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


#: For second_hash: a base and byte values of its own.
_BASE_2 = _splitmix(54321) | 1
_INVERSE_2 = pow(_BASE_2, -1, 2**64)
_BYTE_HASH_2 = np.array([_splitmix(7000 + i) for i in range(256)], dtype=np.uint64)

_powers: dict[bool, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers modulo 2**64, up to exponent n."""
    if second not in _powers or len(_powers[second][0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        bases = (_BASE_2, _INVERSE_2) if second else (_BASE, _INVERSE)
        up, down = (np.full(size, x, np.uint64) for x in bases)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if size > 4 * BLOCK_BYTES:
            return up, down
        _powers[second] = up, down
    return _powers[second]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with ``(P[e] - P[s]) * inverse[s]`` the hash of ``data[s:e]``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hashes of the spans; equal strings have equal hashes wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def second_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of spans that are independent of prefix_hash's."""
    up, down = powers(len(data), second=True)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_HASH_2[data] * up[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start])


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; null is empty.

    A run has at most ``size`` bytes, or one text that is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and where each text's words begin.

    ``separator`` is a table of 256 flags; a word is a maximal run of other bytes inside one text.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    gap = separator[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge] = True
    after[edge - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_ORDER = [_U(_splitmix(900 + i) | 1) for i in range(64)]


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mixed hashes of the words of a block with A-Z lower-cased, their spans, and where each text's words begin."""
    starts, ends, begin = word_spans(data, offsets, separator)
    p = prefix_hash(_LOWER[data])
    return mix(span_hash(p, starts, ends) + (ends - starts).astype(np.uint64)), starts, ends, begin


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all runs of k words, by first word; the caller drops those that cross texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, _U(k), np.uint64)
    for i in range(k):
        h += words[i : i + n] * _ORDER[i]
    return mix(h)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word k-grams; of fewer words one hash; of none none."""
    for first, last, data, offsets in blocks(column):
        words, _, _, begin = word_hashes(data, offsets, SPACES)
        grams = gram_hashes(words, k)
        for i in range(last - first):
            a, b = int(begin[i]), int(begin[i + 1])
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield gram_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all runs of w values."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x
