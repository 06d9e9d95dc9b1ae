"""Rolling hashes over the words or bytes of whole Arrow batches, in NumPy.

All hashes are fixed functions of the content: the same on every executor and in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_LOW = np.uint64((1 << 24) - 1)
_HIGH = ~_LOW


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=U)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 1 << 22:
            _powers[base] = have
    return have


class Sums:
    """Prefix sums of a polynomial over bytes: the hash of any slice in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, dtype=U)
        np.cumsum(_BYTE[data] * _power(_BASE, n)[:n], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, dtype=U)
        back = _power(_INV, int(starts[-1]) + 1)
        return mix((self.total[ends] - self.total[starts]) * back[starts])

    def every(self, k: int) -> np.ndarray:
        """Hashes of all k-byte slices."""
        n = len(self.total) - k
        return mix((self.total[k:] - self.total[:n]) * _power(_INV, n)[:n]) if n > 0 else np.zeros(0, dtype=U)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    if not n or offsets[-1] == offsets[0] or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges of at most `limit` bytes, or of one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end
        at = end


def separators(codes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(codes)] = True
    return table


SPACE = separators([0x20, *range(0x09, 0x0E)])


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the rows, and each row's first word; words never cross rows."""
    inside = ~separator[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = np.empty(len(data), bool), np.empty(len(data), bool)
    first[0] = last[-1] = True
    first[1:], last[:-1] = ~inside[:-1], ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = True
    last[edges[1:] - 1] = True
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive items."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= U(0x9E3779B97F4A7C15)
        out += hashes[j : j + n]
    return mix(out)


def owners(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes the place of its smallest (leftmost of equals).

    Equal windows own the same relative place, wherever they stand: 40 bits of the hash
    are compared, then the place."""
    n, step = len(hashes) - width + 1, 1 << 22
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    for at in range(0, n, step):
        part = hashes[at : min(len(hashes), at + step + width - 1)]
        low = (part & _HIGH) | np.arange(len(part), dtype=U)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        out[at : at + len(low)] = (low & _LOW).astype(np.int64) + at
    return out
