"""Hashes of ranges of byte texts, for whole Arrow batches at once.

Bytes are mapped through fixed random tables and summed with powers of a base modulo the prime
2 ** 31 - 1, twice with other tables and bases, so that the hash of any range is a difference of two prefix
sums times a power of the base's inverse. Two ranges of n bytes that differ agree for at most n of the 2 ** 31
bases in each, whatever their bytes; a finalizer then mixes the 62 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer text is a part of its own.
PART = 1 << 18
PRIME = (1 << 31) - 1
_P, _31 = np.uint64(PRIME), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def folded(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, up to one PRIME too much; x below 2 ** 63."""
    x = (x & _P) + (x >> _31)
    return (x & _P) + (x >> _31)


@lru_cache(maxsize=8)
def _table(seed: int) -> np.ndarray:
    return 1 + mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) % np.uint64(PRIME - 1)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo PRIME; only those of a part are kept."""
    have = _powers.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    x = np.ones(max(n, PART + 1), np.uint64)
    done = 1
    while done < len(x):
        more = x[: min(done, len(x) - done)] * np.uint64(pow(base, done, PRIME))
        x[done : done + len(more)] = folded(more) % _P
        done += len(more)
    if n <= PART + 1:
        _powers[base] = x
    return x[:n]


BASES = (0x4C957F2D, 0x3F4914F7)


class Ranges:
    """Hashes of ranges of one byte buffer."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        self.sums, self.back = [], []
        for which, base in enumerate(BASES):
            v = _table(which + 1)[buffer]
            v *= powers(base, n)
            high = v >> _31
            v &= _P
            v += high
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(v, out=sums[1:])  # below 2 ** 32 each, so exact for texts of up to 2 ** 31 bytes
            self.sums.append(sums)
            self.back.append(powers(pow(base, -1, PRIME), n + 1))

    def raw(self, start, end) -> np.ndarray:
        """start, end: arrays of places, or slices of as many."""
        out = None
        for sums, back in zip(self.sums, self.back, strict=True):
            x = folded(folded(sums[end] - sums[start]) * back[start])
            x -= _P * (x >= _P)
            out = x if out is None else (out << _31) | x
        return out

    def of(self, start, end) -> np.ndarray:
        return mix(self.raw(start, end))


def word_hashes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words (runs of bytes other than space, \\t to \\r) of texts that stand end to end."""
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    n = len(b)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = gap[:-1]
    before |= edge[:n]
    after = np.ones(n, bool)
    after[:-1] = gap[1:]
    after |= edge[1 : n + 1]
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(start):  # a long text some PART bytes at a time, cut between words
        stop = max(at + 1, int(np.searchsorted(end, start[at] + PART, side="right")))
        lo = start[at]
        out.append(Ranges(b[lo : end[stop - 1]]).of(start[at:stop] - lo, end[at:stop] - lo))
        at = stop
    return start, np.concatenate(out) + mix((end - start).astype(np.uint64))


def windows(word: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` words."""
    n = max(0, len(word) - size + 1)
    turn = mix(np.uint64(7919) * np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    return mix(sum((word[k : n + k] * turn[k] for k in range(size)), np.zeros(n, np.uint64)))


def parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of a string column, null as empty, some PART bytes each."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
