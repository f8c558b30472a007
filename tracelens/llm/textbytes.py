"""Whole columns of texts as one run of UTF-8 bytes, and hashes of any spans of it, without a Python object per word.

A span's hash is a polynomial over a fixed random 64-bit value per byte, taken from prefix sums, so it costs the same for
any length. Two unlike multipliers give two hashes where one is not enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUES = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1) for _ in range(2)]
_BASES = [_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    if which not in _powers or len(_powers[which][0]) < n:
        size, out = 1 << max(16, int(n - 1).bit_length()), []
        for b in (int(_BASES[which]), pow(int(_BASES[which]), -1, 1 << 64)):
            a = np.full(size, b, _U)
            a[0] = 1
            out.append(np.cumprod(a))
        _powers[which] = (out[0], out[1])
    return _powers[which]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    return h


class Sums:
    """Prefix sums over a buffer; `spans` hashes any [start, end) of it."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        self.which, (p, _) = which, powers(which, n + 1)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_VALUES[which][data] * p[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * powers(self.which, 1)[1][start]
        return mix(h + (end - start).astype(_U))

    def windows(self, k: int) -> np.ndarray:
        """Hash of every k bytes, unmixed by length as all are alike."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * powers(self.which, 1)[1][:n]) if n > 0 else np.zeros(0, _U)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its texts in them; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(o) and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, (o - o[0] if len(o) else np.zeros(1, np.int64))


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about `most` bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (see common.WORD), and the number of words of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))
