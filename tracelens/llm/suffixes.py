"""Suffix arrays of a shard of texts in numpy: Larsson-Sadakane refinement, and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np

#: Between and after texts: a byte that no UTF-8 text has.
STOP = 0xFF


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions of data in order of their suffixes.

    Positions are first sorted by seven bytes. Then each group of equals is refined by the groups of what follows its
    known prefix; only groups of two or more take part, and the known prefix triples each round (two later groups are
    looked at, as a shard's groups fit 21 bits). Shards of more than 2**21 bytes look at one and double.
    """
    n = len(data)
    if n < 2:
        return np.arange(n)
    step = 7
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    key = np.zeros(n, np.uint64)
    for k in range(step):
        key = key << np.uint64(8) | padded[k : k + n].astype(np.uint64)
    # what ends within the key is told from bytes 0 by its length
    key = key << np.uint64(3) | np.minimum(n - np.arange(n), step).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1  # a group's rank is its first place
    bits, wide = 21, n < (1 << 21) - 2
    while True:
        single = new.copy()
        single[:-1] &= new[1:]
        places = np.flatnonzero(~single)  # of sorted order, in groups of two or more
        if not len(places):
            return order
        at = order[places]
        one = rank[np.minimum(at + step, n)]
        if wide:
            key = (rank[at] << (2 * bits)) | (one << bits) | rank[np.minimum(at + 2 * step, n)]
        else:
            key = (rank[at] << 31) | one
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[places] = at
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[at] = places[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] + 1
        new[places] = fresh
        step *= 3 if wide else 2


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix that each place of the order shares with the place before it (0 for the first).

    Kasai's bound, that a suffix shares at least one less than the suffix one position before it does, holds for all and
    is met exactly wherever the bytes before the two suffixes agree. So only the others are compared, eight bytes at a
    time, and a running maximum carries their lengths on.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    same = np.zeros(n, bool)
    fine = (i > 0) & (before > 0)
    same[fine] = data[i[fine] - 1] == data[before[fine] - 1]
    # where the position before is the first of the order, nothing carries over
    first = order[0]
    if first + 1 < n:
        same[first + 1] = False
    compare = np.flatnonzero(~same & (before >= 0))
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    words = np.lib.stride_tricks.as_strided(padded, (n + 8, 8), (1, 1))
    length = np.zeros(n, np.int64)
    left = compare
    while len(left):
        a, b = left + length[left], before[left] + length[left]
        room = n - np.maximum(a, b)
        x = np.ascontiguousarray(words[np.minimum(a, n)]).view("<u8").ravel() ^ np.ascontiguousarray(words[np.minimum(b, n)]).view("<u8").ravel()
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
        equal = np.minimum(equal, room)
        length[left] += equal
        left = left[(equal == 8)]
    known = np.where(before >= 0, length, 0)
    start = np.where(same, -1, known + i)  # a reducible position takes what is carried to it
    shared = np.maximum(np.maximum.accumulate(start) - i, 0)
    shared[before < 0] = 0
    out[1:] = shared[order[1:]]
    return out


def repeated_starts(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, class) of every string of `length` bytes in the texts; equal strings, and no others, share a class."""
    data = np.frombuffer(bytes([STOP]).join(texts) + bytes([STOP]), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(len(texts)), size + 1)
    order = suffix_array(data)
    shared = common_prefixes(data, order)
    start = order - begin[owner[order]]
    whole = start + length <= size[owner[order]]
    # a common prefix that runs over a stop is longer than what is asked for, as the strings themselves have none
    group = np.cumsum(shared < length)
    return owner[order][whole], start[whole], group[whole]
