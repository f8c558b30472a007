"""What a worker holds at once."""

import tracemalloc

import numpy as np

from tracelens.llm import near_copies, suffix_dedup
from tracelens.llm.textbytes import slices


def test_batches_of_texts_take_little_memory():
    """Of two tasks beside each other, whose executor also keeps what earlier stages left."""
    rng = np.random.default_rng(5)
    offsets = np.arange(0, (3 << 20) + 1, 1 << 11)
    data = rng.integers(97, 123, offsets[-1], dtype=np.uint8)
    data[rng.integers(0, len(data), len(data) // 6)] = 0x20
    for of, batch, most in ((lambda d, o: suffix_dedup.runs(d, o, 250), suffix_dedup.BATCH, 40), (lambda d, o: list(near_copies.shingle_sets(d, o)), near_copies.BATCH, 30)):
        tracemalloc.start()
        try:
            for i, j in slices(offsets, batch):
                of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            peak = tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()
        assert peak < most, (batch, peak)
