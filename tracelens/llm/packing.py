"""Packing of documents into windows of a fixed number of tokens (sum-of-squares online placement).

A document's whole windows are cut off first. Its remainder goes to the fill level that minimises the sum, over levels, of
the squared number of windows filled to that level; a level array counts the open windows, in levels of `grain` tokens. A
window within less than a level of its end is topped up by the beginning of the next document that has so many tokens, and
closed. When a task ends, or when more windows are open than `max_open`, what the few open windows hold is cut anew into
whole windows (`recut`), and the last few tokens into windows of powers of two, so nothing is padded. Each task packs its own
input split: no shuffle, and memory for the open windows only.

Null text is empty and yields its end id alone. Repeated rows are packed as often as they occur. An empty table gives no
pieces. Other columns, whatever their names, are ignored. A task that runs again gives the same windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracelens.llm.textbytes import slices, texts
from tracelens.llm.tokens import BATCH, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, recut boolean"
#: sequence_id: the task's number times this, plus the window's number in the task.
PER_TASK = 1 << 40


class LevelArray:
    """Open windows by fill level, and the sum-of-squares choice among them. Windows that `closes` tells of are not open."""

    def __init__(self, size: int, grain: int = 1):
        self.size, self.grain, n = size, grain, -(-size // grain)
        self.count = np.zeros(n, np.int64)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.top = np.full(n, size + 1, np.int64)  # fill of the window that is next to be taken from a level

    def closes(self, fill: int) -> bool:
        return fill > self.size - self.grain

    def place(self, n: int) -> tuple[int, int | None]:
        """(fill of the window that gets n more tokens, that window; None: a new one). It is taken out of its level."""
        c, filled = self.count, self.top + n
        level = np.minimum(filled // self.grain, len(c) - 1)
        # change of sum(count**2) when a window moves to another level, or closes, which no longer counts
        change = np.where(filled > self.size - self.grain, 1 - 2 * c, np.where(level == np.arange(len(c)), 0, 2 - 2 * c + 2 * c[level]))
        change[filled > self.size] = np.iinfo(np.int64).max
        best = len(c) - 1 - int(change[::-1].argmin())  # the fullest of equals
        if change[best] > (0 if self.closes(n) else 2 * c[n // self.grain] + 1):
            return 0, None
        fill, window = self.open[best].pop()
        self._set(best)
        return fill, window

    def put(self, fill: int, window: int) -> None:
        if not self.closes(fill):
            self.open[fill // self.grain].append((fill, window))
            self._set(fill // self.grain)

    def _set(self, level: int) -> None:
        own = self.open[level]
        self.count[level], self.top[level] = len(own), own[-1][0] if own else self.size + 1


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    def __init__(self, size: int, first: int, max_open: int, grain: int = 1):
        self.size, self.next, self.max_open, self.grain = size, first, max_open, grain
        self.levels, self.held, self.rows = LevelArray(size, grain), {}, []
        self.near: list[tuple[int, int]] = []  # (room, window) of windows that wait for a last piece

    def _emit(self, sequence: int, pieces: list[tuple], length: int, recut: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, sequence, offset, length, recut))
            offset += len(ids)

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        size, n, at = self.size, len(ids), 0
        while self.near and self.near[-1][0] <= n - at:
            room, window = self.near.pop()
            self._emit(window, [*self.held.pop(window), (doc_id, at, ids[at : at + room], n)], size)
            at += room
        while n - at >= size:
            self._emit(self._new(), [(doc_id, at, ids[at : at + size], n)], size)
            at += size
        if at == n:
            return
        fill, window = self.levels.place(n - at)
        if window is None:
            window = self._new()
            self.held[window] = []
        # a copy, or the window would keep the whole batch's ids alive
        self.held[window].append((doc_id, at, ids[at:].copy(), n))
        fill += n - at
        if fill == size:
            self._emit(window, self.held.pop(window), size)
        elif self.levels.closes(fill):
            self.near.append((size - fill, window))
        else:
            self.levels.put(fill, window)
        if len(self.held) > self.max_open:
            self.flush()

    def flush(self) -> None:
        """Cuts what the open windows hold into whole windows, and the last into powers of two."""
        total = sum(len(p[2]) for pieces in self.held.values() for p in pieces)
        lengths = [self.size] * (total // self.size) + powers_of_two(total % self.size)
        queue = [p for window in sorted(self.held) for p in self.held[window]][::-1]
        for length in lengths:
            room, taken = length, []
            while room:
                doc_id, start, ids, n = queue.pop()
                taken.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    queue.append((doc_id, start + room, ids[room:], n))
                room -= min(room, len(ids))
            self._emit(self._new(), taken, length, True)
        self.held, self.near, self.levels = {}, [], LevelArray(self.size, self.grain)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 9
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if k == 8 else pa.int64()) for k, c in enumerate(columns)], names=names)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, max_open: int = 4096, markers: bool = False, grain: int = 64) -> DataFrame:
    """Pieces of all documents (doc_id, text) in windows of `size` tokens; each document's ids end with end_id. markers: see tokens.py."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, TaskContext.get().partitionId() * PER_TASK, max_open, grain)
        encode = encoder(tokenizer_path, True, markers)
        for batch in batches:
            data, offsets = texts(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for i, j in slices(offsets, BATCH):
                ids, ends = encode.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(i, j):
                    packer.add(doc_ids[k], np.append(ids[ends[k - i] : ends[k - i + 1]], encode.dtype.type(end_id)))
                yield packer.batch()
        packer.flush()
        yield packer.batch()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
