"""Quality classifier: random-indexing word vectors, pooled per document, and a small network with calibrated scores.

Each word stands for its spelling in lower case and for its shape (its runs of letters, digits and marks, and whether it
repeats the word before it). Both have a fixed sparse random index vector, given by a hash. A spelling's word vector is the
sum of the index vectors of its neighbours over the whole corpus, kept in a fixed number of hashed rows, so the table that
reaches the driver and the workers has the same size for any corpus. A document's input is the mean of its words' vectors,
the means of their own index vectors, and three counts. The network has one hidden layer, is trained on `most` labelled
rows at most, and its scores are calibrated by a temperature fitted on rows held out of that sample.

Null, empty and blank texts have an all-zero pool and are scored like any other. Without labels every score is 0.5; with
labels of one kind only it is that label's smoothed share. Repeated rows score alike. An empty table gives no rows. Columns
other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import Workspace, crc_mod
from tracelens.llm.learning import BATCH, by_batch, labelled_sample, sigmoid
from tracelens.llm.textbytes import Sums, mix, slices, texts, words

ROWS, DIMS, NONZERO = 1 << 13, 64, 2
SHAPES = 64
MAX_ROWS = 12_000
INPUTS = DIMS + DIMS + SHAPES + 3


def _classes() -> np.ndarray:
    """Class of each byte in a shape: capitals, other letters (and all beyond ASCII), digits; each mark is its own."""
    out = np.arange(256).astype(np.uint8)
    out[0x41:0x5B], out[0x61:0x7B], out[0x30:0x3A], out[0x80:] = 1, 2, 3, 2
    return out


_CLASS = _classes()
_LOW = np.arange(256).astype(np.uint8)
_LOW[0x41:0x5B] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(spelling hash, shape hash, number of words of each text)"""
    start, end, count = words(data, offsets)
    spelling = Sums(_LOW[data]).spans(start, end)
    kind = _CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = Sums(kind[keep], 1).spans(at[start], at[end])
    again = np.zeros(len(start), bool)
    again[1:] = spelling[1:] == spelling[:-1]
    firsts = np.concatenate([[0], np.cumsum(count)])[:-1]
    again[firsts[count > 0]] = False
    return spelling, np.where(again, ~shape, shape), count


def index_places(h: np.ndarray, dims: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each non-zero element of the hashes' index vectors its dimension and sign."""
    out = []
    for k in range(NONZERO):
        g = mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))
        out.append(((g % np.uint64(dims)).astype(np.int64), np.where(g >> np.uint64(63), 1.0, -1.0)))
    return out


def row_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 13)).astype(np.int64)


def word_vectors(work: Workspace, docs: DataFrame) -> np.ndarray:
    """The table of word vectors (ROWS x DIMS, rows of unit length) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ROWS * DIMS)
        for batch in batches:
            data, offsets = texts(batch.column(0))
            for i, j in slices(offsets, BATCH):
                spelling, _, count = terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                owner = np.repeat(np.arange(j - i), count)
                left = np.flatnonzero(owner[1:] == owner[:-1])  # word and its right neighbour, in one text
                row = row_of(spelling) * DIMS
                for dim, sign in index_places(spelling, DIMS):
                    table += np.bincount(np.concatenate([row[left] + dim[left + 1], row[left + 1] + dim[left]]), np.concatenate([sign[left + 1], sign[left]]), ROWS * DIMS)
        used = np.flatnonzero(table.reshape(ROWS, DIMS).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(c) for c in table.reshape(ROWS, DIMS)[used].T.copy()]], names=["row", *[f"d{k}" for k in range(DIMS)]])

    parts = docs.selectExpr("cast(text as string) text").mapInArrow(run, "row int, " + ", ".join(f"d{k} double" for k in range(DIMS)))
    summed = work.table(parts.groupBy("row").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIMS)]), "vectors")
    out = np.zeros((ROWS, DIMS), np.float32)
    for r in summed.collect():  # ROWS rows at most
        out[r[0]] = r[1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The network's input for each text."""
    n = len(offsets) - 1
    spelling, shape, count = terms(data, offsets)
    owner = np.repeat(np.arange(n), count)
    per_word = np.maximum(count, 1)[:, None]
    out = np.zeros((n, INPUTS), np.float32)
    gathered = vectors[row_of(spelling)]
    ends = np.concatenate([[0], np.cumsum(count)])
    full = count > 0
    if full.any():
        out[full, :DIMS] = np.add.reduceat(gathered, ends[:-1][full], axis=0)
    for h, at, dims in ((spelling, DIMS, DIMS), (shape, 2 * DIMS, SHAPES)):
        for dim, sign in index_places(h, dims):
            out[:, at : at + dims] += np.bincount(owner * dims + dim, sign, n * dims).reshape(n, dims)
    out[:, : 2 * DIMS + SHAPES] /= per_word
    pairs = np.unique(owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ spelling, return_index=True)[1]
    distinct = np.bincount(owner[pairs], minlength=n)
    out[:, -3], out[:, -2], out[:, -1] = np.log1p(count), distinct / per_word[:, 0], np.diff(offsets) / per_word[:, 0] / 10
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale).clip(-6, 6) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x.astype(np.float64)) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
    """By Adam on six sevenths of the rows; the rest calibrate the temperature. Deterministic in the rows' order."""
    held = np.arange(len(y)) % 7 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    rng = np.random.default_rng(seed)
    fit_x, fit_y = x[~held].astype(np.float64), y[~held].astype(np.float64)
    mean, scale = fit_x.mean(axis=0), np.maximum(fit_x.std(axis=0), 1e-3)
    fit_x = ((fit_x - mean) / scale).clip(-6, 6)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(fit_y))
        for k in range(0, len(order), batch):
            b = order[k : k + batch]
            h = np.tanh(fit_x[b] @ p[0] + p[1])
            d = (sigmoid(h @ p[2] + p[3]) - fit_y[b]) / len(b)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [fit_x[b].T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()])]
            step += 1
            for a, g, mm, vv in zip(p, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if held.any():
        z, t = net.logits(x[held].astype(np.float64)), y[held]
        grid = np.geomspace(0.25, 8.0, 61)
        loss = [-np.mean(np.log(np.maximum(np.where(t == 1, sigmoid(z / g), 1 - sigmoid(z / g)), 1e-12))) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def _scorer(spark: SparkSession, docs: DataFrame, labels: DataFrame, fold: Column | None, most: int) -> Callable[[np.ndarray, np.ndarray], list[np.ndarray]]:
    """Learns, and returns what scores a batch of texts."""
    work = Workspace(spark, "quality-model")
    vectors = word_vectors(work, docs)
    sample = labelled_sample(docs, labels, "quality", fold if fold is not None else F.lit(True), most)
    inputs = by_batch(
        sample.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "y"),
        lambda data, offsets: [pa.array(list(pooled(data, offsets, vectors)), pa.list_(pa.float32()))],
        "doc_id long, y int, x array<float>",
    )
    got = inputs.collect()  # `most` rows of a fixed width
    got.sort(key=lambda r: (r.doc_id * 2654435761 % (1 << 32), r.doc_id, r.y, r.x))
    y = np.array([r.y for r in got], int)
    constant = (y.sum() + 1) / (len(y) + 2) if len(set(y.tolist())) < 2 else None
    net = None if constant is not None else train(np.array([r.x for r in got]), y)

    def scored(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        return [np.full(len(offsets) - 1, constant) if net is None else net.scores(pooled(data, offsets, vectors))]

    return scored


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, fold: Column | None = None, most: int = MAX_ROWS) -> DataFrame:
    """(doc_id, score): how likely label 1 is. fold: which rows' labels may be learned from (a condition on doc_id)."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return by_batch(rows, _scorer(spark, docs, labels, fold, most), "doc_id long, score double")


def kept(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MAX_ROWS) -> DataFrame:
    """The documents that score `threshold` or more, with the columns of `docs`; no row moves."""
    scores = _scorer(spark, docs, labels, None, most)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(at))
            for i, j in slices(offsets, BATCH):
                good = scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0] >= threshold
                yield batch.slice(i, j - i).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def learned_fold(doc_id: str = "doc_id") -> Column:
    return crc_mod(F.col(doc_id), 5) != 0
