"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, and a linear classifier.

Voters are words (the lexicon: a short fixed list and words found by their labels) and word beginnings (patterns), each at
the first, second, third or fourth different word of a text that begins so: inflected forms of one stem. They are
found on `most` labelled rows at most: terms whose share of toxic rows is high, taken greedily by how many toxic rows they
add. The label model estimates, by expectation maximisation over the sample's votes, each voter's rate of votes in
either class and the correlations of voters within a class, and counts correlated votes for less. Its posterior labels
train a logistic classifier on the votes, which scores all whole texts.

Null, empty and blank texts get no votes and are scored like any other. Without a toxic label only the fixed list votes, at
assumed rates. Repeated rows score alike. An empty table gives no rows. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import Workspace, crc_mod
from tracelens.llm.learning import by_batch, labelled_sample, sigmoid
from tracelens.llm.textbytes import Sums, slices, texts

MAX_ROWS = 8_000
MAX_CANDIDATES = 4_000
MAX_VOTERS = 300
#: Lengths in bytes of the word beginnings that may vote; 0 is the whole word.
LENGTHS = (0, 4, 5, 6, 7, 8, 9)
LEVELS = 4
_LEVEL = np.array([0, *[0x9E3779B97F4A7C15 * k & (1 << 64) - 1 for k in range(1, LEVELS)]], np.uint64)
#: Insults that vote whether or not labels show them.
LEXICON = ("clown", "disgusting", "dumb", "fool", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case bytes, start, end, text) of each run of letters; all bytes beyond ASCII count as letters."""
    low = data.copy()
    upper = (low >= 0x41) & (low <= 0x5A)
    low[upper] += 32
    if len(low):
        accented = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[accented] += 32
    letter = ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= letter[1:] != letter[:-1]
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    keep = letter[start] if len(low) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    return low, start, end, np.searchsorted(offsets, start, "right") - 1


def ranked(h: np.ndarray, owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, text) once for each different word of a text, up to LEVELS of them; the second and later are terms of their own."""
    order = np.lexsort((word, owner, h))
    h, owner, word = h[order], owner[order], word[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    new = first.copy()
    new[1:] |= word[1:] != word[:-1]
    h, owner, first = h[new], owner[new], first[new]
    begin = np.flatnonzero(first)
    rank = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    keep = rank < LEVELS
    return h[keep] ^ _LEVEL[rank[keep]], owner[keep]


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length its terms' hashes, their texts and their words' hashes. A beginning is of a longer word."""
    low, start, end, owner = letter_runs(data, offsets)
    sums = Sums(low)
    word = sums.spans(start, end)
    for n in LENGTHS:
        fits = end - start > n
        yield n, sums.spans(start[fits], start[fits] + n) if n else word[fits], owner[fits], word[fits]


def fixed_terms() -> np.ndarray:
    words = "".join(LEXICON).encode()
    ends = np.cumsum([len(w) for w in LEXICON])
    return Sums(np.frombuffer(words, np.uint8)).spans(np.concatenate([[0], ends[:-1]]), ends)


def _candidates(work: Workspace, sample: DataFrame) -> list[tuple[int, int]]:
    """(length, hash as a long) of terms that occur in toxic rows mostly, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            y = np.array(batch.column(2).to_pylist(), np.int64)
            for i, j in slices(offsets, 4 << 20):
                for n, h, owner, word in term_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    h, owner = ranked(h, owner, word)
                    term, inverse = np.unique(h, return_inverse=True)
                    toxic = np.bincount(inverse, y[i:j][owner], len(term)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), n, np.int32)), pa.array(term.view(np.int64)), pa.array(toxic), pa.array(np.bincount(inverse, minlength=len(term)))], names=["n", "h", "toxic", "all"])

    counted = sample.mapInArrow(run, "n int, h long, toxic long, all long").groupBy("n", "h").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all"))
    found = work.table(counted.where("toxic >= 4 AND toxic >= 0.8 * all").orderBy(F.desc("toxic"), "n", "h").limit(MAX_CANDIDATES), "candidates").collect()
    return [(r.n, r.h) for r in sorted(found, key=lambda r: (-r.toxic, r.n, r.h))]


class Voters:
    """Terms that vote: for each length, sorted hashes and the voters' numbers."""

    def __init__(self, terms: list[tuple[int, int]]):
        self.size, self.by_length = len(terms), {}
        for n in LENGTHS:
            own = sorted((h & (1 << 64) - 1, k) for k, (m, h) in enumerate(terms) if m == n)
            known = np.array([h for h, _ in own], np.uint64)
            # a term of a later level is met only where its first is
            self.by_length[n] = (known, np.array([k for _, k in own], np.int64), np.unique((known[:, None] ^ _LEVEL).ravel()))

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, voter) of each vote, once each, in order."""
        found = [np.zeros(0, np.int64)]
        for n, h, owner, word in term_hashes(data, offsets):
            known, number, firsts = self.by_length[n]
            if len(known):
                near = firsts[np.minimum(np.searchsorted(firsts, h), len(firsts) - 1)] == h
                h, owner = ranked(h[near], owner[near], word[near])
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[at] == h
                found.append(owner[hit] * self.size + number[at[hit]])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(self.size, 1), pairs % max(self.size, 1)


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, voter = self.voters.votes(data, offsets)
        return sigmoid(self.bias + np.bincount(text, self.weights[voter], len(offsets) - 1))


def label_model(votes: np.ndarray, toxic_rate: np.ndarray, clean_rate: np.ndarray, prior: float, absence: np.ndarray | None = None, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, the voters' rates in both classes, their correlations within classes).

    The rates given are where it starts, and weigh as much as the sample's rows do: toxic rows are of several kinds (each
    language has its own voters), and votes alone would take one kind for a class. A vote's log-likelihood counts 1 / (1 + the positive correlations with the row's other votes); an absent vote's, with all voters. absence: 0 for voters
    whose silence says nothing.
    """
    start_a, start_b, held = toxic_rate, clean_rate, len(votes) * prior
    a, b, correlation = toxic_rate.copy(), clean_rate.copy(), np.zeros((votes.shape[1],) * 2)
    q = np.full(len(votes), prior)
    for _ in range(rounds):
        positive = np.maximum(correlation, 0.0)
        miss = np.log((1 - a) / (1 - b)) / (1.0 + positive.sum(axis=1))
        if absence is not None:
            miss = miss * absence
        hits = votes / (1.0 + votes @ positive)
        q = sigmoid(np.log(prior / (1 - prior)) + hits @ np.log(a / b) + (1 - votes) @ miss)
        total = q.sum()
        prior = float(np.clip(total / len(q), 1e-3, 0.5))
        a = np.clip((q @ votes + held * start_a) / (total + held), 1e-4, 1 - 1e-4)
        b = np.clip(((1 - q) @ votes + len(q) * start_b) / (2 * len(q) - total), 1e-5, 1 - 1e-4)
        off = votes - np.outer(q, a) - np.outer(1 - q, b)  # residuals, given the class
        cover = off.T @ off / len(q)
        spread = np.sqrt(np.maximum(np.diag(cover), 1e-9))
        correlation = cover / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0.0)
        correlation[np.abs(correlation) < 0.1] = 0.0
    return q, a, b, correlation


def classifier(votes: np.ndarray, q: np.ndarray, decay: float = 1e-6, rounds: int = 1500, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic weights for soft labels, by Adam on all rows."""
    w, m, v = np.zeros(votes.shape[1] + 1), np.zeros(votes.shape[1] + 1), np.zeros(votes.shape[1] + 1)
    x = np.hstack([votes, np.ones((len(votes), 1))])
    for k in range(1, rounds + 1):
        g = x.T @ (sigmoid(x @ w) - q) / len(q)
        g[:-1] += decay * w[:-1]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, fold: Column, most: int = MAX_ROWS) -> Model:
    sample = labelled_sample(docs, labels, "toxic", fold, most).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "y")
    fixed = [(0, int(h)) for h in fixed_terms().view(np.int64)]
    terms = fixed + [t for t in _candidates(Workspace(docs.sparkSession, "toxicity"), sample) if t not in set(fixed)]
    candidates = Voters(terms)

    def voted(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        text, voter = candidates.votes(data, offsets)
        ends = np.searchsorted(text, np.arange(len(offsets)))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(voter, pa.int64()))]

    rows = by_batch(sample, voted, "doc_id long, y int, votes array<long>").collect()  # `most` rows, MAX_CANDIDATES votes each at most
    rows.sort(key=lambda r: (r.doc_id, r.y, r.votes))
    y = np.array([r.y for r in rows], int)
    full = np.zeros((len(rows), len(terms)), bool)
    for k, r in enumerate(rows):
        full[k, r.votes] = True
    if not y.any():
        return Model(Voters(fixed), np.full(len(fixed), 4.0), -4.0)
    toxic, every = full[y == 1].sum(axis=0), full.sum(axis=0)  # counts, as sums of booleans are
    right = (toxic + 0.5) / (every + 1.0)
    # greedily by new toxic rows, each counted twice at most, so that a row rests on two voters where it can
    need, chosen, counted = np.where(y == 1, 2, 0), [], full.astype(np.float32)
    while len(chosen) < MAX_VOTERS:
        gain = (need > 0).astype(np.float32) @ counted * right**4
        gain[chosen] = 0
        best = int(gain.argmax())
        if gain[best] < 2:
            break
        chosen.append(best)
        need = need - (full[:, best] & (need > 0))
    chosen += [k for k in range(len(fixed)) if k not in chosen]
    votes = full[:, chosen].astype(float)
    # a toxic text uses few of many terms, so one term's absence says nothing; that no term votes is a vote of its own
    every_vote = np.hstack([votes, ~votes.any(axis=1, keepdims=True)])
    prior = float(np.clip(y.mean(), 1e-3, 0.5))
    a = np.clip((y @ every_vote + 0.5) / (y.sum() + 1), 1e-4, 1 - 1e-4)
    b = np.clip(((1 - y) @ every_vote + 0.05) / ((1 - y).sum() + 1), 1e-5, 1 - 1e-4)
    q, *_ = label_model(every_vote, a, b, prior, np.append(np.zeros(votes.shape[1]), 1.0))
    weights, bias = classifier(votes, q)
    return Model(Voters([terms[k] for k in chosen]), weights, bias)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, fold: Column | None = None, most: int = MAX_ROWS) -> DataFrame:
    """(doc_id, score): how likely label 1 is. fold: which rows' labels may be learned from (a condition on doc_id)."""
    model = fit(docs, labels, fold if fold is not None else F.lit(True), most)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return by_batch(rows, lambda data, offsets: [model.scores(data, offsets)], "doc_id long, score double")


def learned_fold(doc_id: str = "doc_id") -> Column:
    return crc_mod(F.col(doc_id), 3) != 1
