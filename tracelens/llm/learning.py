"""What the two text classifiers share: bounded samples of labelled rows, and scoring of whole tables in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.llm.textbytes import slices, texts

BATCH = 1 << 19


def chosen_labels(labels: DataFrame, label: str, fold: Column, most: int) -> DataFrame:
    """(doc_id, y) of `most` labelled rows at most that lie in the fold: those with the least hash of their id.

    Hashes beyond what so many rows can need are left out first, so that no part of the table sends its own `most`.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & fold).select("doc_id", F.col(label).cast("int").alias("y"))
    n = rows.count()
    share = (most + 8 * most**0.5 + 100) / max(n, 1)
    if share < 1:
        rows = rows.where(F.xxhash64("doc_id") < int(-(2.0**63) + share * 2.0**64))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, most: int) -> DataFrame:
    """(doc_id, text, y) of the rows chosen. Their ids are of that number by construction, so they are the side that is broadcast."""
    chosen = chosen_labels(labels, label, fold, most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")


def by_batch(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray], list[np.ndarray | pa.Array]], schema: str) -> DataFrame:
    """Rows whose text is the second column: the other columns, and for each slice of texts the columns that `work` makes."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            others = [batch.column(k) for k in range(batch.num_columns) if k != 1]
            for i, j in slices(offsets, BATCH):
                made = work(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in others] + [m if isinstance(m, pa.Array) else pa.array(m) for m in made], names=names)

    return rows.mapInArrow(run, schema)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))
