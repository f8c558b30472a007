"""Token ids in files of fixed-width bit-packed blocks, in ascending document order, and their way back.

A file holds some documents' ids, each in as few bits as the vocabulary needs. Blocks of a fixed number of ids start at
whole bytes, and a table of block offsets gives random access; both ways are numpy shifts over whole blocks.

Layout, little-endian: magic "TLBP", version u32, bits u32, ids per block u32, documents u64, ids u64; document ids i64
(the smallest i64 for null) and end offsets u64, in ids; block offsets u64 (one more than blocks); the blocks; crc32 u32 of
all before it.

Null text is empty and yields its end id alone; null doc_id sorts first; rows with the same doc_id follow each other in
order of text. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.llm.common import Workspace
from tracelens.llm.textbytes import slices, texts
from tracelens.llm.tokens import BATCH, encoder

HEAD = struct.Struct("<4sIIIQQ")
MAGIC, VERSION = b"TLBP", 1
NO_ID = -(1 << 63)
#: Bytes read at once for a file's checksum, ids at once for documents' checksums, and files that one task reads where there are many.
CHUNK, AT_ONCE, FILES, READ_TASKS = 1 << 20, 1 << 20, 4, 10_000
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"
MANIFEST = "task long, file_no long, path string, n_docs long, n_ids long"


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits (32 at most), lowest bit first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(raw.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    at = np.arange(n, dtype=np.int64) * bits
    words = np.lib.stride_tricks.as_strided(raw.view(np.uint8), (len(data) + 1, 8), (1, 1))[at >> 3].copy().view("<u8").ravel()
    return ((words >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def encode_file(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, bits: int, block: int) -> bytes:
    """ends: of each document, in ids."""
    blocks = [pack_bits(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = HEAD.pack(MAGIC, VERSION, bits, block, len(doc_ids), len(ids))
    body = b"".join([head, np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes(), ends.astype("<u8").tobytes(), offsets.tobytes(), *blocks])
    return body + struct.pack("<I", zlib.crc32(body))


class PackedFile:
    """An open file (seek and read). `ids(i, j)` reads the blocks that hold ids i to j and no others; memory holds the file's
    table of documents and blocks, and the blocks of one call."""

    def __init__(self, source: BinaryIO, check: bool = True):
        self.source = source
        size = source.seek(0, 2)
        head = self._read(0, HEAD.size)
        if len(head) < HEAD.size or head[:4] != MAGIC or HEAD.unpack(head)[1] != VERSION:
            raise ValueError("not a file of packed ids")
        _, _, self.bits, self.block, n_docs, self.n_ids = HEAD.unpack(head)
        if check:
            crc = 0
            for at in range(0, size - 4, CHUNK):
                crc = zlib.crc32(self._read(at, min(CHUNK, size - 4 - at)), crc)
            if self._read(size - 4, 4) != struct.pack("<I", crc):
                raise ValueError("the file is damaged")
        n_blocks = -(-self.n_ids // self.block)
        table = np.frombuffer(self._read(HEAD.size, 16 * n_docs + 8 * (n_blocks + 1)), "<i8")
        self.doc_ids = [None if d == NO_ID else d for d in table[:n_docs].tolist()]
        self.ends, self.offsets = table[n_docs : 2 * n_docs], table[2 * n_docs :]
        self.base = HEAD.size + 8 * len(table)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, i: int, j: int) -> np.ndarray:
        if i >= j:
            return np.zeros(0, np.uint32)
        first, last = i // self.block, (j - 1) // self.block
        data = self._read(self.base + int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        out = []
        for b in range(first, last + 1):
            n, (a, z) = min(self.block, self.n_ids - b * self.block), self.offsets[b : b + 2] - self.offsets[first]
            out.append(unpack_bits(data[a:z], n, self.bits))
        return np.concatenate(out)[i - first * self.block : j - first * self.block]


def write_packed(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, block: int = 4096, file_ids: int = 4 << 20, markers: bool = False) -> DataFrame:
    """Writes all documents (doc_id, text) under `folder` (any store that pyarrow opens) and returns the list of files.

    A task writes files of names of its own and lists them as its rows, so only what a task that succeeded wrote is ever
    read. Write the returned rows down before using them twice. A file holds up to file_ids ids, and one document at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encode, task, number = encoder(tokenizer_path, False, markers), TaskContext.get().partitionId(), 0
        bits = bits_for(max(encode.vocabulary, end_id + 1))
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal number
            name = f"ids-{task:06d}-{number:04d}-{uuid.uuid4().hex}.bin"
            ids = np.concatenate(held)
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(encode_file(doc_ids, np.cumsum(sizes), ids, bits, block))
            row = [[task], [number], [f"{folder}/{name}"], [len(doc_ids)], [len(ids)]]
            number += 1
            for x in (doc_ids, held, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == 2 else pa.int64()) for k, v in enumerate(row)], names=["task", "file_no", "path", "n_docs", "n_ids"])

        total = 0
        for batch in batches:
            data, offsets = texts(batch.column(1))
            ids_of = batch.column(0).to_pylist()
            for i, j in slices(offsets, BATCH):
                ids, ends = encode.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(i, j):
                    held.append(np.append(ids[ends[k - i] : ends[k - i + 1]], encode.dtype.type(end_id)))
                    doc_ids.append(ids_of[k])
                    sizes.append(len(held[-1]))
                    total += sizes[-1]
                    if total >= file_ids:
                        yield flush()
                        total = 0
        if doc_ids:
            yield flush()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, MANIFEST)


def read_packed(manifest: DataFrame) -> DataFrame:
    """Each document as the files have it: doc_id, ids before it in all files, number of ids, crc32 of its ids as u32."""
    spark: SparkSession = manifest.sparkSession
    # one row for each task that wrote; their number is that of the write's partitions
    totals = manifest.groupBy("task").agg(F.sum("n_ids").alias("n"), F.count(F.lit(1)).alias("files")).orderBy("task").collect()
    base, rows, n_files = 0, [], 0
    for r in totals:
        rows.append((r.task, base))
        base, n_files = base + r.n, n_files + r.files
    bases = spark.createDataFrame(rows, "task long, base long")
    before = Window.partitionBy("task").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.join(bases, "task").select("path", (F.col("base") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    file = PackedFile(f)
                    starts = np.concatenate([[0], file.ends[:-1]])
                    for i, j in slices(np.append(starts, file.n_ids), AT_ONCE):
                        ids, own = file.ids(int(starts[i]), int(file.ends[j - 1])).astype("<u4"), file.ends[i:j] - starts[i]
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((starts[i:j] - starts[i]).tolist(), own.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[i:j], pa.int64()), pa.array(starts[i:j] + first), pa.array(file.ends[i:j] - starts[i:j]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # dealt evenly, to a number of tasks that Spark leaves alone: by their few bytes these rows would all go to one
    return files.repartition(min(READ_TASKS, -(-n_files // FILES) or 1)).mapInArrow(run, RESULT)


def write_and_read(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2, markers: bool = False) -> DataFrame:
    work = Workspace(spark, "token-ids")
    manifest = work.table(write_packed(docs, f"{work.path}/ids", tokenizer_path, end_id, markers=markers), "manifest")
    return read_packed(manifest)
