"""Removal of long repeated strings by suffix arrays over shards of candidate texts.

A string of `length` bytes that starts at two places is removed at both, together with all overlapping ones. Every string
of that length has an anchor: of the strings of a third of its length (128 bytes at most) in it, the leftmost with the least
hash. Neighbouring strings share anchors, so a text falls into runs of starts with one anchor each; equal strings lie in
runs with equal anchors, at the same distance from them. So:

1. each text's distinct runs are listed: places, number of starts, hash of the anchor, hash of the run's text. A run that a
   text holds many times, as where a line is repeated, is one row;
2. anchors met once are dropped;
3. the other anchors' distinct run texts, each once with its number of copies, are dealt to shards by anchor. A shard's
   suffix array (suffixes.py) and common prefixes give the classes of equal strings, and a class that weighs two or more
   repeats;
4. an anchor with more distinct run texts than a shard should hold is split over several. Each of them cuts its sorted list
   of distinct strings, as 96-bit digests, into ranges, one packed row for each; lists of one range are merged by binary
   search, and what two of them hold goes back to its shards;
5. what repeats goes back to the runs and to their texts, where it is removed.

Steps 1 and 2 lose nothing, and a false match there only adds candidates. Equal hashes of run texts (64 bits, beside an
equal 64-bit anchor hash) and digests are taken for equal texts. No step gathers a group of unknown size: counts are
combined before shuffles, and shards, ranges and texts are bounded.

Null and empty texts, and texts shorter than `length`, repeat nothing. Rows that repeat are copies, and lose all their
strings of that length. An empty table gives no rows. Extra columns are carried by `deduplicated` and ignored by `report`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import Workspace, text_key
from tracelens.llm.suffixes import repeated_starts
from tracelens.llm.textbytes import Sums, slices, texts

#: Bytes of text that a worker has in hand at once; runs() takes about 80 times as much memory.
BATCH = 1 << 18
#: Distinct run texts (about 540 bytes each) that a shard should hold.
SHARD = 1800
RUNS = "did long, dkey long, a array<int>, n int, h long, seg long"


#: One string of a split anchor's shard: digests, its text's number in the shard, its start, and whether it is known to repeat.
STRING = np.dtype([("d1", "<u8"), ("d2", "<u4"), ("text", "<u4"), ("start", "<u4"), ("known", "u1")])


def anchor_length(length: int) -> int:
    """Shorter anchors give longer, and so fewer, runs, but meet by chance more often."""
    return max(1, min(128, length // 3))


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, number of starts, anchor hash, run hash) of each run of the texts."""
    anchor = anchor_length(length)
    n, wide = len(data), length - anchor + 1
    size = np.diff(offsets)
    long = np.flatnonzero(size >= length)
    if not len(long):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = Sums(data).windows(anchor)
    bits = np.uint64(max(22, int(n).bit_length()))
    best = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= wide:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < wide:
        best = np.minimum(best[: len(best) - (wide - width)], best[wide - width :])
    count = size[long] - length + 1
    starts = np.repeat(offsets[long] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    at = (best[starts] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    begin = np.flatnonzero(first)
    many = np.diff(np.append(begin, len(at)))
    a = starts[begin]
    text = np.searchsorted(offsets, a, "right") - 1
    return text, a - offsets[text], many, hashes[at[begin]], Sums(data, 1).spans(a, a + many + length - 1)


def _list_runs(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(2))
            did, key = batch.column(0), batch.column(1)
            for i, j in slices(offsets, BATCH):
                text, a, n, h, seg = runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length)
                order = np.lexsort((seg, h, text))
                text, a, n, h, seg = (x[order] for x in (text, a, n, h, seg))
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])
                row, ends = pa.array(text[new] + i), np.append(np.flatnonzero(new), len(text)).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(ends), pa.array(a.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([did.take(row), key.take(row), places, pa.array(n[new].astype(np.int32)), pa.array(h[new].view(np.int64)), pa.array(seg[new].view(np.int64))], names=["did", "dkey", "a", "n", "h", "seg"])

    return docs.select("did", "dkey", "text").mapInArrow(run, RUNS)


def _cut(asked: DataFrame, length: int) -> DataFrame:
    """The run texts asked for, from rows of (text, list of runs)."""
    schema = "shard long, h long, seg long, m long, parts int, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(0))
            raw = memoryview(data)
            for k, asks in enumerate(batch.column(1)):
                base, wanted = int(offsets[k]), asks.as_py()
                columns = [[x[c] for x in wanted] for c in ("shard", "h", "seg", "m", "parts")]
                body = [bytes(raw[base + x["a"] : base + x["a"] + x["n"] + length - 1]) for x in wanted]
                arrays = [pa.array(v, pa.int32() if c == 4 else pa.int64()) for c, v in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(body, pa.binary())], names=["shard", "h", "seg", "m", "parts", "body"])

    return asked.mapInArrow(run, schema)


def _ranges(text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last) of runs of consecutive starts, from pairs in any order."""
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(text)) - 1
    return text[begin], start[begin], start[np.minimum(end, len(start) - 1)] if len(start) else start


FOUND = "h long, seg long, f int, t int, shard long, range int, packed binary"
REPEATS = "h long, seg long, f int, t int"


def _found(h: np.ndarray, seg: np.ndarray, f: np.ndarray, t: np.ndarray) -> list[pa.Array]:
    return [pa.array(h), pa.array(seg), pa.array(f.astype(np.int32)), pa.array(t.astype(np.int32))]


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _shards(cut: DataFrame, length: int) -> DataFrame:
    """Starts first to last of each run text that repeat in its shard. A shard of a split anchor also gives its run texts'
    hashes (range -1) and, for each range of digests that it has any in, its distinct strings in order of digest."""

    def run(table: pa.Table) -> pa.Table:
        bodies = table.column("body").to_pylist()
        h, seg, m = (table.column(c).to_numpy() for c in ("h", "seg", "m"))
        text, start, group = repeated_starts(bodies, length)
        known = np.bincount(group, m[text])[group] >= 2
        t, first, last = _ranges(text[known], start[known])
        rows = [*_found(h[t], seg[t], first, last), pa.nulls(len(t), pa.int64()), pa.nulls(len(t), pa.int32()), pa.nulls(len(t), pa.binary())]
        out = [pa.table(rows, names=_names(FOUND))]
        parts = table.column("parts")[0].as_py()
        if parts:
            once = np.unique(group, return_index=True)[1]
            data, offsets = texts(pa.array(bodies, pa.large_binary()).view(pa.large_string()))
            at = offsets[text[once]] + start[once]
            strings = np.empty(len(once), STRING)
            strings["d1"], d2 = (Sums(data, k).spans(at, at + length) for k in (0, 1))
            strings["d2"], strings["text"], strings["start"], strings["known"] = d2 >> np.uint64(32), text[once], start[once], known[once]
            strings.sort(order=["d1", "d2"])
            place = (strings["d1"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            edges = np.searchsorted(place, np.arange(parts + 1))
            ranges = np.flatnonzero(np.diff(edges))
            packed = [seg.tobytes(), *[strings[edges[r] : edges[r + 1]].tobytes() for r in ranges]]
            n, none = len(packed), [pa.nulls(len(packed), k) for k in (pa.int64(), pa.int32(), pa.int32())]
            own = [pa.array(np.full(n, h[0])), *none, pa.array(np.full(n, table.column("shard")[0].as_py())), pa.array(np.append(-1, ranges).astype(np.int32)), pa.array(packed, pa.binary())]
            out.append(pa.table(own, names=_names(FOUND)))
        return pa.concat_tables(out)

    return cut.groupBy("shard").applyInArrow(run, FOUND)


def _in_two(lists: list[np.ndarray]) -> list[np.ndarray]:
    """For each of several shards' sorted lists, which of its strings another list has too. A list holds a string once."""
    every = np.sort(np.concatenate([x["d1"] for x in lists]))
    out = [np.searchsorted(every, x["d1"], "right") - np.searchsorted(every, x["d1"], "left") > 1 for x in lists]
    # the few that share the first digest are compared by the second too
    some = np.concatenate([x[o][["d1", "d2"]] for x, o in zip(lists, out, strict=True)])
    pair, count = np.unique(some, return_counts=True)
    twice = pair[count > 1]
    for x, o in zip(lists, out, strict=True):
        o[o] = np.isin(x[o][["d1", "d2"]], twice)
    return out


def _merged(packed: DataFrame, work: Workspace) -> DataFrame:
    """REPEATS of strings that are alone in their shard but occur in another shard of the same anchor."""

    def merge(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, STRING) for x in table.column("packed").to_pylist()]
        own = [x[new & (x["known"] == 0)] for x, new in zip(lists, _in_two(lists), strict=True)]
        some = [k for k, x in enumerate(own) if len(x)]
        packed = [np.stack([own[k]["text"], own[k]["start"]], axis=1).astype("<u4").tobytes() for k in some]
        some = pa.array(some, pa.int64())
        return pa.table([table.column("h").take(some), table.column("shard").take(some), pa.array(packed, pa.binary())], names=["h", "shard", "packed"])

    def back(table: pa.Table) -> pa.Table:
        first = [k for k, r in enumerate(table.column("range").to_pylist()) if r == -1][0]
        packed = table.column("packed").to_pylist()
        seg = np.frombuffer(packed[first], np.int64)
        pairs = np.concatenate([np.zeros((0, 2), np.uint32), *[np.frombuffer(p, "<u4").reshape(-1, 2) for k, p in enumerate(packed) if k != first]])
        t, f, last = _ranges(pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64))
        return pa.table(_found(np.full(len(t), table.column("h")[0].as_py(), np.int64), seg[t], f, last), names=_names(REPEATS))

    lists = packed.where("range >= 0").groupBy("h", "range").applyInArrow(merge, "h long, shard long, packed binary")
    met = work.table(lists, "merged").withColumn("range", F.lit(0))
    owners = packed.where("range = -1").select("h", "shard", "packed", "range").join(met.select("shard").distinct(), "shard", "left_semi")
    return met.select("h", "shard", "packed", "range").unionAll(owners.select("h", "shard", "packed", "range")).groupBy("shard").applyInArrow(back, REPEATS)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), text_key(F.col("doc_id"), F.col("text")).alias("dkey"), "text")


def _covered(work: Workspace, dealt: DataFrame, rows: DataFrame, length: int, shard: int) -> DataFrame:
    """(did, dkey, spans): for each text with repeats, a list of the first and last start of runs of repeated strings."""
    listed = work.table(_list_runs(rows, length), "runs")
    # written down, so that the join below is of two plain exchanges, which Spark can split where one anchor is frequent
    anchors = work.table(listed.groupBy("h").agg(F.sum(F.size("a")).alias("count")).where("count > 1").select("h"), "anchors")
    met = work.table(listed.join(anchors, "h"), "met")
    distinct = work.table(met.groupBy("h", "seg").agg(F.sum(F.size("a")).alias("m"), F.min(F.struct("did", "dkey", F.col("a")[0].alias("a"), "n")).alias("x")), "distinct")
    work.drop("runs")
    total = distinct.count()
    # at most as many as there are shards
    split = work.table(distinct.groupBy("h").count().where(F.col("count") > shard).selectExpr("h", f"cast(ceil(count / {shard / 2}) AS int) AS parts"), "split")
    placed = distinct.join(split, "h", "left").withColumn("parts", F.coalesce("parts", F.lit(0)))
    placed = placed.withColumn("shard", F.when(F.col("parts") > 0, F.xxhash64("h", F.pmod("seg", "parts"))).otherwise(F.pmod(F.xxhash64("h"), F.lit(-(-total // shard) or 1))))
    asked = placed.groupBy(F.col("x.did").alias("did"), F.col("x.dkey").alias("dkey")).agg(F.collect_list(F.struct("shard", "h", "seg", "m", "parts", "x.a", "x.n")).alias("asks"))
    cut = _cut(dealt.join(asked, ["did", "dkey"]).select("text", "asks"), length)
    found = work.table(_shards(cut, length), "found")
    repeats = found.where("packed IS NULL").select("h", "seg", "f", "t")
    if split.head(1):
        repeats = repeats.unionAll(_merged(found.where("packed IS NOT NULL"), work))
    # a run text's ranges are one row: they lie in its few hundred starts. Written down, so that the join below, too, is of
    # two plain exchanges, which Spark can split where one text has many copies
    ranges = work.table(repeats.groupBy("h", "seg").agg(F.collect_list(F.struct("f", "t")).alias("ranges")), "ranges")
    spans = met.join(ranges, ["h", "seg"]).select("did", "dkey", F.expr("flatten(transform(a, p -> transform(ranges, x -> struct(p + x.f AS f, p + x.t AS t))))").alias("spans"))
    return spans.groupBy("did", "dkey").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _spans(found: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs [start, end)."""
    out: list[tuple[int, int]] = []
    for f, t in sorted((x["f"], x["t"]) for x in found or ()):
        if out and f <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], t + length))
        else:
            out.append((f, t + length))
    return out


def _apply(spark: SparkSession, rows: DataFrame, work_on: Callable[[bytes, list[tuple[int, int]]], tuple], schema: str, length: int, shard: int) -> DataFrame:
    """rows: keyed rows with what is carried. The texts are dealt by key for the shards and, as those are written down between, again for the removal."""
    work = Workspace(spark, "suffix-dedup")
    dealt = rows.repartition("did", "dkey")
    covered = _covered(work, dealt.select("did", "dkey", "text"), rows, length, shard)
    joined = dealt.join(covered, ["did", "dkey"], "left")
    joined = joined.withColumn("doc_id", F.nullif(F.col("did"), F.lit(-(1 << 63)))).drop("did", "dkey")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    carried = [c for c in joined.columns if c not in ("text", "spans")]
    made_schema = ", ".join([f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in carried] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(texts(batch.column("text"))[1], BATCH):
                part = batch.slice(i, j - i)
                made = [work_on(t.as_py().encode(), _spans(s.as_py(), length)) for t, s in zip(part.column("text"), part.column("spans"), strict=True)]
                arrays = [pa.array(c) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + arrays, names=carried + names)

    return joined.mapInArrow(run, made_schema)


def report(spark: SparkSession, docs: DataFrame, length: int = 400, shard: int = SHARD) -> DataFrame:
    """For each document: bytes, bytes removed, maximal removed runs, and SHA-256 of the bytes left."""

    def work_on(data: bytes, spans: list[tuple[int, int]]) -> tuple:
        digest, at = hashlib.sha256(), 0
        for a, b in spans:
            digest.update(data[at:a])
            at = b
        digest.update(data[at:])
        return len(data), sum(b - a for a, b in spans), len(spans), digest.hexdigest()

    return _apply(spark, _keyed(docs), work_on, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, shard)


def kept_text(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a character that a span covers in part stays."""
    out, at = [], 0
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = max(at, b)
    return b"".join([*out, data[at:]]).decode()


def deduplicated(spark: SparkSession, docs: DataFrame, length: int = 400, shard: int = SHARD) -> DataFrame:
    """The documents, all of them and with their columns in order, without their repeated strings."""
    carried = [c for c in docs.columns if c != "text"]
    own = {c: f"__{k}" for k, c in enumerate(carried)}
    rows = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), text_key(F.col("doc_id"), F.col("text")).alias("dkey"), "text", *[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    done = _apply(spark, rows, lambda data, spans: (kept_text(data, spans),), "kept string", length, shard)
    return done.select(*[F.col("kept" if c == "text" else own[c]).alias(c) for c in docs.columns])
