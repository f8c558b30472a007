"""SimHash fingerprints and their near-duplicate classes, by anchor points of a covering code.

A fingerprint bit is set if it is set in over half the XXH64 (seed 42) of the text's 3-word shingles. Two fingerprints
within `distance` 2 differ in at most one bit of one of their 32-bit halves. On 31 bits of a half the perfect Hamming code
[31, 26] is a covering of radius 1: each fingerprint has one home anchor, and is replicated to every anchor within radius
plus threshold, 2 (16 of them, 1 if it is an anchor itself). Fingerprints meet where one's home is the other's replica, and
are compared there. Equal fingerprints are one vertex, so copies cost nothing; the rest of the work is on distinct
fingerprints. An anchor that is home to more than `most` of them would compare them all with each other; these are linked
instead through every point one bit away from them (two fingerprints within 2 bits share such a point), which is linear.

Null or empty text, and text of white space, has fingerprint zero and links like any other. Null doc_id counts as larger
than any. Repeated rows are alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import Workspace, grows, text_key
from tracelens.llm.graph import components
from tracelens.llm.textbytes import texts

LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
CHUNK = 1 << 16
#: Each becomes 32 rows.
NODES_A_TASK = 1 << 18


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; none for no hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()  # bytes.split parts at just the six blanks meant
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        return xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    hashes = np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n - shingle + 1)
    return majority(hashes)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, dkey, fp): the row's content key and the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            raw, o = data.tobytes(), offsets.tolist()
            fp = np.array([fingerprint(raw[a:b]) for a, b in zip(o, o[1:])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp)], names=["doc_id", "dkey", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("doc_id"), F.col("text")).alias("dkey"))
    return rows.mapInArrow(run, "doc_id long, dkey long, fp long")


def _syndrome(v: str) -> str:
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    return " | ".join(f"((bit_count({v} & {m}L) & 1) * {1 << k})" for k, m in enumerate(masks))


def anchored(nodes: DataFrame) -> DataFrame:
    """(fp, half, home, anchors): of each distinct fingerprint and half, the home anchor and all anchors within 2."""
    halves = nodes.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    v = halves.select("fp", "half", F.expr("CASE half WHEN 0 THEN fp ELSE shiftrightunsigned(fp, 32) END & 2147483647L").alias("v"))
    s = v.select("*", F.expr(f"cast({_syndrome('v')} as int)").alias("s"))
    home = s.select("*", F.expr("CASE WHEN s = 0 THEN v ELSE v ^ shiftleft(1L, s - 1) END").alias("home"))
    pairs = "transform(filter(sequence(1, 31), i -> (i ^ s) > i), i -> v ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))"
    return home.select("fp", "half", "home", F.expr(f"CASE WHEN s = 0 THEN array(v) ELSE concat(array(home), {pairs}) END").alias("anchors"))


def _dealt(work: Workspace, nodes: DataFrame) -> DataFrame:
    # dealt anew, as the nodes may have come back in few files and each becomes 32 rows; with a number given, as Spark would
    # join small partitions again otherwise. The count is of a written table, so it reads footers only
    return nodes.repartition(max(work.spark.sparkContext.defaultParallelism, -(-nodes.count() // NODES_A_TASK)), "fp")


def placed(work: Workspace, nodes: DataFrame) -> DataFrame:
    """(half, anchor, fp, own) for each anchor within 2 of each distinct fingerprint's halves; own: it is the home. Written down,
    as all that meet at anchors read it, and so that Spark sizes it by its 32 rows a fingerprint rather than by the table it
    is made of."""
    at = anchored(_dealt(work, nodes))
    return work.table(at.select("half", F.explode("anchors").alias("anchor"), "fp", "home").selectExpr("half", "anchor", "fp", "anchor = home AS own"), "places")


def stars(work: Workspace, places: DataFrame, within: int) -> DataFrame:
    """Edges (u, v) within so many bits, more than 2, for callers that check edges themselves: at each anchor, of the distinct
    fingerprints that are there as home or replica with the least that has its home there. One half of the two is alike there,
    and the other may differ more. An edge at most for each place of a fingerprint, however many meet at an anchor."""
    # written down, so that the join below is of two plain exchanges, which Spark can split where one anchor is frequent
    centres = work.table(places.where("own").groupBy("half", "anchor").agg(F.min("fp").alias("u")), "centres")
    met = grows(places.selectExpr("half", "anchor", "fp AS v")).join(grows(centres), ["half", "anchor"])
    return met.where(F.expr(f"bit_count(u ^ v) <= {within} AND u <> v")).select("u", "v")


def links(work: Workspace, nodes: DataFrame, distance: int = 2, most: int = 2000) -> DataFrame:
    """Edges (u, v) whose components are those of all links between distinct fingerprints within `distance`, 2 at most."""
    if distance > 2:
        raise ValueError("the anchors are chosen for a distance of 2 at most")
    return links_at(work, placed(work, nodes), distance, most)


def links_at(work: Workspace, places: DataFrame, distance: int, most: int) -> DataFrame:
    """links, of fingerprints whose places are written down."""
    own = places.where("own")
    crowded = work.table(own.groupBy("half", "anchor").count().where(F.col("count") > most).select("half", "anchor", F.lit(True).alias("full")), "crowded")
    homes = own.selectExpr("half", "anchor", "fp AS x").join(crowded, ["half", "anchor"], "left")
    replicas = places.selectExpr("half", "anchor", "fp AS y")
    near = F.expr(f"bit_count(x ^ y) <= {distance} AND x < y")
    pairs = grows(homes.where("full IS NULL").drop("full")).join(grows(replicas), ["half", "anchor"]).where(near).selectExpr("x AS u", "y AS v")
    if not crowded.head(1):
        return pairs
    if distance == 0:
        return pairs  # distinct fingerprints have no links
    # the rest: all members of crowded anchors, as home or replica, to the points one bit away; the least member stands for a
    # point. Members that are one bit apart meet at each other's own place
    members = homes.where("full").select("half", "anchor", F.col("x").alias("fp")).unionAll(replicas.join(crowded, ["half", "anchor"]).selectExpr("half", "anchor", "y AS fp")).select("fp").distinct()
    points = members.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("point"))
    if distance == 1:
        # only a member's own place counts there: whoever is within a bit of it has it as a point
        return pairs.unionAll(points.join(members.selectExpr("fp AS point", "fp AS u"), "point").where("fp <> u").selectExpr("u", "fp AS v"))
    least = points.groupBy("point").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return pairs.unionAll(points.join(least, "point").where("fp <> u").selectExpr("u", "fp AS v"))


def rooted(spark: SparkSession, docs: DataFrame, distance: int = 2, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, dkey, fp) of each row, and (of, root, component_id) of each distinct fingerprint."""
    work = Workspace(spark, "simhash")
    fps = work.table(fingerprints(docs), "fingerprints")
    nodes = work.table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = work.table(components(work, links(work, nodes.select("fp"), distance, most)), "roots")
    own = nodes.join(roots, nodes.fp == roots.node, "left").select(nodes.fp.alias("of"), "least", F.coalesce("root", nodes.fp).alias("root"))
    first = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps, work.table(own.join(first, "root").select("of", "root", "component_id"), "labels")


def classes(spark: SparkSession, docs: DataFrame, distance: int = 2, most: int = 2000) -> DataFrame:
    """(doc_id, dkey, fp, component_id): the least doc_id of the documents linked to it, directly or through others."""
    fps, label = rooted(spark, docs, distance, most)
    return fps.join(label, fps.fp == label.of).select("doc_id", "dkey", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def survivors(spark: SparkSession, docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of `docs` for each root of found (doc_id, dkey, root): that of the least doc_id, null last, then the least content key."""
    work = Workspace(spark, "survivors")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("dkey").alias("key"), F.col("count").alias("rows"))
    kept = work.table(found.groupBy("root", "doc_id", "dkey").count().groupBy("root").agg(F.min(order).alias("o")).selectExpr("o.id AS __id", "o.key AS __key", "o.rows > 1 AS __many"), "kept")
    # the table's own columns travel as one struct, so that none of them can clash with a name used here
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("doc_id"), F.col("text")).alias("own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = keyed.join(kept.select("__id", "__key"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("own") == F.col("__key")), "left_semi")
    if kept.where("__many").head(1):  # the survivor may itself be repeated
        rows = rows.dropDuplicates(["id", "own"])
    return rows.select("row.*")


def deduplicated(spark: SparkSession, docs: DataFrame, distance: int = 2) -> DataFrame:
    """One document of each class, with the columns of `docs`."""
    fps, label = rooted(spark, docs, distance)
    return survivors(spark, docs, fps.join(label, fps.fp == label.of).select("doc_id", "dkey", "root"))
