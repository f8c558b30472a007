"""Document fingerprints: bottom-k sketches of the hashes of five-word shingles, in SQL functions only.

A sketch is the k least distinct 64-bit hashes of a text's shingles (XXH64, as Spark's xxhash64 of the five words), sorted.
Sketches of parts merge into the sketch of the whole; two give estimates of resemblance and containment, one gives the
number of distinct shingles. Below k shingles all of these are exact.

A text of fewer than five words has its whole word sequence as its one shingle; a text without words (null, empty, blank)
has the empty sketch, which resembles another empty one fully and any other not at all. For `edited`, the next document is
that of the next greater (doc_id, content), null ids first, and the first follows the last; repeated rows are one document
there, and each gets its own result row. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.llm.common import WORD, Workspace, text_key

K = 128


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once: it is a lambda's variable there, which also keeps generated code small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, k: int = K, words: int = 5) -> Column:
    w = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def hashes(w: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
        return F.when(F.size(w) >= words, full).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))

    return F.slice(F.sort_array(F.array_distinct(F.coalesce(_bound(w, hashes), F.expr("cast(array() as array<bigint>)")))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Shared share of the union's shingles: of the union's k least, those in both sketches."""
    return _bound(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the hash range."""
    place = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: of the shared hashes' estimate over a's own."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def printed(a: Column) -> Column:
    """Base64 of the sketch's hashes, eight bytes each."""
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))), r"\s+", "")


def following(work: Workspace, docs: DataFrame) -> DataFrame:
    """(__id, __key, __n, __next_id, __next_key) for each distinct document: the next one in order of id and content.

    Ids are dealt into ranges and looked ahead in each range; a range's last document takes the first of the next range
    that has any, from a table of one row per range.
    """
    keys = docs.groupBy("__id", "__key").agg(F.max("__n").alias("__n"), F.count(F.lit(1)).alias("__rows"))
    dealt = work.table(keys.repartitionByRange("__id", "__key").withColumn("__range", F.spark_partition_id()), "order")
    firsts = dealt.groupBy("__range").agg(F.min(F.struct("__id", "__key")).alias("first"))
    ranges = Window.orderBy("__range")
    ahead = firsts.select("__range", F.coalesce(F.lead("first").over(ranges), F.first("first").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__ahead"))
    inside = Window.partitionBy("__range").orderBy("__id", "__key")
    looked = dealt.withColumn("__own", F.lead(F.struct("__id", "__key")).over(inside)).join(ahead, "__range")
    found = F.coalesce("__own", "__ahead")
    return work.table(looked.select("__id", "__key", "__n", "__rows", found["__id"].alias("__next_id"), found["__key"].alias("__next_key")), "following")


def edited(spark: SparkSession, docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last quarter is the next document's beginning, and their likeness."""
    work = Workspace(spark, "fingerprints")
    lowest = F.lit(-(1 << 63))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__key", text_key(F.col("__id"), F.col("__text")))
    order = following(work, rows.select("__id", "__key", F.length("__text").alias("__n")))
    repeated = bool(order.where("__rows > 1").head(1))
    # both joins use all these columns, so that one exchange of the texts serves both
    dealt = rows.repartition("__id", "__key")
    asked = order.select(F.col("__id").alias("__of_id"), F.col("__key").alias("__of_key"), F.floor(F.col("__n") / 4).cast("int").alias("__m"), F.col("__next_id").alias("__id"), F.col("__next_key").alias("__key"))
    given = dealt.join(asked, ["__id", "__key"]).select("__of_id", "__of_key", "__m", F.expr("substring(__text, 1, __m)").alias("__head"), sketch(F.col("__text"), k).alias("__next"))
    if repeated:
        given = given.dropDuplicates(["__of_id", "__of_key"])
    given = given.withColumnsRenamed({"__of_id": "__id", "__of_key": "__key"})
    both = dealt.join(given, ["__id", "__key"]).withColumn("__edit", F.concat(F.expr("substring(__text, 1, length(__text) - __m)"), F.col("__head")))
    both = both.select(F.nullif(F.col("__id"), lowest).alias("doc_id"), F.length("__text").cast("long").alias("n_chars"), F.sha2(F.col("__edit").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("__text"), k).alias("__a"), sketch(F.col("__edit"), k).alias("__b"), "__next")
    return both.select("doc_id", "n_chars", "edited_sha256", printed(F.col("__a")).alias("fingerprint"), printed(F.col("__b")).alias("edited_fingerprint"), resemblance(F.col("__a"), F.col("__b"), k).alias("near_edited"), resemblance(F.col("__a"), F.col("__next"), k).alias("near_next"), distinct_shingles(F.col("__a"), k).alias("distinct_shingles"))
