"""Mixing of sources to target shares of all words.

Sources in code-point order (null last) take the weights in turn. A source's target is its weight's share of all words, but
at most `cap` times what it has; what is over goes to the others by weight until none is above. A document comes out
floor(rate) times, and once more if a hash of its id, seeded, falls below the rate's fraction. Sources are only ever
aggregated (one row each, combined before the shuffle), and the documents are never shuffled: the rates are a small table
that Spark broadcasts if its measured size allows, and joins otherwise.

Null or empty text has no words; a null source is a source. Rows with one doc_id share one draw. A source without words has
rate 0. An empty table gives an empty mix. Column names beyond those named do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelens.llm.common import WORD, Workspace


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = 3) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    With sources in order of cap over weight, the level that fits once those before are full peaks at the true one, so that
    is a running sum and a maximum over one row per source.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = total.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * cap).cast("double").alias("most"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    all_words = F.sum("source_size").over(Window.partitionBy()).cast("double") * F.lit(share)
    full = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.select("*", ((all_words - full) / left).alias("level"))
    rows = rows.select("source", "source_size", F.least("most", F.max("level").over(Window.partitionBy()) * F.col("weight")).alias("target"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    return rows.select("source", "source_size", "target", rate.alias("rate"))


def copies(doc_id: Column, rate: Column, seed: int) -> Column:
    whole = F.floor(rate)
    return whole + F.when(draw(doc_id, seed) < rate - whole, F.lit(1)).otherwise(F.lit(0))


def mix_report(spark: SparkSession, docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """For each document its size, its source's size and target, and the words that the mix takes of it."""
    work = Workspace(spark, "mixing")
    sized = work.table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    rate = work.table(rates(sized, **how).withColumnRenamed("source", "of"), "rates")
    joined = sized.join(rate, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("doc_id"), F.col("rate"), seed)).alias("taken"), "rate")


def mix(spark: SparkSession, docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The mixed documents themselves, with the columns of `docs`; each as often as the mix takes it."""
    work = Workspace(spark, "mixing")
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    rate = work.table(rates(sized, **how).selectExpr("source of", "rate"), "rates")
    # the documents' own columns travel as one struct, so that none of them can clash with a name used here
    rows = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(rate, F.col("source").eqNullSafe(F.col("of"))).select("row", copies(F.col("doc_id"), F.col("rate"), seed).cast("int").alias("n")).where("n > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


#: DuckDB's rows for mix_report with the defaults.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), total AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
         (source_size * 3)::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE AS everything FROM total
), l AS (
  SELECT *, (everything - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0
                                  < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken, rate
FROM sized JOIN r ON sized.source IS NOT DISTINCT FROM r.source
"""
