"""The joins that the dataflow rests on: first results, orphans, bands, nearest earlier rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_first_result(uses: DataFrame, results: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """uses, each with the first of its results, by a grouped minimum (which combines before its shuffle)."""
    first = results.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__r"))
    return uses.join(first, key, "left").select(*[uses[c] for c in uses.columns], *[F.col("__r")[c].alias(c) for c in columns])


def orphans(results: DataFrame, uses: DataFrame, key: list[str]) -> DataFrame:
    """Results without a use: an empty or null id is one too."""
    return results.join(uses.select(*key).distinct(), key, "left_anti")


def missing(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of a backup that are gone."""
    return before.join(after.select(key), key, "left_anti")


def band(left: DataFrame, right: DataFrame, key: list[str], width: int, order: str = "pos") -> DataFrame:
    """For each left row the first right row among the `width` positions before it, if any.

    Positions fall into blocks of `width`; a left row looks in its block and the one before, so the join is an equi-join.
    """
    block = F.floor(F.col(order) / width)
    r = right.select(*key, F.col(order).alias("__pos"), F.col("event_id").alias("match"), block.alias("__block"))
    l = left.withColumn("__block", F.explode(F.array(block, block - 1)))
    hit = l.join(r, [*key, "__block"]).where((F.col("__pos") < F.col(order)) & (F.col("__pos") >= F.col(order) - width))
    return hit.groupBy(*[c for c in left.columns]).agg(F.min_by("match", "__pos").alias("match"))


def restore(backup: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Missing backup rows with the position they go back to: half after the nearest earlier row that survives."""
    kept = backup.join(now.select(F.col(key).alias("__k"), F.col("pos").alias("__now")), F.col(key) == F.col("__k"), "left")
    w = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("after", F.last("__now", ignorenulls=True).over(w)).where("__now IS NULL").withColumn("new_pos", F.coalesce("after", F.lit(-1)) + 0.5).drop("__k", "__now")


def unmentioned(files: DataFrame, text: DataFrame, pattern: str) -> DataFrame:
    """Files (stem) that no text names: names are taken out of texts by a pattern and joined, not searched pair by pair."""
    named = text.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("stem")).distinct()
    return files.join(named, "stem", "left_anti")


def members(rows: DataFrame, column: str, values: list) -> Column:
    return rows[column].isin(*values)
