"""Budgets, histograms, roll-ups and browsing sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import scalar


def token_budget(rows: DataFrame, category: Column, chars: Column) -> DataFrame:
    """(session_id, category, tokens): each item's estimate is cut to whole tokens before the sum."""
    return rows.groupBy("session_id", category.alias("category")).agg(F.sum(scalar.item_tokens(chars)).cast("long").alias("tokens"))


def density(rows: DataFrame, chars: Column, buckets: int = 40) -> DataFrame:
    """(session_id, bucket, chars) of all buckets of each session, empty ones too."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1
    bucket = F.least(F.floor(rank * F.lit(buckets) / n).cast("long"), F.lit(buckets - 1))
    summed = rows.select("session_id", bucket.alias("bucket"), chars.alias("chars")).groupBy("session_id", "bucket").agg(F.sum("chars").alias("chars"))
    grid = rows.select("session_id").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)).cast("array<bigint>")))
    return grid.join(summed, ["session_id", "bucket"], "left").select("session_id", "bucket", F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))


def bins(rows: DataFrame, hit: Column, width: int = 70) -> DataFrame:
    """(session_id, bin, hits, total) over a session's rows in order."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1
    return rows.select("session_id", F.floor(rank * width / n).cast("long").alias("bin"), hit.cast("long").alias("hit")).groupBy("session_id", "bin").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("total"))


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def last_usage(records: DataFrame, total: Column, main: Column) -> DataFrame:
    """(session_id, total) of the last main-chain record with any usage."""
    return records.where(main & (total > 0)).groupBy("session_id").agg(F.max_by(total, F.col("pos")).alias("total"))


def estimated_tokens(rows: DataFrame, chars: Column) -> DataFrame:
    return rows.groupBy("session_id").agg(F.greatest(F.floor(F.sum(chars) / 4), F.lit(1)).cast("long").alias("tokens"))


def sections(rows: DataFrame, size: int, tokens: Column, route: Column, snippet: Column) -> DataFrame:
    """(session_id, section, n, tokens, routes, snippet): the snippet is of the last row to keep, or else of the last."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1
    r = rows.select("session_id", F.floor(rank / size).cast("long").alias("section"), "pos", tokens.alias("tokens"), route.alias("route"), snippet.alias("snippet"))
    best = F.coalesce(F.max_by("snippet", F.when(F.col("route") == "KEEP", F.col("pos"))), F.max_by("snippet", "pos"))
    kept = F.count_if(F.col("route") == "KEEP")
    return r.groupBy("session_id", "section").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").cast("long").alias("tokens"), kept.alias("kept"), best.alias("snippet"))


def section_tree(rows: DataFrame, levels: int = 3, least: int = 50) -> DataFrame:
    """Roll-up of nested sections: a session's rows in chunks of max(50, n / 100), these in chunks of a hundred, and so on."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1
    size = F.greatest(F.lit(least), F.floor(n / 100))
    level = [F.floor(rank / (size * 100**k)).cast("long").alias(f"level{k}") for k in range(levels)]
    names = [f"level{k}" for k in reversed(range(levels))]
    return rows.select("session_id", *level).rollup("session_id", *names).agg(F.count(F.lit(1)).alias("n"))


def catalogue(rows: DataFrame, provider: str, project: str, ts: str) -> DataFrame:
    """Rows and last time by provider and project, with totals (null keys)."""
    return rows.rollup(provider, project).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_ts"))


def untagged_share(records: DataFrame, tagged: Column) -> DataFrame:
    """(session_id, share) of rows from a tenth to three quarters of a session that carry no tag."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1
    inside = (rank >= F.floor(n * 0.1)) & (rank <= F.floor(n * 0.75))
    return records.select("session_id", inside.alias("i"), tagged.alias("t")).where("i").groupBy("session_id").agg((F.count_if(~F.col("t")) / F.count(F.lit(1))).alias("share"))


def percentile_colour(rows: DataFrame, value: str) -> DataFrame:
    share = F.cume_dist().over(Window.orderBy(value))
    return rows.withColumn("colour", F.when(share <= 0.25, "cold").when(share <= 0.75, "warm").otherwise("hot"))


def page(rows: DataFrame, order: str, number: int, size: int = 100) -> DataFrame:
    """A page of the whole order, from 0."""
    return rows.orderBy(order).offset(number * size).limit(size)


def last_rows(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.desc("pos"))
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def same_role_gaps(rows: DataFrame, role: Column, hazard: Column) -> DataFrame:
    """(session_id, i, j): neighbouring messages of one role with only hazardous metadata, and some of it, between them."""
    w = Window.partitionBy("session_id").orderBy("pos")
    r = rows.select("session_id", "pos", role.alias("role"), hazard.alias("hazard"))
    r = r.withColumn("message", F.col("role").isNotNull()).withColumn("fine", F.sum((~F.col("message") & ~F.col("hazard")).cast("int")).over(w))
    m = r.where("message").withColumn("next_role", F.lead("role").over(w)).withColumn("j", F.lead("pos").over(w)).withColumn("next_fine", F.lead("fine").over(w))
    return m.where("role = next_role AND j > pos + 1 AND fine = next_fine").select("session_id", F.col("pos").alias("i"), "j")
