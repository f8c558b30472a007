"""Detectors over verb events (session_id, pos, event_id, kind, path, ...) and text blocks (session_id, pos, bi, text).

Each returns the rows found. Conditions that hold anywhere later are grouped minima or maxima joined back, which combine
before their shuffle; windows are used only where order within a path matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MUTATIONS = ("edit", "write")
KEY = ["session_id", "path"]


def _first_mutation(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind").isin(*MUTATIONS) & (F.col("path") != "")).groupBy(*KEY).agg(F.min("pos").alias("first_edit"))


def stale_reads(events: DataFrame) -> DataFrame:
    """Reads of a path that is first changed after them."""
    return events.where("kind = 'read'").join(_first_mutation(events), KEY).where("first_edit > pos")


def unmodified_reads(events: DataFrame) -> DataFrame:
    """Reads of a path that nothing changes after them."""
    return events.where("kind = 'read'").join(_first_mutation(events), KEY, "left").where("first_edit IS NULL OR first_edit <= pos")


def blind_edits(events: DataFrame, kinds: tuple[str, ...] = MUTATIONS) -> DataFrame:
    """Changes of a path that nothing has read before."""
    first = events.where("kind = 'read'").groupBy(*KEY).agg(F.min("pos").alias("first_read"))
    return events.where(F.col("kind").isin(*kinds) & (F.col("path") != "")).join(first, KEY, "left").where("first_read IS NULL OR first_read >= pos")


def superseded_edits(events: DataFrame) -> DataFrame:
    """Changes of a path that is changed again later."""
    changes = events.where(F.col("kind").isin(*MUTATIONS) & (F.col("path") != ""))
    return changes.join(changes.groupBy(*KEY).agg(F.max("pos").alias("last_edit")), KEY).where("last_edit > pos")


def superseded_reads(events: DataFrame) -> DataFrame:
    """Reads of a path that is read again later."""
    reads = events.where("kind = 'read'")
    return reads.join(reads.groupBy(*KEY).agg(F.max("pos").alias("last_read")), KEY).where("last_read > pos")


def error_retries(events: DataFrame, input_hash: str = "path") -> DataFrame:
    """Failed commands whose input is run again later."""
    runs = events.where(F.col("kind").isin("run", "build"))
    last = runs.groupBy("session_id", input_hash).agg(F.max("pos").alias("last_run"))
    return runs.where("is_error").join(last, ["session_id", input_hash]).where("last_run > pos")


def passing_builds(events: DataFrame) -> DataFrame:
    return events.where("kind = 'build' AND passed")


def duplicates(rows: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """All but the first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn > 1").drop("__rn")


def duplicate_references(refs: DataFrame, prefix: int = 300, tool: str = "tool_name") -> DataFrame:
    return duplicates(refs, [F.col("session_id"), F.col(tool), F.left("text", F.lit(prefix))], ["pos"])


def duplicate_blocks(blocks: DataFrame, least: int = 64) -> DataFrame:
    """Blocks whose text, of some length at least, an earlier block of the session has. Groups by digest, not by text."""
    return duplicates(blocks.where(F.length("text") >= least), [F.col("session_id"), F.md5(F.col("text").cast("binary"))], ["pos", "bi"])


def constant_fields(records: DataFrame, fields: list[str]) -> DataFrame:
    """(session_id, field) of fields that have one value throughout, in two records at least."""
    pairs = ", ".join(f"'{f}', cast({f} AS string)" for f in fields)
    long = records.selectExpr("session_id", f"stack({len(fields)}, {pairs}) AS (field, value)").where("value IS NOT NULL")
    return long.groupBy("session_id", "field").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo = hi AND n >= 2").select("session_id", "field", "n")


def findings(events: DataFrame) -> DataFrame:
    """One narrow table of what the detectors find: (session_id, finding, pos, event_id)."""
    parts = {"stale_read": stale_reads, "unmodified_read": unmodified_reads, "blind_edit": blind_edits, "superseded_edit": superseded_edits, "superseded_read": superseded_reads, "error_retry": error_retries}
    out = None
    for name, f in parts.items():
        part = f(events).select("session_id", F.lit(name).alias("finding"), "pos", "event_id")
        out = part if out is None else out.unionByName(part)
    return out
