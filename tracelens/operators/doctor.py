"""Integrity checks: each is a condition on records, a severity and, where it can be fixed, a transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.functions import text
from tracelens.operators import aggregate, reduce, relink

SEVERITIES = ("ok", "info", "warning", "critical")
# fixed values: severity of each check, and the order in which fixes run (others: 5)
CHECKS = {
    "api_error_artifacts": "critical",
    "mixed_content_format": "warning",
    "metadata_between_same_role": "warning",
    "compaction_summaries": "critical",
    "corrupted_tool_use": "critical",
    "corrupted_content_blocks": "critical",
    "unreduced_metadata": "info",
    "bloated_tur": "info",
    "orphaned_tool_results": "info",
    "parent_chain": "critical",
    "cycle_in_parent_chain": "critical",
    "null_parent_at_non_root": "warning",
    "protected_type_survival": "critical",
    "reduce_tags": "info",
    "overlapping_files": "warning",
    "stale_backups": "info",
    "stale_tokens": "warning",
    "oversized_sessions": "info",
}
# fixed values: texts that an interface leaves behind when a request fails
API_ERRORS = ("400 invalid_request_error", "tool_use_ids were found without tool_result", "each `assistant` message must be followed", "API Error: 400")


def diagnose(records: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(session_id, name, severity, hits, positions) of checks with any hit, in one pass over the records."""
    hits = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())
    found = records.select("session_id", "pos", F.explode(hits).alias("name"))
    severity = F.create_map(*[F.lit(x) for pair in CHECKS.items() for x in pair])
    return found.groupBy("session_id", "name").agg(F.count(F.lit(1)).alias("hits"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")).withColumn("severity", severity[F.col("name")])


def record_checks() -> dict[str, Column]:
    """Conditions on the canonical records table (see sources.transcripts)."""
    return {
        "mixed_content_format": F.col("msg_type").isin("user", "assistant") & (F.col("content_shape") == "str"),
        "compaction_summaries": text.is_continuation_summary(F.col("content_str")) & (F.coalesce("parent_uuid", F.lit("")) == ""),
        "unreduced_metadata": F.col("type").isin(*reduce.MERGE_HAZARDS),
        "null_parent_at_non_root": (F.col("pos") > 0) & (F.coalesce("parent_uuid", F.lit("")) == "") & ~F.coalesce("is_compact_summary", F.lit(False)) & F.col("msg_type").isin("user", "assistant"),
    }


def block_checks() -> dict[str, Column]:
    return {
        "corrupted_tool_use": (F.col("btype") == "tool_use") & (F.length("tool_name") > 200),
        "corrupted_content_blocks": F.col("btype").isin("tool_use", "tool_result") & (F.coalesce("tool_use_id", F.lit("")) == ""),
        "bloated_tur": (F.col("btype") == "tool_result") & (F.length("text") > 10240),
    }


def api_errors(records: DataFrame, marks: tuple[str, ...] = API_ERRORS, last: int = 20) -> DataFrame:
    """Assistant records with an error text among a session's last records."""
    return aggregate.last_rows(records, last).where((F.col("role") == "assistant") & text.contains_any(F.col("text"), marks))


def stale_tokens(records: DataFrame, chars: Column, usage: Column, off: float = 0.1, least: int = 100) -> DataFrame:
    """How many sessions' last usage is more than a tenth off their content's estimate."""
    s = records.groupBy("session_id").agg(F.floor(F.sum(chars) / 4).alias("est"), F.max_by(usage, F.col("pos")).alias("last"))
    hits = F.count_if((F.col("est") >= least) & (F.abs(F.col("last") - F.col("est")) > F.lit(off) * F.col("est")))
    return s.agg(hits.alias("hits")).select(F.lit("stale_tokens").alias("name"), F.when(F.col("hits") == 0, "ok").otherwise("warning").alias("severity"), "hits")


def worst(diagnostics: DataFrame) -> DataFrame:
    """(session_id, exit_code): 0 for none or info, 2 for a warning, 3 for a critical finding."""
    code = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).otherwise(0)
    return diagnostics.groupBy("session_id").agg(F.max(code).alias("exit_code"))


def fix_parent_chain(records: DataFrame, node: str = "uuid", parent: str = "parent_uuid") -> DataFrame:
    return relink.repair_parents(records, node, parent).drop(parent).withColumnRenamed("new_parent", parent)


def drop_and_relink(records: DataFrame, bad: Column, node: str = "uuid", parent: str = "parent_uuid") -> DataFrame:
    """Without the bad records; what pointed at one points at the nearest earlier record that stays."""
    flagged = records.withColumn("__bad", F.coalesce(bad, F.lit(False)))
    near = relink.nearest_before(flagged, node, ~F.col("__bad")).where("__bad").select(F.col(node).alias("__gone"), F.col("nearest").alias("__near"))
    rows = flagged.where("NOT __bad").join(near, F.col(parent) == F.col("__gone"), "left")
    return rows.withColumn(parent, F.when(F.col("__gone").isNotNull(), F.col("__near")).otherwise(F.col(parent))).drop("__bad", "__gone", "__near")
