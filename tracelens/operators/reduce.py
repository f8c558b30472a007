"""Reduction passes over records, events and blocks. Each returns what it drops or the new text, never a rewritten file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import scalar, text

# fixed values: record types and commands
PROTECTED_TYPES = ("content-replacement", "marble-origami-commit", "marble-origami-snapshot", "worktree-state", "task-summary")
BOUNDARIES = ("compact_boundary", "microcompact_boundary")
DROPPABLE_TYPES = ("progress", "queue-operation", "last-prompt")
SINGLETON_TYPES = ("last-prompt", "pr-link", "custom-title", "ai-title", "attribution-snapshot")
MERGE_HAZARDS = ("progress", "file-history-snapshot", "queue-operation", "last-prompt", "attribution-snapshot")
NOISE_COMMANDS = ("/reload-plugins", "/plugin", "/mcp", "/login", "/effort", "/compact")
ENVELOPE = ("cwd", "version", "gitBranch", "slug", "userType")
ALWAYS_STRIP = ("sessionId", "isSidechain", "entrypoint", "userType")
AGGRESSIVE_STRIP = ("version", "requestId", "promptId", "sourceToolAssistantUUID", "slug")


def with_aggressiveness(rows: DataFrame, cut: float = 0.10, fade: float = 0.75) -> DataFrame:
    """rows with `aggr`, of their place in their session."""
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1
    return rows.withColumn("aggr", scalar.aggressiveness(scalar.relative_position(rank, n), cut, fade))


def is_protected(type_: Column, subtype: Column, compact_summary: Column, visible_only: Column, preserved: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.coalesce(type_, F.lit("")).isin(*PROTECTED_TYPES) | (yes(compact_summary) & (F.coalesce(type_, F.lit("")) == "user")) | yes(visible_only) | F.coalesce(subtype, F.lit("")).isin(*BOUNDARIES) | yes(preserved)


def drop_reason(type_: Column, content: Column) -> Column:
    """Why a record is noise; null if it isn't."""
    c = F.coalesce(content, F.lit(""))
    user = type_ == "user"
    command = F.lit(False)
    for name in NOISE_COMMANDS:
        command = command | c.contains(f">{name}<")
    return (
        F.when(type_.isin(*DROPPABLE_TYPES), type_)
        .when(user & c.contains("<task-notification>"), "task_notification")
        .when(user & (c.contains("<local-command-caveat>") | c.contains("<local-command-stdout>") | (c.contains("<command-name>") & command)), "local_cmd_noise")
    )


def keep_first(rows: DataFrame, key: list, order: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy("session_id", *key).orderBy(*(order or ["pos"]))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def keep_last(rows: DataFrame, key: list) -> DataFrame:
    w = Window.partitionBy("session_id", *key).orderBy(F.desc("pos"))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def system_dedup(records: DataFrame, role: str = "role", body: str = "text") -> DataFrame:
    """Without system records whose content an earlier one of the session has."""
    systems = records.where(F.col(role) == "system")
    return keep_first(systems, [F.md5(F.col(body).cast("binary"))]).unionByName(records.where(F.col(role).isNull() | (F.col(role) != "system")))


def boundary_collapse(records: DataFrame, boundary: Column, protected: Column, singleton: Column | None = None, type_: str = "event_type", preserves: Column | None = None) -> DataFrame:
    """Without what lies before a session's last boundary, but for protected records and singletons of types that don't come again.

    A last boundary that preserves a segment (`preserves`) collapses nothing.
    """
    at = records.where(boundary).groupBy("session_id").agg(F.max("pos").alias("boundary"), F.max_by(F.coalesce(preserves, F.lit(False)) if preserves is not None else F.lit(False), F.col("pos")).alias("__whole"))
    at = at.where("NOT __whole").drop("__whole")
    rows = records.join(at, "session_id", "left")
    after = rows.where("pos >= boundary").select(F.col("session_id").alias("__session"), F.col(type_).alias("__type")).distinct()
    keep = F.col("boundary").isNull() | (F.col("pos") >= F.col("boundary")) | protected
    if singleton is not None:
        rows = rows.join(after, (F.col("session_id") == F.col("__session")) & (F.col(type_) == F.col("__type")), "left")
        keep = keep | (singleton & F.col("__type").isNull())
        return rows.where(keep).drop("__type", "__session")
    return rows.where(keep)


def read_stubs(events: DataFrame, lines: Column) -> DataFrame:
    """A stub for each read of a path that is read again."""
    last = events.where("kind = 'read'").groupBy("session_id", "path").agg(F.max("pos").alias("last_read"))
    rows = events.where("kind = 'read'").join(last, ["session_id", "path"]).where("pos < last_read")
    return rows.withColumn("stub", F.concat(F.lit("[Read: "), F.col("path"), F.lit(" - "), lines.cast("string"), F.lit(" lines, superseded by later read]")))


def edit_sequences(events: DataFrame, least: int = 3, above: float = 0.3) -> DataFrame:
    """All but the last of `least` or more changes of a path where compression is stronger than `above`."""
    rows = with_aggressiveness(events).where((F.col("kind") == "edit") & (F.col("aggr") > F.lit(above)))
    n = rows.groupBy("session_id", "path").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))
    return rows.join(n, ["session_id", "path"]).where((F.col("n") >= least) & (F.col("pos") < F.col("last")))


def turns_ago(records: DataFrame, turn: Column) -> DataFrame:
    """records with the number of real user turns after them."""
    w = Window.partitionBy("session_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    return records.withColumn("turns_ago", F.coalesce(F.sum(turn.cast("long")).over(w), F.lit(0)))


def age_class(turns: Column, aggr: Column) -> Column:
    mid, old = scalar.age_limits(aggr)
    return F.when(turns >= old, "old").when(turns >= mid, "mid").otherwise("new")


def old_images(images: DataFrame, share: float = 0.2) -> DataFrame:
    """Images but for the newest share of a session's, one at least."""
    by_new = Window.partitionBy("session_id").orderBy(F.desc("pos"), F.desc("event_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    return images.withColumn("__rn", F.row_number().over(by_new)).withColumn("__keep", F.greatest(F.lit(1), F.round(n * F.lit(share)))).where("__rn > __keep").drop("__rn", "__keep")


def document_dedup(blocks: DataFrame, least_bytes: int = 1024) -> DataFrame:
    """Blocks of some size whose text an earlier record of the session has, with the bytes that a stub saves."""
    big = blocks.where(F.octet_length("text") >= least_bytes).withColumn("__h", F.md5(F.col("text").cast("binary")))
    first = big.groupBy("session_id", "__h").agg(F.min("pos").alias("first_pos"))
    rows = big.join(first, ["session_id", "__h"]).where("pos > first_pos").drop("__h")
    stub = F.concat(F.lit("[duplicate content removed - first seen earlier: "), F.left("text", F.lit(80)), F.lit("...]"))
    return rows.withColumn("stub", stub).withColumn("bytes_saved", (F.octet_length("text") - F.octet_length("stub")).cast("long"))


def mega_blocks(blocks: DataFrame, limit: int = 32768) -> DataFrame:
    """Blocks of more than `limit` bytes, cut at as many characters."""
    return blocks.where(F.octet_length("text") > limit).withColumn("new_text", text.truncate(F.col("text"), limit, "mega-block"))


def nuclear(results: DataFrame, above: float = 0.8, least: int = 200) -> DataFrame:
    """One-line replacements of long results (kind, tool_name, text) where compression is strongest."""
    rows = with_aggressiveness(results).where((F.col("aggr") > F.lit(above)) & (F.length("text") > least))
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("string")
    short = lambda label, n: F.concat(F.lit(f"[{label}: "), F.left("text", F.lit(n)), F.lit("...]"))
    other = F.concat(F.lit("["), F.col("tool_name"), F.lit(": "), F.left("text", F.lit(80)), F.lit("...]"))
    return rows.withColumn("new_text", F.when(F.col("kind") == "read", F.concat(F.lit("[Read: "), lines, F.lit(" lines]"))).when(F.col("kind").isin("run", "build"), short("Bash", 100)).when(F.col("kind") == "agent", short("Agent result", 100)).otherwise(other))


def http_spam(records: DataFrame, most: int = 3) -> DataFrame:
    """Progress records inside runs of more than `most` records of http calls, their results and progress.

    A run begins at an http call and ends before the first record that is none of these: gaps and islands over `role3`
    ('call', 'part' for results and progress, else null) with `is_progress`.
    """
    w = Window.partitionBy("session_id").orderBy("pos")
    rows = records.withColumn("__break", (F.col("role3").isNull() | ((F.col("role3") == "call") & (F.coalesce(F.lag("role3").over(w), F.lit("")) == ""))).cast("int"))
    rows = rows.withColumn("__run", F.sum("__break").over(w))
    in_run = F.col("role3").isNotNull()
    size = Window.partitionBy("session_id", "__run")
    rows = rows.withColumn("__n", F.sum(in_run.cast("int")).over(size)).withColumn("__call", F.max((F.col("role3") == "call").cast("int")).over(size))
    return rows.where((F.col("__n") > most) & (F.col("__call") == 1) & F.col("is_progress")).drop("__break", "__run", "__n", "__call")


def limited_text(rows: DataFrame, key: Column | str, label: str, profile: str = "standard") -> DataFrame:
    """rows with `new_text`: text cut at the limit that its place and profile give."""
    placed = with_aggressiveness(rows)
    return placed.withColumn("limit", scalar.blended_limit(key, F.col("aggr"), profile)).withColumn("new_text", text.truncate(F.col("text"), F.col("limit"), label))


def strip_fields(fields: Column, profile: str = "standard") -> Column:
    """Of an array of a record's top-level field names, those that the metadata pass takes away."""
    names = ALWAYS_STRIP + (AGGRESSIVE_STRIP if profile == "aggressive" else ())
    return F.array_intersect(fields, F.array(*[F.lit(n) for n in names]))
