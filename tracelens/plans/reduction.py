"""The reduction of whole transcripts: what stays, how it is linked, what is edited, and what that saves.

Passes are columns and joins over records and blocks. First records go: what a compaction replaced, noise, repeated system
texts and snapshots, failed commands that were run again, progress inside runs of web calls, results without a call; parents
move past them, within their session. Then each block gets at most one edit, the first rule that fits it, and facts for the
last pass; edits and facts meet in the records' text, which is parsed and written once. Positions are taken anew after
records are dropped, so strength follows the place among what stays.

Protected records are never dropped and get no edits before the last pass, which cuts all records alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import scalar, text, trim
from tracelens.operators import aggregate, detect, joins, reduce, relink
from tracelens.sources import transcripts


SEPARATOR = "\u001f"
# fixed values: names of tools
HTTP_TOOLS, AGENTS, CHANGES, READS = ("WebFetch", "WebSearch", "webfetch", "websearch"), ("Agent", "agent", "Task"), ("edit", "write"), ("Read", "read")
#: The strength by which results age, and from which each rule applies.
AGE_PLACE = 1.0
PASSING, STALE, CONFIRMED, SUPERSEDED, SEQUENCE, STRONGEST = 0.3, 0.5, 0.2, 0.5, 0.3, 0.8


@dataclass
class Reduced:
    kept: DataFrame
    edits: DataFrame
    stats: DataFrame
    before: DataFrame
    after: DataFrame


def _cut(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, if it has one: what follows reads it many times."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def _relinked(before: DataFrame, stay: DataFrame) -> DataFrame:
    """stay with both parents past the records that went, within their session; a chain that ends nowhere keeps its parent."""
    gone = before.join(stay.select("session_id", "pos"), ["session_id", "pos"], "left_anti").where("uuid IS NOT NULL")
    name = lambda c: F.concat("session_id", F.lit(SEPARATOR), c)
    rows = stay
    for parent in ("parent_uuid", "logical_parent_uuid"):
        links = gone.select(name("uuid").alias("node"), name(parent).alias("up"), "pos").groupBy("node").agg(F.max_by("up", "pos").alias("up"))
        moved = relink.relink(rows.withColumn("__parent", name(parent)), links, "__parent")
        rows = moved.withColumn(parent, F.substring_index("new_parent", SEPARATOR, -1)).drop("__parent", "new_parent")
    return rows


def _kept(recs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records that stay, with new parents; (session_id, name) of each dropped one)"""
    protected = reduce.is_protected(F.col("type"), F.col("subtype"), F.col("is_compact_summary"), F.col("visible_only"), F.col("preserved"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    soft = F.coalesce("type", F.lit("")).isin(*reduce.PROTECTED_TYPES) | yes("is_compact_summary") | yes("visible_only")
    rows = recs.withColumn("protected", protected).withColumn("soft", soft)
    boundary = (F.col("type") == "system") & F.coalesce("subtype", F.lit("")).isin(*reduce.BOUNDARIES)
    collapsed = reduce.boundary_collapse(rows, boundary, F.col("protected"), F.col("type").isin(*reduce.SINGLETON_TYPES), "type", F.col("preserves_segment")).drop("boundary")
    reason = F.when(F.col("protected"), F.lit(None)).otherwise(F.coalesce(reduce.drop_reason(F.col("type"), F.col("content_str")), F.when(F.col("type") == "attribution-snapshot", "attribution_snapshots_stripped")))
    noted = collapsed.withColumn("reason", reason)
    clean = noted.where("reason IS NULL").drop("reason")
    snapshots = reduce.keep_last(clean.where("type = 'file-history-snapshot'"), [F.coalesce("message_id", F.lit(""))])
    systems = reduce.keep_first(clean.where("msg_type = 'system' AND content_str IS NOT NULL AND coalesce(type, '') <> 'file-history-snapshot'"), [F.md5(F.col("content_str").cast("binary"))])
    rest = clean.where("NOT (coalesce(type, '') = 'file-history-snapshot') AND NOT (msg_type = 'system' AND content_str IS NOT NULL)")
    stay = _cut(rest.unionByName(snapshots).unionByName(systems))
    gone = recs.join(stay.select("session_id", "pos"), ["session_id", "pos"], "left_anti")
    names = gone.join(noted.where("reason IS NOT NULL").select("session_id", "pos", "reason"), ["session_id", "pos"], "left").select("session_id", F.coalesce("reason", F.when(F.col("type") == "file-history-snapshot", "file_history_deduped").when(F.col("msg_type") == "system", "dup_system").otherwise("compact_collapse_drops")).alias("name"))
    blks = _cut(transcripts.blocks(stay))
    for name, found in (("error_retries_dropped", _retries(blks)), ("http_spam_collapsed", _web_progress(stay, blks)), ("orphaned_tool_results", None)):
        # what the passes before dropped has no blocks any more; a call that went leaves its result without one
        blks = blks.join(stay.select("session_id", "pos"), ["session_id", "pos"], "left_semi")
        out = _emptied(blks) if found is None else found
        out = stay.where("NOT protected" if found is None or name == "error_retries_dropped" else "true").join(out.select("session_id", "pos").distinct(), ["session_id", "pos"], "left_semi")
        names = names.unionByName(out.select("session_id", F.lit(name).alias("name")))
        stay = stay.join(out.select("session_id", "pos"), ["session_id", "pos"], "left_anti")
    linked = _relinked(recs, stay)
    old = recs.select("session_id", "pos", F.col("parent_uuid").alias("__was"))
    return linked.join(old, ["session_id", "pos"]).withColumn("reparented", ~F.col("parent_uuid").eqNullSafe(F.col("__was"))).drop("__was"), names


def _retries(blks: DataFrame) -> DataFrame:
    """Records whose failed command is run again later."""
    return detect.error_retries(transcripts.verb_events(blks), "input_hash")


def _web_progress(stay: DataFrame, blks: DataFrame) -> DataFrame:
    """Progress records inside long runs of web calls, their results and progress."""
    calls = blks.where((F.col("btype") == "tool_use") & F.col("tool_name").isin(*HTTP_TOOLS))
    parts = blks.where("btype = 'tool_result'").join(calls.select("session_id", "tool_use_id").distinct(), ["session_id", "tool_use_id"], "left_semi")
    roles = calls.select("session_id", "pos", F.lit("call").alias("role3")).unionByName(parts.select("session_id", "pos", F.lit("part").alias("role3"))).groupBy("session_id", "pos").agg(F.min("role3").alias("role3"))
    rows = stay.select("session_id", "pos", (F.col("type") == "progress").alias("is_progress")).join(roles, ["session_id", "pos"], "left")
    return reduce.http_spam(rows.withColumn("role3", F.when(F.col("is_progress"), "part").otherwise(F.col("role3"))))


def _lone(blks: DataFrame) -> DataFrame:
    """Results without a call in their session."""
    uses = blks.where("btype = 'tool_use' AND tool_use_id <> ''").select("session_id", "tool_use_id")
    return joins.orphans(blks.where("btype = 'tool_result'"), uses, ["session_id", "tool_use_id"]).select("session_id", "pos", "bi")


def _emptied(blks: DataFrame) -> DataFrame:
    """Records that hold nothing but results without a call."""
    every = blks.groupBy("session_id", "pos").agg(F.count(F.lit(1)).alias("n"))
    return _lone(blks).groupBy("session_id", "pos").agg(F.count(F.lit(1)).alias("lone")).join(every, ["session_id", "pos"]).where("lone = n")


def _known_calls(blks: DataFrame, events: DataFrame) -> DataFrame:
    """One row for each call's id: its tool, its path, what its events make of it, and what detectors say."""
    calls = events.where("tool_use_id IS NOT NULL")
    ids = ["session_id", "tool_use_id"]
    kinds = calls.groupBy(*ids).agg(F.max_by("path", F.when(F.col("path") != "", F.col("seq"))).alias("path"), *[F.bool_or(F.col("kind").isin(*k)).alias(n) for n, k in (("is_read", ("read",)), ("is_change", CHANGES), ("is_edit", ("edit",)), ("shell", ("run", "build")))])
    tools = blks.where("btype = 'tool_use'").groupBy(*ids).agg(F.max_by("tool_name", F.struct("pos", "bi")).alias("used"), F.max("pos").alias("use_pos"))
    marks = (
        ("stale", detect.stale_reads(calls), F.lit(True)),
        ("unread", detect.unmodified_reads(calls), F.concat(F.lit("[Read: "), F.array_join(F.sort_array(F.collect_set(text.strip_non_ascii(F.col("path")))), ", "), F.lit(" - not modified]"))),
        ("passing", detect.passing_builds(calls), F.concat(F.lit("[Build passed: "), F.first(text.strip_non_ascii(text.excerpt(F.col("text")))), F.lit("]"))),
        ("superseded", detect.superseded_edits(calls), F.concat(F.lit("[Edit: "), F.first(text.strip_non_ascii(F.col("path"))), F.lit(" - superseded by later edit]"))),
        ("reread", detect.superseded_reads(calls.where(F.col("tool_name").isin(*READS))), F.concat(F.lit("[Read: "), F.first(text.strip_non_ascii(F.col("path"))))),
    )
    out = tools.join(kinds, ids, "left")
    for name, found, value in marks:
        value = F.max(F.lit(True)) if name == "stale" else value
        out = out.join(found.groupBy(*ids).agg(value.alias(name)), ids, "left")
    return out.withColumn("agent", F.col("used").isin(*AGENTS))


def _edits(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits: session_id, pos, bi, op, field, value, stat; facts for the last pass: session_id, pos, and each block's)."""
    blks = _cut(transcripts.blocks(kept))
    events = _cut(transcripts.verb_events(blks))
    place = reduce.with_aggressiveness(kept.select("session_id", "pos", "protected", "soft", "content_shape"))
    turn = (F.col("type") == "user") & ~F.exists(F.coalesce("blocks", F.array()), lambda b: b["btype"] == "tool_result")
    place = place.join(reduce.turns_ago(kept.select("session_id", "pos", "type", "blocks"), turn).select("session_id", "pos", "turns_ago"), ["session_id", "pos"])
    calls = _cut(_known_calls(blks, events))
    rows = blks.join(place, ["session_id", "pos"]).join(calls, ["session_id", "tool_use_id"], "left")
    by = ["session_id", "pos", "bi"]
    first = blks.where("btype = 'tool_result'").groupBy("session_id", "pos").agg(F.min("bi").alias("bi")).withColumn("leads", F.lit(True))
    near = blks.where("btype = 'tool_use'").select("session_id", "tool_use_id", F.col("pos").alias("__at"), F.col("bi").alias("__bi"), "tool_name", F.get_json_object("input", "$.file_path").alias("__path"))
    near = blks.where("btype = 'tool_result'").select(*by, "tool_use_id").join(near, ["session_id", "tool_use_id"]).where("__at < pos AND __at >= pos - 10").groupBy(*by).agg(F.min_by(F.struct("tool_name", F.col("__path").alias("path")), F.struct("__at", "__bi")).alias("near"))
    images = blks.where("btype = 'image'").join(kept.where("NOT soft").select("session_id", "pos"), ["session_id", "pos"], "left_semi").withColumn("event_id", F.col("bi"))
    spare = reduce.old_images(images).select(*by, F.lit(True).alias("old_image"))
    documents = reduce.document_dedup(blks.where("btype = 'text' OR (btype = 'tool_result' AND plain)").join(kept.where("NOT soft").select("session_id", "pos"), ["session_id", "pos"], "left_semi")).select(*by, F.col("stub").alias("copy"))
    twice = detect.duplicate_blocks(blks.where("btype IN ('text', 'tool_result')")).select(*by, F.lit(True).alias("twice"))
    alone = _lone(blks).withColumn("alone", F.lit(True))
    blind = detect.blind_edits(events.where("tool_use_id IS NOT NULL")).select("session_id", "tool_use_id").distinct().withColumn("blind", F.lit(True))
    for extra in (first, near, spare, documents, twice, alone):
        rows = rows.join(extra, ["session_id", "pos", "bi"], "left")
    rows = rows.join(blind, ["session_id", "tool_use_id"], "left")
    given = lambda k: F.coalesce(F.get_json_object("input", f"$.{k}"), F.lit(""))
    size = F.length(given("old_string")) + F.length(given("new_string"))
    row_n = Window.partitionBy("session_id", "path", "in_sequence").orderBy(F.desc("pos"), F.desc("bi"))
    rows = rows.withColumn("in_sequence", (F.col("btype") == "tool_use") & F.coalesce("is_edit", F.lit(False)) & ~F.col("protected") & (F.col("aggr") > SEQUENCE) & (F.coalesce("path", F.lit("")) != ""))
    rows = rows.withColumn("from_last", F.row_number().over(row_n)).withColumn("of_path", F.count(F.lit(1)).over(Window.partitionBy("session_id", "path", "in_sequence")))
    rows = _cut(rows)
    body, n_lines = F.col("text"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("string")
    result, plain_result = F.col("btype") == "tool_result", (F.col("btype") == "tool_result") & F.col("plain") & (F.col("msg_type") == "user")
    mid, old = scalar.age_limits(F.lit(AGE_PLACE))
    aged = plain_result & ~F.col("soft") & (F.length("text") >= 100)
    kb = F.format_string(" — %s lines, %.1fKB]", n_lines, F.length("text") / F.lit(1024.0))
    stub = F.concat(F.lit("["), F.when(F.coalesce("near.path", F.lit("")) != "", F.concat("near.tool_name", F.lit(" "), "near.path")).otherwise(F.coalesce("near.tool_name", F.lit("tool result"))), kb)
    short = lambda label, c, n: F.concat(F.lit(f"[{label}: "), text.strip_non_ascii(F.regexp_replace(F.left(c, F.lit(n)), "\n", " ")), F.lit("...]"))
    strongest = ~F.col("protected") & (F.col("aggr") > STRONGEST)
    line = F.when(F.col("is_read"), F.concat(F.lit("[Read: "), n_lines, F.lit(" lines]"))).when(F.col("shell"), short("Bash", "text", 100)).when(F.col("agent"), short("Agent result", "text", 100)).otherwise(F.concat(F.lit("["), F.coalesce("used", F.lit("")), F.lit(": "), text.strip_non_ascii(F.regexp_replace(F.left("text", F.lit(80)), "\n", " ")), F.lit("...]")))
    patch = lambda **v: F.to_json(F.struct(*[c.alias(k) for k, c in v.items()]), {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    changed = F.col("btype") == "tool_use"
    rules = [
        (result & (F.col("msg_type") == "user") & F.col("reread").isNotNull() & (F.col("pos") > 0), "text", F.concat("reread", F.lit(" - "), F.when(F.col("plain"), n_lines).otherwise(F.lit("0")), F.lit(" lines, superseded by later read]")), "reads_deduped"),
        (F.col("leads") & F.col("passing").isNotNull() & (F.col("aggr") > PASSING), "text", F.col("passing"), "passing_builds_collapsed"),
        (F.col("leads") & F.col("unread").isNotNull() & (F.col("aggr") > STALE), "text", F.col("unread"), "stale_reads_promoted"),
        ((F.col("btype") == "text") & (F.col("type") == "user") & (F.col("content_shape") == "str") & (F.col("aggr") > CONFIRMED) & text.is_confirmation(body), "text", F.lit("[confirmed]"), "confirmations_removed"),
        (changed & F.col("superseded").isNotNull() & (F.col("aggr") > SUPERSEDED), "input", patch(old_string=none, new_string=none, _elided=F.col("superseded")), "superseded_edits_summarized"),
        (F.col("in_sequence") & (F.col("of_path") >= 3) & (F.col("from_last") > 1) & (size > 100), "input", patch(old_string=F.lit(""), new_string=F.concat(F.lit("[collapsed: ~"), size.cast("string"), F.lit(" chars, see later edit]"))), "edit_sequences_collapsed"),
        (F.coalesce("old_image", F.lit(False)), "drop_block", none, "images_stripped"),
        (F.coalesce("alone", F.lit(False)) & ~F.col("protected"), "drop_block", none, "orphaned_tool_results"),
        (aged & (F.col("turns_ago") >= old), "text", stub, "age_tool_results_stubbed"),
        (F.col("copy").isNotNull(), "text", F.col("copy"), "documents_deduped"),
        (strongest & plain_result & (F.length("text") > 200), "text", line, "nuclear_results_replaced"),
        (strongest & changed & F.coalesce("is_edit", F.lit(False)) & (size > 200), "input", patch(old_string=F.concat(F.lit("[~"), F.length(given("old_string")).cast("string"), F.lit(" chars]")), new_string=F.concat(F.lit("[~"), F.length(given("new_string")).cast("string"), F.lit(" chars]"))), "nuclear_edits_replaced"),
        (strongest & changed & F.coalesce("agent", F.lit(False)) & (F.length(given("prompt")) > 200), "input", patch(prompt=short("Agent task", given("prompt"), 150)), "nuclear_agents_replaced"),
    ]
    chosen = None
    for applies, op, value, stat in rules:
        edit = F.struct(F.lit(op).alias("op"), value.alias("value"), F.lit(stat).alias("stat"))
        chosen = F.when(applies, edit) if chosen is None else chosen.when(applies, edit)
    edits = rows.withColumn("e", F.when(~F.col("protected"), chosen)).where("e IS NOT NULL").select(*by, "e.op", F.lit(None).cast("string").alias("field"), "e.value", "e.stat")
    envelope = [f"get_json_object(raw, '$.{c}') AS {c}" for c in reduce.ENVELOPE]
    constant = detect.constant_fields(kept.selectExpr("session_id", *envelope), list(reduce.ENVELOPE)).select("session_id", "field")
    held = kept.where("NOT soft AND pos > 0").select("session_id", "pos", F.explode(F.array_intersect(F.expr("json_object_keys(raw)"), F.array(*map(F.lit, reduce.ENVELOPE)))).alias("field"))
    first_pos = kept.groupBy("session_id").agg(F.min("pos").alias("first"))
    strip = held.join(constant, ["session_id", "field"]).join(first_pos, "session_id").where("pos > first").select("session_id", "pos", F.lit(None).cast("int").alias("bi"), F.lit("drop_field").alias("op"), "field", none.alias("value"), F.lit("envelope_fields_stripped").alias("stat"))
    facts = rows.where("btype IN ('text', 'tool_result')").select("session_id", "pos", F.struct("bi", F.col("used").alias("name"), "stale", "blind", "agent", "shell", "twice", (aged & (F.col("turns_ago") >= mid) & (F.col("turns_ago") < old)).alias("mid")).alias("fact"))
    return edits.unionByName(strip), facts.groupBy("session_id", "pos").agg(F.collect_list("fact").alias("facts"))


def reduce_transcripts(recs: DataFrame, profile: str = "standard", home: str = "/home/user") -> Reduced:
    """kept records with edited text, the edits, counts by name, and densities before and after."""
    kept, dropped = _kept(recs)
    kept = _cut(kept)
    edits, facts = _edits(kept)
    edits = _cut(edits)
    place = reduce.with_aggressiveness(kept.select("session_id", "pos"))
    todo = edits.groupBy("session_id", "pos").agg(F.collect_list(F.struct("bi", "op", "field", "value")).alias("edits"))
    names = reduce.ALWAYS_STRIP + (reduce.AGGRESSIVE_STRIP if profile == "aggressive" else ())
    rows = kept.join(place, ["session_id", "pos"]).join(todo, ["session_id", "pos"], "left").join(facts, ["session_id", "pos"], "left")
    last = trim.finished(names, profile, home)("raw", F.coalesce("msg_type", F.lit("")), "aggr", "soft", "edits", "facts")
    done = _cut(rows.withColumn("__done", last).drop("edits", "facts", "aggr").withColumn("raw", F.col("__done.raw")).withColumn("done", F.col("__done.done")).drop("__done"))
    done = _cut(transcripts.with_parents(done))
    counted = dropped.unionByName(edits.select("session_id", F.col("stat").alias("name"))).unionByName(kept.where("reparented").select("session_id", F.lit("reparented").alias("name"))).unionByName(done.select("session_id", F.explode("done").alias("name")))
    stats = counted.groupBy("session_id", "name").agg(F.count(F.lit(1)).alias("value"))
    size = F.length("raw")
    return Reduced(done.drop("done"), edits, stats, aggregate.density(recs, size), aggregate.density(done, size))
