"""Transcript files as records and blocks: scanning, the two grammars, and the catalogue.

A file is JSON lines. It is read whole so that line numbers are exact; sessions are the unit of parallel work. Lines that
are blank are skipped, lines that are no JSON objects become errors, and the rest keep their text, since only that holds
every key in its order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelens.functions import scalar

SESSION = r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
# fixed values: roles of the second grammar's record and payload types, and its tool names
TYPE_ROLES = {"SessionMetaLine": "system", "session_meta": "system", "session_meta_line": "system", "EventMsg": "assistant", "RolloutLine": "assistant", "response": "assistant", "response_item": "assistant"}
PAYLOAD_ROLES = {
    "user_message": "user", "assistant_message": "assistant", "agent_message": "assistant", "message": "assistant", "function_call": "assistant", "function_call_output": "assistant", "tool_search_call": "assistant",
    "tool_search_output": "assistant", "custom_tool_call": "assistant", "custom_tool_call_output": "assistant", "reasoning": "assistant", "web_search_call": "assistant", "web_search_end": "assistant", "patch_apply_end": "assistant",
    "mcp_tool_call_end": "assistant", "token_count": "system", "task_started": "system", "task_complete": "system", "context_compacted": "system", "turn_aborted": "system",
}
TOOL_NAMES = {"exec_command": "Bash"}
CALLS = ("function_call", "custom_tool_call", "tool_search_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output", "tool_search_output")

BLOCK = T.StructType([T.StructField(n, t) for n, t in (("btype", T.StringType()), ("text", T.StringType()), ("tool_use_id", T.StringType()), ("tool_name", T.StringType()), ("input", T.StringType()), ("is_error", T.BooleanType()), ("plain", T.BooleanType()))])
NORMAL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "subtype", "role", "uuid", "parent_uuid", "logical_parent_uuid", "ts", "message_id", "content_shape", "content_str")]
    + [T.StructField(n, T.BooleanType()) for n in ("is_sidechain", "is_compact_summary", "visible_only", "preserved", "preserves_segment")]
    + [T.StructField("usage", T.StructType([T.StructField(n, T.LongType()) for n in ("input", "cache_read", "cache_create")])), T.StructField("blocks", T.ArrayType(BLOCK))]
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, line_no, raw) of all lines that aren't blank, of files or folders of files."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    rows = whole.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.posexplode(F.split("value", r"\r\n|\r|\n", -1)).alias("line_no", "raw"))
    return rows.withColumn("raw", F.regexp_replace("raw", r"^\s+|\s+$", "")).where("raw <> ''")


def session_of(file: Column) -> Column:
    """The id in a file's name, or its name without ending. Continuations (<id>.<digits>...) have the id of their main file."""
    name = F.element_at(F.split(file, "/"), -1)
    found = F.regexp_extract(name, SESSION, 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(name, r"\.jsonl$", ""))


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records: session_id, file, line_no, pos, raw, v; errors: session_id, file, line_no, raw).

    pos counts the good records of a session, files in order of their last change.
    """
    rows = lines(spark, path).where(~F.col("file").rlike(r"\.(bak2?|reduced)$")).withColumn("session_id", session_of(F.col("file"))).withColumn("v", F.try_parse_json("raw"))
    good = F.col("v").isNotNull() & F.startswith("raw", F.lit("{"))
    order = Window.partitionBy("session_id").orderBy("modified", "file", "line_no")
    return rows.where(good).withColumn("pos", (F.row_number().over(order) - 1).cast("int")), rows.where(~good).select("session_id", "file", "line_no", "raw")


def field(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def detect_codec(records: DataFrame) -> DataFrame:
    """(session_id, codec): by how many records look like either grammar, the second weighing twice; 'plain' on ties."""
    plain = field("message").isNotNull() | field("parentUuid").isNotNull() | field("sessionId").isNotNull()
    rolled = F.try_variant_get("v", "$.payload", "variant").isNotNull() | field("type").isin(*TYPE_ROLES)
    plain = plain | F.try_variant_get("v", "$.message", "variant").isNotNull()
    score = records.groupBy("session_id").agg(F.sum(F.when(plain, 100).otherwise(0)).alias("p"), F.sum(F.when(rolled, 200).otherwise(0)).alias("r"))
    return score.select("session_id", F.when(F.col("r") > F.col("p"), "rollout").otherwise("plain").alias("codec"))


def _text_of(content: Any) -> str:
    """A result's or message's text: a string, or the texts of a list joined by line breaks."""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(x if isinstance(x, str) else str(x.get("text") or "") for x in content if isinstance(x, str) or (isinstance(x, dict) and x.get("text")))
    if isinstance(content, dict):
        return str(content.get("text") or content.get("message") or "")
    return ""


def _block(b: Any) -> dict | None:
    if isinstance(b, str):
        b = {"type": "text", "text": b}
    if not isinstance(b, dict):
        return None
    kind = str(b.get("type") or "text")
    text = {"thinking": b.get("thinking"), "tool_result": _text_of(b.get("content"))}.get(kind, b.get("text"))
    ident = b.get("id") if kind == "tool_use" else b.get("tool_use_id")
    return {"btype": kind, "text": text if isinstance(text, str) else None, "tool_use_id": ident if isinstance(ident, str) else None, "tool_name": b.get("name") if isinstance(b.get("name"), str) else None, "input": json.dumps(b["input"], sort_keys=True, separators=(",", ":")) if "input" in b else None, "is_error": bool(b.get("is_error")), "plain": isinstance(b.get("content"), str)}


def _blocks(content: Any) -> tuple[str | None, list[dict]]:
    if isinstance(content, list):
        return "list", [x for x in map(_block, content) if x]
    if isinstance(content, str):
        return "str", [x for x in [_block(content)] if x]
    if isinstance(content, dict):
        return "dict", [x for x in [_block({"type": "text", "text": _text_of(content)})] if x]
    return None, []


def _usage(u: Any) -> dict | None:
    if not isinstance(u, dict):
        return None
    n = lambda k: u[k] if isinstance(u.get(k), int) else 0
    return {"input": n("input_tokens"), "cache_read": n("cache_read_input_tokens"), "cache_create": n("cache_creation_input_tokens")}


def _plain(o: dict) -> dict:
    m = o.get("message") if isinstance(o.get("message"), dict) else {}
    shape, blocks = _blocks(m.get("content"))
    s = lambda x: x if isinstance(x, str) else None
    return {
        "type": s(o.get("type")), "subtype": s(o.get("subtype")) or s(m.get("subtype")), "role": s(m.get("role")), "uuid": s(o.get("uuid")), "parent_uuid": s(o.get("parentUuid")), "logical_parent_uuid": s(o.get("logicalParentUuid")),
        "ts": s(o.get("timestamp")), "message_id": s(o.get("messageId")), "content_shape": shape, "content_str": m.get("content") if shape == "str" else None, "is_sidechain": bool(o.get("isSidechain")),
        "is_compact_summary": bool(o.get("isCompactSummary")), "visible_only": bool(o.get("isVisibleInTranscriptOnly")), "preserved": any(k.startswith("__") and k.endswith("_preserved__") and bool(v) for k, v in o.items()), "preserves_segment": bool(o.get("hasPreservedSegment")), "usage": _usage(m.get("usage")), "blocks": blocks,
    }


def _decoded(x: Any) -> Any:
    if isinstance(x, str):
        try:
            return json.loads(x)
        except ValueError:
            return None
    return x


def _rollout(o: dict) -> dict:
    """The second grammar in the first one's shape: calls become tool_use blocks, their outputs tool_result blocks."""
    p = o.get("payload") if isinstance(o.get("payload"), dict) else {}
    kind = str(p.get("type") or "")
    content: Any = p.get("message") or p.get("content") or o.get("content") or p.get("text")
    if kind in CALLS:
        given = p.get("arguments", p.get("input"))
        decoded = _decoded(given)
        name = str(p.get("name") or kind)
        content = [{"type": "tool_use", "id": p.get("call_id"), "name": TOOL_NAMES.get(name, name), "input": decoded if isinstance(decoded, dict) else {"input": given}}]
    elif kind in OUTPUTS:
        out = p.get("output")
        listed = _decoded(out)
        content = [{"type": "tool_result", "tool_use_id": p.get("call_id"), "content": listed if isinstance(listed, list) else out if isinstance(out, str) else json.dumps(out)}]
    info = p.get("info") if isinstance(p.get("info"), dict) else {}
    counts = [u for u in (info.get("total_token_usage"), info.get("last_token_usage")) if isinstance(u, dict)]
    role = str(p.get("role") or o.get("role") or PAYLOAD_ROLES.get(kind) or TYPE_ROLES.get(str(o.get("type"))) or "assistant").lower()
    made = _plain({"type": o.get("type"), "uuid": o.get("uuid") or o.get("id"), "parentUuid": o.get("parentUuid"), "timestamp": o.get("timestamp"), "message": {"role": "assistant" if role == "developer" else role, "content": content}})
    if counts:
        most = lambda k: max(int(u.get(k) or 0) for u in counts)
        made["usage"] = {"input": most("input_tokens"), "cache_read": most("cached_input_tokens"), "cache_create": 0}
    return made


@F.pandas_udf(NORMAL)
def normalised(raw: pd.Series, codec: pd.Series) -> pd.DataFrame:
    rows = [(_rollout if c == "rollout" else _plain)(json.loads(r)) for r, c in zip(raw, codec, strict=True)]
    return pd.DataFrame(rows, columns=NORMAL.names)


def records(scanned: DataFrame) -> DataFrame:
    """The canonical records table, from scan()'s good rows."""
    rows = scanned.join(detect_codec(scanned), "session_id").drop("v").withColumn("n", normalised("raw", "codec"))
    flat = rows.select("session_id", "file", "line_no", "pos", "raw", "codec", *[F.col(f"n.{c}").alias(c) for c in NORMAL.names])
    return flat.withColumn("ts", scalar.parse_time(F.col("ts"))).withColumn("msg_type", scalar.message_type(F.col("role"), F.col("type")))


def blocks(recs: DataFrame) -> DataFrame:
    return recs.select("session_id", "pos", "uuid", "msg_type", "type", F.posexplode("blocks").alias("bi", "b")).select("session_id", "pos", "uuid", "msg_type", "type", "bi", "b.*")


def input_hash(payload: str) -> str:
    return hashlib.sha256(payload.encode("utf-8", "replace")).hexdigest()[:16]


def verb_events(blks: DataFrame) -> DataFrame:
    """Typed events of tool calls, thinking and short affirmations, with the first result of each call."""
    from tracelens.functions.python_text import shell
    from tracelens.functions.text import build_outcome
    from tracelens.operators.joins import with_first_result

    results = blks.where("btype = 'tool_result' AND tool_use_id <> ''").select("session_id", "tool_use_id", "pos", "bi", F.col("text").alias("output"), F.col("is_error").alias("failed"))
    uses = blks.where("btype = 'tool_use'").select("session_id", "pos", "bi", "uuid", "tool_use_id", "tool_name", "input")
    calls = with_first_result(uses, results, ["session_id", "tool_use_id"], ["pos", "bi"], ["output", "failed"])
    arg = lambda k: F.coalesce(F.get_json_object("input", f"$.{k}"), F.lit(""))
    path = F.coalesce(F.nullif(arg("file_path"), F.lit("")), F.nullif(arg("path"), F.lit("")), arg("notebook_path"))
    name = F.lower("tool_name")
    shelled = calls.where(name.isin("bash", "shell", "exec_command")).withColumn("command", F.coalesce(F.nullif(arg("command"), F.lit("")), arg("cmd"))).withColumn("s", shell("command"))
    is_build, passed = build_outcome(F.coalesce("output", F.lit("")), F.coalesce("failed", F.lit(False)))
    one = F.when(F.col("s.kind").isin("read", "write", "edit"), F.col("s.kind")).when(is_build | (F.col("s.kind") == "build"), "build").otherwise("run")
    bash = shelled.select("session_id", "pos", "bi", "uuid", "tool_use_id", "tool_name", "input", "output", "failed", one.alias("kind"), passed.alias("passed"), "s.paths", "s.read_through")
    through = bash.where(F.size("read_through") > 0).select(*[c for c in bash.columns if c not in ("kind", "paths", "read_through", "passed")], F.lit("read").alias("kind"), F.lit(False).alias("passed"), F.explode("read_through").alias("path"))
    direct = bash.select(*[c for c in bash.columns if c not in ("paths", "read_through")], F.explode_outer("paths").alias("path"))
    kind = F.when(name == "read", "read").when(name.isin("edit", "multiedit", "apply_patch"), "edit").when(name.isin("write", "notebookedit"), "write").when(name.startswith("mcp__"), "reference")
    tools = calls.where(~name.isin("bash", "shell", "exec_command")).select("session_id", "pos", "bi", "uuid", "tool_use_id", "tool_name", "input", "output", "failed", kind.alias("kind"), F.lit(False).alias("passed"), path.alias("path")).where("kind IS NOT NULL AND (kind = 'reference' OR path <> '')")
    said = blks.where("(btype = 'thinking') OR (btype = 'text' AND msg_type = 'user' AND length(text) < 60)").select("session_id", "pos", "bi", "uuid", "tool_use_id", "tool_name", "input", F.col("text").alias("output"), F.lit(False).alias("failed"), F.when(F.col("btype") == "thinking", "think").otherwise("affirm").alias("kind"), F.lit(False).alias("passed"), F.lit(None).cast("string").alias("path"))
    every = through.unionByName(direct).unionByName(tools).unionByName(said)
    order = Window.partitionBy("session_id").orderBy("pos", "bi", F.when(F.col("kind") == "read", 0).otherwise(1), "path")
    hashed = F.left(F.sha2(F.coalesce("input", F.lit("")).cast("binary"), 256), F.lit(16))
    return every.select("session_id", F.col("pos").cast("long").alias("pos"), (F.row_number().over(order) - 1).alias("seq"), F.col("uuid").alias("event_id"), "tool_use_id", "tool_name", "kind", "path", F.coalesce("failed", F.lit(False)).alias("is_error"), "passed", hashed.alias("input_hash"), F.col("output").alias("text"))


def catalogue(recs: DataFrame) -> DataFrame:
    """One row per session: records, times, last branch, first user text, tokens of the last use."""
    branch = F.get_json_object("raw", "$.gitBranch")  # of the record itself, not of a text that quotes one
    plausible = F.coalesce(branch != "", F.lit(False)) & ~branch.contains(" ") & (F.length("raw") > 0)
    total = F.when(F.col("usage").isNotNull(), scalar.usage_total(F.col("usage")))
    return recs.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("file").alias("files"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by(branch, F.when(plausible, F.col("pos"))).alias("branch"),
        F.min_by(F.left("content_str", F.lit(80)), F.when((F.col("msg_type") == "user") & F.col("content_str").isNotNull(), F.col("pos"))).alias("title"), F.max_by(total, F.when(total > 0, F.col("pos"))).alias("tokens"),
    )


def tail(recs: DataFrame, n: int) -> DataFrame:
    from tracelens.operators.aggregate import last_rows

    return last_rows(recs, n)


def write_reduced(recs: DataFrame, folder: str) -> None:
    """One folder per session, its records' lines in order; what is there of these sessions is replaced."""
    rows = recs.repartition("session_id").sortWithinPartitions("session_id", "pos").select("session_id", F.col("raw").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").text(folder)


def apply_edits(recs: DataFrame, edits: DataFrame) -> DataFrame:
    """recs with edits (session_id, pos, bi or null, op, field, value) put into `raw`.

    op: 'drop_field' takes a top-level field away, 'text' replaces a block's text. A record is parsed and written once,
    compactly and in ASCII, with its keys in their order; records without edits keep their bytes.
    """
    listed = edits.groupBy("session_id", "pos").agg(F.collect_list(F.struct("bi", "op", "field", "value")).alias("edits"))

    @F.pandas_udf(T.StringType())
    def put(raw: pd.Series, todo: pd.Series) -> pd.Series:
        return pd.Series([r if e is None or not len(e) else _edited(r, e) for r, e in zip(raw, todo, strict=True)])

    return recs.join(listed, ["session_id", "pos"], "left").withColumn("raw", put("raw", "edits")).drop("edits")


def with_parents(recs: DataFrame) -> DataFrame:
    """recs with their parents put into the lines that hold others; a key that a line does not have is not added."""

    @F.pandas_udf(T.StringType())
    def put(raw: pd.Series, parent: pd.Series, logical: pd.Series) -> pd.Series:
        return pd.Series([_linked(r, (("parentUuid", p), ("logicalParentUuid", q))) for r, p, q in zip(raw, parent, logical, strict=True)])

    return recs.withColumn("raw", F.when(F.col("reparented"), put("raw", "parent_uuid", "logical_parent_uuid")).otherwise(F.col("raw")))


def _linked(raw: str, parents: tuple[tuple[str, str | None], ...]) -> str:
    o = json.loads(raw)
    o.update({k: p for k, p in parents if k in o and isinstance(p, str)})
    return json.dumps(o, separators=(",", ":"))


def _edited(raw: str, todo: Any) -> str:
    o = json.loads(raw)
    for e in todo:
        if e["op"] == "drop_field":
            o.pop(e["field"], None)
        elif e["op"] == "text":
            m = o.get("message")
            content = m.get("content") if isinstance(m, dict) else None
            if isinstance(content, str):
                m["content"] = e["value"]
            elif isinstance(content, list) and pd.notna(e["bi"]) and int(e["bi"]) < len(content) and isinstance(content[int(e["bi"])], dict):
                b = content[int(e["bi"])]
                b["content" if b.get("type") == "tool_result" else "thinking" if b.get("type") == "thinking" else "text"] = e["value"]
    return json.dumps(o, separators=(",", ":"))


def invalid(recs: DataFrame) -> DataFrame:
    """Records without what their grammar needs: (session_id, pos, problem)."""
    problem = F.when(F.col("type").isNull(), "no type").when(F.col("msg_type").isin("user", "assistant") & F.col("content_shape").isNull(), "no content")
    return recs.select("session_id", "pos", problem.alias("problem")).where("problem IS NOT NULL")


def schema_errors(recs: DataFrame, check: Any) -> DataFrame:
    """(session_id, pos, error) of records for which check(object) gives an error text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["error"] = [check(json.loads(r)) for r in part.pop("raw")]
            yield part[part["error"].notna()]

    return recs.select("session_id", F.col("pos").cast("int").alias("pos"), "raw").mapInPandas(run, "session_id string, pos int, error string")
