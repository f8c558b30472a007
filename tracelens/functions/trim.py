"""The last pass over a record: edits are put in, then each text is cut by its kind, place and profile.

These work on one record's decoded JSON, as its keys' order and number texts must survive; `finished` runs them over a column
in Arrow batches. Facts about blocks that need other records (stale, blind, duplicate, ...) come with the row.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelens.functions import python_text, scalar

# fixed values: fields of a result's copy, in the order they are cut in, with the limit of each
RESULT_FIELDS = (("originalFile", "tur.originalFile"), ("stdout", "tur.stdout"), ("content", "tur.content"), ("oldString", "tur.oldString"), ("newString", "tur.newString"))
# fixed values: fields of a tool's input that are cut, with the limit of each tool
INPUT_FIELDS = {"Write": ("content",), "Edit": ("old_string", "new_string"), "Agent": ("prompt",), "Bash": ("command",)}
# fixed values: fields of an assistant's message and record that are dropped
MESSAGE_FIELDS, COST_FIELDS = ("usage", "stop_reason", "stop_sequence"), ("costUSD", "duration", "apiDuration")
MEGA = 32768


def truncate(text: str, limit: int, label: str) -> str:
    half = limit // 2
    return text if len(text) <= limit else f"{text[:half]}\n[...{label} truncated {len(text)}->{limit}...]\n{text[-half:]}"


def entropy_limit(text: str, limit: int) -> int:
    """Half as much again for dense texts, half for repetitive ones; short ones as they are."""
    ratio = python_text.redundancy(text) if len(text) >= 200 else 0.4
    return int(limit * 1.5) if ratio < 0.3 else int(limit * 0.5) if ratio > 0.5 else limit


def one_line(text: str, n: int) -> str:
    return text[:n].replace("\n", " ").encode("ascii", "ignore").decode()


class Trimmer:
    def __init__(self, aggr: float, profile: str, home: str):
        self.aggr, self.profile, self.home = aggr, profile, home
        self.stats: list[str] = []

    def limit(self, key: str) -> int:
        ends = scalar.LIMITS[self.profile]
        gentle, hard = ends.get(key, ends["default"])
        return int(gentle + self.aggr * (hard - gentle))

    def compress(self, text: str) -> str:
        return python_text.compress(text, self.aggr, self.profile, self.home) if text else text

    def field(self, holder: dict, name: str, limit: int, label: str, compressed: bool = True) -> None:
        if isinstance(holder.get(name), str):
            holder[name] = truncate(self.compress(holder[name]) if compressed else holder[name], limit, label)

    def result_text(self, text: str, name: str, shell: bool) -> str:
        limit = self.limit(name if name in scalar.LIMITS[self.profile] else "mcp" if name.startswith("mcp__") else "default")
        text = self.compress(python_text.dedup_reminders(python_text.clean_shell_output(text) if shell else text))
        return truncate(text, entropy_limit(text, limit), name)

    def texts(self, block: dict, change: Callable[[str], str]) -> int:
        """Changes a result's texts; the number that became others."""
        n = 0
        if isinstance(block.get("content"), str):
            new = change(block["content"])
            n, block["content"] = n + (new != block["content"]), new
        elif isinstance(block.get("content"), list):
            for item in block["content"]:
                if isinstance(item, dict) and item.get("type") == "text" and isinstance(item.get("text"), str):
                    new = change(item["text"])
                    n, item["text"] = n + (new != item["text"]), new
        return n

    def result(self, block: dict, fact: dict) -> None:
        """A tool result: a stub for a stale one, a prefix for a blind edit's, an agent's by place, others by their tool."""
        by_rule = (
            (fact.get("stale") and self.aggr > 0.5, lambda t: t if len(t) <= 200 else "[stale: file was later edited]", "stale_reads_trimmed"),
            (fact.get("blind") and self.aggr > 0.3, lambda t: t if len(t) <= 100 else t[:100] + " [blind edit — file not read first]", "blind_edits_trimmed"),
            (fact.get("agent") and self.aggr > 0.4, lambda t: truncate(t, max(200, int(800 * (1 - self.aggr))), "Agent.result"), "agent_results_compressed"),
        )
        for applies, change, stat in by_rule:
            if applies:
                n = self.texts(block, change)
                self.stats += [stat] * n
                if n or isinstance(block.get("content"), list):
                    return
        self.texts(block, lambda t: self.result_text(t, fact.get("name") or "unknown", bool(fact.get("shell"))))

    def input(self, given: dict, name: str) -> None:
        for k, v in given.items():
            if isinstance(v, str):
                given[k] = self.compress(v)
        for k in INPUT_FIELDS.get(name, ()):
            self.field(given, k, self.limit(f"tool_input.{name}"), f"{name}.{k}" if name != "Bash" else "tool_input.Bash", compressed=False)

    def thinking(self, block: dict) -> bool:
        """Whether it stays: a signature holds for the very text only, so it does if nothing would change it."""
        text, limit = block.get("thinking", ""), self.limit("thinking")
        if not isinstance(text, str):
            return True
        if not limit:
            self.stats.append("thinking_removed")
            return False
        new = self.compress(text)
        if len(new) > limit:
            self.stats.append("thinking_truncated")
        if new != text or len(new) > limit or not new:
            self.stats += ["thinking_signature_stripped"] * (bool(new) or "signature" in block)
            return False
        return True

    def result_copy(self, copy: dict) -> None:
        """The copy of a result that a record carries beside its message."""
        if isinstance(copy.get("stdout"), str):
            copy["stdout"] = python_text.clean_shell_output(copy["stdout"])
        for name, key in RESULT_FIELDS:
            self.field(copy, name, self.limit(key), key)
        most = int(20 + (1 - self.aggr) * 40)
        for patch in copy["structuredPatch"] if isinstance(copy.get("structuredPatch"), list) else ():
            held = patch.get("lines") if isinstance(patch, dict) else None
            if isinstance(held, list) and len(held) > most:
                patch["lines"] = [*held[: most // 2], "[...truncated...]", *held[-(most // 2) :]]
        limit, task = self.limit("tur.content"), copy.get("task")
        self.field(copy, "task", limit, "tur.task")
        if isinstance(task, dict) and len(json.dumps(task)) > limit:
            for k, v in task.items():
                if isinstance(v, str) and len(v) > 200:
                    task[k] = truncate(self.compress(v), max(limit // 4, 200), f"tur.task.{k}")
                elif isinstance(v, list) and len(v) > 3 and len(json.dumps(v)) > limit // 2:
                    task[k] = [*v[:3], {"_truncated": len(v) - 3}]
        for name in ("prompt", "result"):
            self.field(copy, name, limit, f"tur.{name}")
        if isinstance(copy.get("file"), dict):
            self.field(copy["file"], "content", self.limit("tur.file"), "tur.file.content")
        self.field(copy, "file", self.limit("tur.file"), "tur.file")
        if isinstance(copy.get("prompt"), str):
            copy["prompt"] = self.compress(copy["prompt"])
        if isinstance(copy.get("content"), str) and "prompt" in copy:
            self.field(copy, "content", self.limit("Agent"), "tur.agent.content", compressed=False)
            self.field(copy, "prompt", self.limit("tool_input.Agent"), "tur.agent.prompt", compressed=False)

    def aged(self, block: dict) -> None:
        """A result of some age: JSON without blanks, or a diff without far context."""
        text = block.get("content")
        if isinstance(text, str) and len(text) >= 100:
            short = python_text.minify_json(text)
            if short is not None:
                block["content"] = short
                self.stats.append("age_tool_results_minified")
            elif (text.startswith("diff ") or "\n@@" in text[:500]) and len(new := python_text.collapse_diff(text)) < len(text):
                block["content"] = new
                self.stats.append("age_tool_results_diff_collapsed")

    def message(self, o: dict, kind: str, facts: dict[int, dict], gone: set[int]) -> None:
        m = o.get("message") if isinstance(o.get("message"), dict) else {}
        content = m.get("content")
        if kind == "user" and isinstance(content, str):
            text = self.compress(content)
            m["content"] = truncate(text, entropy_limit(text, self.limit("user_text")), "user_prompt")
            self.stats += ["user_prompt_trimmed"] * (m["content"] != text)
        if kind == "system" and isinstance(content, str):
            m["content"] = self.compress(content)
        if kind == "assistant":
            for holder, names in ((m, MESSAGE_FIELDS), (o, COST_FIELDS)):
                for name in names:
                    holder.pop(name, None)
        for k, b in enumerate(content if isinstance(content, list) and kind in ("user", "assistant") else ()):
            if not isinstance(b, dict) or k in gone:
                continue
            what, fact = b.get("type"), facts.get(k, {})
            if what == "thinking" and kind == "assistant" and not self.thinking(b):
                gone.add(k)
                continue
            if what == "text" and isinstance(b.get("text"), str):
                b["text"] = self.compress(b["text"])
                if kind == "user":
                    cut = truncate(b["text"], entropy_limit(b["text"], self.limit("user_text")), "user_text")
                    self.stats += ["user_prompt_trimmed"] * (cut != b["text"])
                    b["text"] = cut
            elif what == "tool_result" and kind == "user":
                self.result(b, fact)
            elif what == "tool_use" and kind == "assistant" and isinstance(b.get("input"), dict):
                self.input(b["input"], str(b.get("name") or ""))
            if fact.get("twice"):
                self.stats.append("duplicate_blocks_deduped")
                before = b.get("content") if what == "tool_result" else b.get("text")
                if what == "text" and isinstance(before, str):
                    b["text"] = f"[duplicate content{', first seen earlier' if kind == 'user' else ''}: {one_line(before, 60)}...]"
                elif what == "tool_result" and kind == "user" and isinstance(before, str):
                    b["content"] = f"[duplicate content: {one_line(before, 60)}...]"
            for name in ("text",) if what == "text" else ("content",) if what == "tool_result" else ():
                if isinstance(b.get(name), str):
                    b[name] = python_text.dedup_reminders(b[name])

    def mega(self, o: dict) -> None:
        m = o.get("message") if isinstance(o.get("message"), dict) else {}
        for b in m["content"] if isinstance(m.get("content"), list) else ():
            name = {"text": "text", "tool_result": "content"}.get(b.get("type")) if isinstance(b, dict) else None
            if name and isinstance(b.get(name), str) and len(b[name].encode()) > MEGA:
                b[name] = truncate(b[name], MEGA, "mega-block")
                self.stats.append("mega_blocks_trimmed")


def put(o: dict, edits: Any, gone: set[int]) -> None:
    """Edits (bi, op, field, value) into a record; blocks to drop go to `gone`, so that places stay what they are."""
    m = o.get("message") if isinstance(o.get("message"), dict) else {}
    for e in edits:
        content, k = m.get("content"), None if pd.isna(e["bi"]) else int(e["bi"])
        b = content[k] if isinstance(content, list) and k is not None and k < len(content) and isinstance(content[k], dict) else None
        if e["op"] == "drop_field":
            o.pop(e["field"], None)
        elif e["op"] == "drop_block":
            gone.add(k)
        elif e["op"] == "text" and isinstance(content, str):
            m["content"] = e["value"]
        elif e["op"] == "text" and b is not None:
            b["content" if b.get("type") == "tool_result" else "thinking" if b.get("type") == "thinking" else "text"] = e["value"]
        elif e["op"] == "input" and b is not None and isinstance(b.get("input"), dict):
            for name, value in json.loads(e["value"]).items():
                if value is None:
                    b["input"].pop(name, None)
                else:
                    b["input"][name] = value


def finish(raw: str, kind: str, aggr: float, soft: bool, edits: Any, facts: Any, names: tuple[str, ...], profile: str, home: str) -> tuple[str, list[str]]:
    """(the record's new line, names of what was done to it)"""
    o, t, gone = json.loads(raw), Trimmer(aggr, profile, home), set()
    put(o, edits, gone)
    by_place = {int(f["bi"]): f for f in facts}
    content = o["message"].get("content") if isinstance(o.get("message"), dict) else None
    for k, f in by_place.items():
        if f.get("mid") and isinstance(content, list) and k < len(content) and isinstance(content[k], dict):
            t.aged(content[k])
    t.message(o, kind, by_place, gone)
    if isinstance(o.get("toolUseResult"), dict):
        t.result_copy(o["toolUseResult"])
    for name in names:
        if o.pop(name, None) is not None:
            t.stats.append("metadata_fields_stripped")
    if gone and isinstance(content, list):
        o["message"]["content"] = [b for k, b in enumerate(content) if k not in gone]
    if not soft:
        t.mega(o)
    return json.dumps(o, separators=(",", ":")), t.stats


DONE = T.StructType([T.StructField("raw", T.StringType()), T.StructField("done", T.ArrayType(T.StringType()))])


def finished(names: tuple[str, ...], profile: str, home: str):
    @F.pandas_udf(DONE)
    def run(raw: pd.Series, kind: pd.Series, aggr: pd.Series, soft: pd.Series, edits: pd.Series, facts: pd.Series) -> pd.DataFrame:
        listed = lambda x: () if x is None else x
        rows = [finish(r, k, a, bool(s), listed(e), listed(f), names, profile, home) for r, k, a, s, e, f in zip(raw, kind, aggr, soft, edits, facts, strict=True)]
        return pd.DataFrame(rows, columns=DONE.names)

    return run
