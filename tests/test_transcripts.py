"""The transcript grammars, detectors and the reduction on literal sessions."""

import json

import pytest
from pyspark.sql import functions as F

from tracelens.operators import detect, doctor, relink
from tracelens.plans import reduction
from tracelens.sources import transcripts as ts

ID = "0a1b2c3d-0000-4000-8000-000000000001"


def user(uuid, parent, content, **more):
    return {"type": "user", "uuid": uuid, "parentUuid": parent, "timestamp": "2025-01-01T00:00:00Z", "message": {"role": "user", "content": content}} | more


def call(uuid, parent, ident, name, given):
    return {"type": "assistant", "uuid": uuid, "parentUuid": parent, "message": {"role": "assistant", "content": [{"type": "tool_use", "id": ident, "name": name, "input": given}], "usage": {"input_tokens": 5, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 1}}}


def result(uuid, parent, ident, content, **more):
    return user(uuid, parent, [{"type": "tool_result", "tool_use_id": ident, "content": content} | more])


SESSION = [
    {"type": "system", "uuid": "s", "message": {"content": "be good"}, "sessionId": "x"},
    user("u1", "s", "please fix it", gitBranch="main"),
    call("a1", "u1", "t1", "Read", {"file_path": "/a.py"}),
    result("r1", "a1", "t1", "line\n" * 50),
    {"type": "progress", "uuid": "p1", "parentUuid": "r1", "data": {}},
    call("a2", "p1", "t2", "Edit", {"file_path": "/a.py", "old_string": "x", "new_string": "y"}),
    result("r2", "a2", "t2", [{"type": "text", "text": "done"}]),
    call("a3", "r2", "t3", "Bash", {"command": "cat /b.py | grep x && pytest -q"}),
    result("r3", "a3", "t3", "3 passed in 1s"),
    call("a4", "r3", "t4", "Write", {"file_path": "/c.py", "content": "z"}),
    {"type": "system", "uuid": "s2", "parentUuid": "a4", "message": {"content": "be good"}},
]


@pytest.fixture(scope="module")
def recs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sessions")
    lines = [json.dumps(o) for o in SESSION]
    (folder / f"{ID}.jsonl").write_text("\n".join([*lines[:3], "", "{broken", '"text"', *lines[3:]]) + "\n")
    (folder / f"{ID}.jsonl.bak").write_text(lines[0])
    good, bad = ts.scan(spark, str(folder))
    assert bad.count() == 2
    return ts.records(good).cache()


def test_scan_keeps_order_and_counts_lines(recs):
    rows = recs.orderBy("pos").collect()
    assert [r.uuid for r in rows] == [o["uuid"] for o in SESSION]
    assert rows[3].line_no == 6 and rows[3].pos == 3
    assert {r.codec for r in rows} == {"plain"} and {r.session_id for r in rows} == {ID}


def test_verbs(recs):
    got = [(r.kind, r.path, r.passed) for r in ts.verb_events(ts.blocks(recs)).where("tool_use_id IS NOT NULL").orderBy("pos", "seq").collect()]
    assert got == [("read", "/a.py", False), ("edit", "/a.py", False), ("read", "/b.py", False), ("build", None, True), ("write", "/c.py", False)]


def test_detectors_on_verbs(recs):
    ev = ts.verb_events(ts.blocks(recs))
    assert [r.event_id for r in detect.stale_reads(ev).collect()] == ["a1"]
    assert [r.event_id for r in detect.blind_edits(ev).collect()] == ["a4"]
    assert [r.event_id for r in detect.passing_builds(ev).collect()] == ["a3"]


def test_catalogue(recs):
    r = ts.catalogue(recs).collect()[0]
    assert (r.records, r.branch, r.title, r.tokens) == (11, "main", "please fix it", 8)


def test_reduction(recs):
    out = reduction.reduce_transcripts(recs, "standard")
    kept = {r.uuid: r for r in out.kept.collect()}
    assert "p1" not in kept and "s2" not in kept and kept["a2"].parent_uuid == "r1"
    stats = {r.name: r.value for r in out.stats.collect()}
    assert stats["progress"] == 1 and stats["dup_system"] == 1 and stats["reparented"] == 1 and stats["metadata_fields_stripped"] == 1
    assert "sessionId" not in json.loads(kept["s"].raw)
    # in the middle of the session a long read becomes one line, before its staleness counts; near its end a passing build stays
    assert json.loads(kept["r1"].raw)["message"]["content"][0]["content"] == "[Read: 51 lines]"
    assert json.loads(kept["r3"].raw)["message"]["content"][0]["content"] == "3 passed in 1s"
    assert out.before.agg(F.sum("chars")).head()[0] > out.after.agg(F.sum("chars")).head()[0]


def test_rollout_grammar(spark):
    rows = [
        {"type": "session_meta", "id": "m", "payload": {"cwd": "/x"}},
        {"type": "response_item", "id": "c1", "payload": {"type": "function_call", "call_id": "k", "name": "exec_command", "arguments": json.dumps({"cmd": "sed -i s/a/b/ f.txt"})}},
        {"type": "response_item", "id": "c2", "payload": {"type": "function_call_output", "call_id": "k", "output": "ok"}},
        {"type": "EventMsg", "id": "c3", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 9, "cached_input_tokens": 4}, "last_token_usage": {"input_tokens": 3}}}},
    ]
    df = spark.createDataFrame([("s", "f", i, i, json.dumps(o)) for i, o in enumerate(rows)], "session_id string, file string, line_no int, pos int, raw string").withColumn("v", F.try_parse_json("raw"))
    recs = ts.records(df)
    got = {r.uuid: r for r in recs.collect()}
    assert got["m"].codec == "rollout" and got["m"].msg_type == "system"
    assert got["c1"].blocks[0].tool_name == "Bash" and got["c2"].blocks[0].text == "ok"
    assert (got["c3"].usage.input, got["c3"].usage.cache_read) == (9, 4)
    ev = ts.verb_events(ts.blocks(recs)).where("kind = 'edit'").collect()
    assert [e.path for e in ev] == ["f.txt"]


def test_relink_long_run_and_cycle(spark):
    dropped = spark.createDataFrame([(i, i - 1) for i in range(1, 30)] + [(1000, 1001), (1001, 1000)], "node long, up long").coalesce(1)
    kept = spark.createDataFrame([(30, 29), (1002, 1000), (5000, None)], "event_id long, parent long")
    got = {r.event_id: r.new_parent for r in relink.relink(kept, dropped, rounds=6).collect()}
    assert got == {30: 0, 1002: 1000, 5000: None}
    assert {r.node for r in relink.on_cycles(dropped).collect()} == {1000, 1001}
    cut = {r.node: r.up for r in relink.sever_cycles(dropped).collect()}
    assert cut[1000] is None and cut[1001] == 1000 and cut[5] == 4


def test_doctor(recs):
    found = doctor.diagnose(recs, doctor.record_checks())
    names = {r.name: r.hits for r in found.collect()}
    assert names["mixed_content_format"] == 1 and names["unreduced_metadata"] == 1
    assert doctor.worst(found).collect()[0].exit_code == 2


def test_edits_keep_keys_in_order():
    raw = '{"b":1,"a":{"x":1.0},"sessionId":"s","message":{"content":"héllo"}}'
    out = ts._edited(raw, [{"op": "drop_field", "field": "sessionId", "bi": None, "value": None}, {"op": "text", "field": None, "bi": 0, "value": "é"}])
    assert out == '{"b":1,"a":{"x":1.0},"message":{"content":"\\u00e9"}}'


def golden():
    """Two systems (one a boundary), its summary, pairs with calls and a repeated text, noise, snapshots, protected records."""
    out = [{"type": "system", "uuid": "s0", "message": {"content": "rules"}}, user("old", "s0", "long ago")]
    out.append({"type": "system", "uuid": "b0", "parentUuid": "old", "subtype": "compact_boundary", "message": {"content": "compacted"}})
    out.append(user("sum", "b0", "This session is being continued from a previous conversation", isCompactSummary=True))
    out.append({"type": "worktree-state", "uuid": "w0", "parentUuid": "sum", "message": {"role": "user", "content": "keep me"}})
    last, text = "w0", "the same long text again and again, word after word. " * 40
    for k in range(12):
        out.append(user(f"q{k}", last, "yes" if k == 5 else f"please do step {k}: " + text))
        out.append(call(f"c{k}", f"q{k}", f"t{k}", "Bash", {"command": f"pytest -q test_{k}.py"}))
        out.append({"type": "progress", "uuid": f"p{k}", "parentUuid": f"c{k}", "data": {}})
        out.append(result(f"r{k}", f"p{k}", f"t{k}", f"{k + 1} passed in 1s\n" + f"line {k} of output\n" * 60) | {"toolUseResult": {"stdout": f"x{k}\n" * 3000}})
        last = f"r{k}"
    for k in range(3):
        out.append(call(f"e{k}", last, f"edit{k}", "Edit", {"file_path": "/a.py", "old_string": f"old {k} " * 40, "new_string": f"new {k} " * 40}))
        out.append(result(f"er{k}", f"e{k}", f"edit{k}", "ok"))
        last = f"er{k}"
    out += [{"type": "file-history-snapshot", "uuid": f"f{k}", "messageId": "m", "parentUuid": last} for k in range(2)]
    out.append({"type": "attribution-snapshot", "uuid": "at", "parentUuid": last})
    out.append(result("lone", last, "nobody", "an orphan"))
    out.append(user("big", "lone", [{"type": "text", "text": "z y x w v. " * 4000}]))
    for k in range(6):
        out.append(user(f"z{k}", "big" if not k else f"z{k - 1}", f"and then {k}", cwd="/x", version="1"))
    return out


def as_records(spark, objects):
    rows = [(s, "f", i, i, json.dumps(o)) for s in ("one", "two") for i, o in enumerate(objects)]
    return ts.records(spark.createDataFrame(rows, "session_id string, file string, line_no int, pos int, raw string").withColumn("v", F.try_parse_json("raw")))


def test_reduction_keeps_its_invariants(spark):
    recs = as_records(spark, golden()).cache()
    out = reduction.reduce_transcripts(recs)
    rows = out.kept.where("session_id = 'one'").orderBy("pos").collect()
    kept = {r.uuid: json.loads(r.raw) for r in rows}
    stats = {r.name: r.value for r in out.stats.where("session_id = 'one'").collect()}
    # protected records stay, nothing is there twice, order stays
    assert {"w0", "b0", "sum"} <= set(kept) and len(kept) == len(rows) and [r.pos for r in rows] == sorted(r.pos for r in rows)
    # noise, what the boundary replaced, all but the last snapshot, and orphans have gone
    assert not {"old", "s0", "f0", "at", "lone", *[f"p{k}" for k in range(12)]} & set(kept) and "f1" in kept
    # each parent is there, or was never a record that this session dropped on a chain with an end
    assert all(o.get("parentUuid") in kept or o["uuid"] == "b0" for o in kept.values())
    blocks = [b for o in kept.values() for b in (o.get("message") or {}).get("content") or [] if isinstance(b, dict)]
    assert {b["tool_use_id"] for b in blocks if b["type"] == "tool_result"} <= {b["id"] for b in blocks if b["type"] == "tool_use"}
    assert sum(len(r.raw) for r in rows) < 0.6 * sum(len(json.dumps(o)) for o in golden())
    assert stats["progress"] == 12 and stats["orphaned_tool_results"] == 1 and stats["attribution_snapshots_stripped"] == 1 and stats["compact_collapse_drops"] >= 1
    assert stats["confirmations_removed"] >= 1 and stats["passing_builds_collapsed"] >= 1 and kept["q5"]["message"]["content"].startswith("[confirm")
    assert not any("usage" in o.get("message", {}) for o in kept.values()) and not any("cwd" in kept[f"z{k}"] for k in range(6))
    # both sessions share uuids, and neither gets the other's records
    assert out.kept.where("session_id = 'two'").count() == len(rows)
    again = spark.createDataFrame([(r.session_id, "f", k, k, r.raw) for k, r in enumerate(rows)], "session_id string, file string, line_no int, pos int, raw string").withColumn("v", F.try_parse_json("raw"))
    second = reduction.reduce_transcripts(ts.records(again)).kept.agg(F.sum(F.length("raw"))).head()[0]
    assert abs(second - sum(len(r.raw) for r in rows)) <= 0.05 * sum(len(r.raw) for r in rows)
