"""Queries over the driver's tables by name, each with SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.functions import scalar, text
from tracelens.operators import aggregate as agg
from tracelens.operators import detect, doctor, joins, reduce, relink, routing
from tracelens.plans import adapters as t

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers a function by its name; views: common table expressions that the SQL starts with."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = ("WITH " + ", ".join(views) + "\n" if views else "") + sql.strip()
        return f

    return add


CURVE = """(CASE WHEN p < 0.1e0 THEN 0.2e0 WHEN p < 0.1e0 + 0.65e0 / 3 THEN 0.2e0 + 0.8e0 * (p - 0.1e0) / (0.65e0 / 3) WHEN p < 0.75e0 - 0.65e0 / 3 THEN 1e0
  WHEN p < 0.75e0 THEN 1e0 - 0.8e0 * (p - (0.75e0 - 0.65e0 / 3)) / (0.65e0 / 3) ELSE 0.2e0 END)"""


def placed(view: str, name: str = "placed") -> str:
    return f"{name} AS (SELECT *, {CURVE} AS aggr FROM (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY session_id) - 1, 1) AS p FROM {view}))"


FIRST_EDIT = "fe AS (SELECT session_id, path, min(pos) AS f, max(pos) AS l FROM ev WHERE kind IN ('edit', 'write') AND path <> '' GROUP BY ALL)"


# ---- windows and limits -------------------------------------------------------------------------------------------------
@query("SELECT session_id, pos, round(aggr * 1e6)::BIGINT AS aggr_micro FROM placed", t.EV, placed("ev"))
def w01_ucurve(spark, d):
    return reduce.with_aggressiveness(t.ev(spark, d)).select("session_id", "pos", F.round(F.col("aggr") * 1e6).cast("long").alias("aggr_micro"))


@query("SELECT session_id, event_id, (count(*) FILTER (WHERE kind = 'read') OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))::BIGINT AS turns_ago FROM ev", t.EV)
def w04_turns_ago(spark, d):
    return reduce.turns_ago(t.ev(spark, d), F.col("kind") == "read").select("session_id", "event_id", "turns_ago")


@query(
    """SELECT session_id, i, j FROM (
  SELECT session_id, pos AS i, role, fine, lead(role) OVER w AS nr, lead(pos) OVER w AS j, lead(fine) OVER w AS nf FROM (
    SELECT *, CASE kind WHEN 'read' THEN 'user' WHEN 'edit' THEN 'assistant' END AS role, sum(CASE WHEN is_error THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos) AS fine FROM ev)
  WHERE role IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY pos)) WHERE role = nr AND j > i + 1 AND fine = nf""",
    t.EV,
)
def w07_same_role_gap(spark, d):
    e = t.ev(spark, d)
    role = F.when(F.col("kind") == "read", "user").when(F.col("kind") == "edit", "assistant")
    return agg.same_role_gaps(e, role, ~F.col("is_error"))


@query("SELECT doc_id, CASE WHEN c <= 0.25 THEN 'cold' WHEN c <= 0.75 THEN 'warm' ELSE 'hot' END AS colour FROM (SELECT doc_id, cume_dist() OVER (ORDER BY n_chars) AS c FROM documents)")
def w08_percentile(spark, d):
    return agg.percentile_colour(t.table(spark, d, "documents"), "n_chars").select("doc_id", "colour")


@query("SELECT session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS rn FROM ev) WHERE rn <= 20", t.EV)
def w09_last_rows(spark, d):
    return agg.last_rows(t.ev(spark, d), 20).select("session_id", "event_id")


# ---- aggregates ---------------------------------------------------------------------------------------------------------
@query("SELECT session_id, role AS category, sum(floor(length(text) / 3.7e0)::BIGINT)::BIGINT AS tokens FROM conv GROUP BY ALL", t.CONV)
def a01_token_budget(spark, d):
    return agg.token_budget(t.conv(spark, d), F.col("role"), F.length("text"))


@query("SELECT round(sum(length(text)) / greatest(sum(floor(length(text) / 3.7e0)), 1), 4) AS chars_per_token FROM conv", t.CONV)
def a02_calibration(spark, d):
    return t.conv(spark, d).agg(F.round(F.sum(F.length("text")) / F.greatest(F.sum(scalar.item_tokens(F.length("text"))), F.lit(1)), 4).alias("chars_per_token"))


@query("SELECT session_id, max_by(octet, pos)::BIGINT AS total FROM (SELECT *, length(text) AS octet FROM conv) WHERE role = 'assistant' AND octet > 0 GROUP BY 1", t.CONV)
def a03_last_usage(spark, d):
    return agg.last_usage(t.conv(spark, d), F.length("text").cast("long"), F.col("role") == "assistant")


@query(
    """SELECT g.session_id, g.bucket, coalesce(s.chars, 0)::BIGINT AS chars FROM (SELECT DISTINCT session_id, b.bucket FROM conv, (SELECT unnest(range(40)) AS bucket) b) g LEFT JOIN (
  SELECT session_id, bucket, sum(chars) AS chars FROM (
    SELECT session_id, least(((row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1) * 40) // count(*) OVER (PARTITION BY session_id), 39) AS bucket, length(text) AS chars FROM conv) GROUP BY ALL) s
  ON g.session_id = s.session_id AND g.bucket = s.bucket""",
    t.CONV,
)
def a04_density(spark, d):
    return agg.density(t.conv(spark, d), F.length("text"))


@query("SELECT session_id, bin, sum(hit)::BIGINT AS hits, count(*) AS total FROM (SELECT session_id, floor((row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1) * 70 / count(*) OVER (PARTITION BY session_id))::BIGINT AS bin, is_error::INT AS hit FROM ev) GROUP BY ALL", t.EV)
def a05_sparkline(spark, d):
    return agg.bins(t.ev(spark, d), F.col("is_error"))


@query("SELECT session_id, event_type, count(*) AS n FROM ev GROUP BY ALL", t.EV)
def a07_type_counts(spark, d):
    return agg.counts(t.ev(spark, d), "session_id", "event_type")


@query("SELECT session_id, greatest(floor(sum(length(text)) / 4), 1)::BIGINT AS tokens FROM blk GROUP BY 1", t.BLOCKS)
def a08_content_tokens(spark, d):
    return agg.estimated_tokens(t.blocks(spark, d), F.length("text"))


@query(
    """SELECT session_id, section, count(*) AS n, sum(tokens)::BIGINT AS tokens, count(*) FILTER (WHERE route = 'KEEP') AS kept, coalesce(max_by(snippet, CASE WHEN route = 'KEEP' THEN pos END), max_by(snippet, pos)) AS snippet FROM
  (SELECT session_id, floor((row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1) / 50)::BIGINT AS section, pos, length(text) // 4 AS tokens, CASE WHEN lang = 'en' THEN 'KEEP' ELSE 'HEURISTIC' END AS route, left(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n', ' ', 'g'), 60) AS snippet FROM blk) GROUP BY ALL""",
    t.BLOCKS,
)
def a09_sections(spark, d):
    b = t.blocks(spark, d)
    return agg.sections(b, 50, F.floor(F.length("text") / 4), F.when(F.col("lang") == "en", "KEEP").otherwise("HEURISTIC"), text.one_line(F.col("text"), 60))


@query(
    """SELECT session_id, level2, level1, level0, count(*) AS n FROM (SELECT session_id, floor(r / s)::BIGINT AS level0, floor(r / (s * 100))::BIGINT AS level1, floor(r / (s * 10000))::BIGINT AS level2 FROM
  (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS r, greatest(50, floor(count(*) OVER (PARTITION BY session_id) / 100)) AS s FROM ev)) GROUP BY ROLLUP (session_id, level2, level1, level0)""",
    t.EV,
)
def a10_section_tree(spark, d):
    return agg.section_tree(t.ev(spark, d))


@query("SELECT event_type, user_id, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY ROLLUP (event_type, user_id)")
def a11_catalogue_rollup(spark, d):
    return agg.catalogue(t.table(spark, d, "events"), "event_type", "user_id", "ts")


@query("SELECT session_id, path, max(ts) AS last_ts FROM ev GROUP BY ALL", t.EV)
def a12_recency(spark, d):
    return t.ev(spark, d).groupBy("session_id", "path").agg(F.max("ts").alias("last_ts"))


@query("SELECT session_id, round(count(*) FILTER (WHERE kind <> 'read') / count(*), 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS r, count(*) OVER (PARTITION BY session_id) AS c FROM ev) WHERE r >= floor(c * 0.1e0) AND r <= floor(c * 0.75e0) GROUP BY 1", t.EV)
def a13_untagged(spark, d):
    return agg.untagged_share(t.ev(spark, d), F.col("kind") == "read").select("session_id", F.round("share", 6).alias("share"))


@query("SELECT route, count(*) AS n FROM (SELECT CASE WHEN role = 'user' THEN 'KEEP' WHEN length(text) > 200 THEN 'DISTILL' ELSE 'HEURISTIC' END AS route FROM conv) GROUP BY 1", t.CONV)
def a14_route_counts(spark, d):
    return agg.counts(t.conv(spark, d).withColumn("route", F.when(F.col("role") == "user", "KEEP").when(F.length("text") > 200, "DISTILL").otherwise("HEURISTIC")), "route")


# ---- filters and passes -------------------------------------------------------------------------------------------------
@query("SELECT session_id, reason, count(*) AS n FROM (SELECT session_id, CASE event_type WHEN 'signup' THEN 'progress' WHEN 'error' THEN 'last-prompt' END AS reason FROM ev) WHERE reason IS NOT NULL GROUP BY ALL", t.EV)
def f02_noise_drop(spark, d):
    e = t.ev(spark, d).withColumn("type", F.when(F.col("event_type") == "signup", "progress").when(F.col("event_type") == "error", "last-prompt").otherwise("user"))
    return agg.counts(e.withColumn("reason", reduce.drop_reason(F.col("type"), F.lit(""))).where("reason IS NOT NULL"), "session_id", "reason")


@query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?i)the')")
def f05_text_match(spark, d):
    return t.table(spark, d, "conversations").where(F.col("text").rlike("(?i)the")).select("conv_id", "turn")


@query("SELECT session_id, count(*) AS kept, sum(dropped)::BIGINT AS dropped FROM (SELECT e.session_id, 0 AS dropped FROM ev e LEFT JOIN b ON e.session_id = b.session_id WHERE b.m IS NULL OR e.pos >= b.m OR e.kind = 'edit') GROUP BY 1", t.EV, "b AS (SELECT session_id, max(pos) AS m FROM ev WHERE kind = 'write' GROUP BY 1)")
def r01_boundary_collapse(spark, d):
    kept = reduce.boundary_collapse(t.ev(spark, d), F.col("kind") == "write", F.col("kind") == "edit")
    return kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("kept"), F.lit(0).cast("long").alias("dropped"))


@query("SELECT e.session_id, e.event_id FROM ev e LEFT JOIN b USING (session_id) WHERE b.m IS NULL OR e.pos >= b.m OR e.kind = 'edit' OR (e.is_error AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.session_id = e.session_id AND x.pos >= b.m AND x.event_type = e.event_type))", t.EV, "b AS (SELECT session_id, max(pos) AS m FROM ev WHERE kind = 'write' GROUP BY 1)")
def r01_boundary_singletons(spark, d):
    return reduce.boundary_collapse(t.ev(spark, d), F.col("kind") == "write", F.col("kind") == "edit", F.col("is_error")).select("session_id", "event_id")


@query("SELECT session_id, pos FROM dup WHERE role <> 'system' UNION ALL SELECT session_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY session_id, text ORDER BY pos) AS rn FROM dup WHERE role = 'system') WHERE rn = 1", t.CONV, "dup AS (SELECT session_id, pos, role, text FROM conv UNION ALL SELECT session_id, pos + 1000, role, text FROM conv)")
def r02_system_dedup(spark, d):
    c = t.conv(spark, d)
    return reduce.system_dedup(c.unionByName(c.withColumn("pos", F.col("pos") + 1000))).select("session_id", "pos")


@query("SELECT session_id, path, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, path ORDER BY pos DESC) AS rn FROM ev) WHERE rn = 1", t.EV)
def r04_keep_last(spark, d):
    return reduce.keep_last(t.ev(spark, d), ["path"]).select("session_id", "path", "event_id")


@query("SELECT event_id, '[Read: ' || path || ' - ' || floor(value)::BIGINT || ' lines, superseded by later read]' AS stub FROM (SELECT *, max(pos) OVER (PARTITION BY session_id, path) AS m FROM ev WHERE kind = 'read') WHERE pos < m", t.EV)
def r07_read_dedup(spark, d):
    return reduce.read_stubs(t.ev(spark, d), F.floor("value")).select("event_id", "stub")


@query("SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY session_id, path) AS n, max(pos) OVER (PARTITION BY session_id, path) AS m FROM placed WHERE kind = 'edit' AND aggr > 0.3e0) WHERE n >= 2 AND pos < m", t.EV, placed("ev"))
def r11_edit_sequences(spark, d):
    return reduce.edit_sequences(t.ev(spark, d), least=2).select("event_id")


@query("SELECT event_id, turns_ago, CASE WHEN turns_ago >= 30 THEN 'old' WHEN turns_ago >= 11 THEN 'mid' ELSE 'new' END AS age_class FROM (SELECT event_id, (count(*) FILTER (WHERE kind = 'read') OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))::BIGINT AS turns_ago FROM ev)", t.EV)
def r13_age_classes(spark, d):
    rows = reduce.turns_ago(t.ev(spark, d), F.col("kind") == "read")
    return rows.select("event_id", "turns_ago", reduce.age_class(F.col("turns_ago"), F.lit(0.5)).alias("age_class"))


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM ev WHERE kind = 'edit') WHERE rn > greatest(1, round(n * 0.2e0))", t.EV)
def r14_newest_fraction(spark, d):
    return reduce.old_images(t.ev(spark, d).where("kind = 'edit'")).select("event_id")


@query("SELECT doc_id, (strlen(text) - strlen('[duplicate content removed - first seen earlier: ' || left(text, 80) || '...]'))::BIGINT AS bytes_saved FROM (SELECT *, min(pos) OVER (PARTITION BY session_id, text) AS f FROM blk WHERE strlen(text) >= 1024) WHERE pos > f", t.BLOCKS)
def r15_document_dedup(spark, d):
    return reduce.document_dedup(t.blocks(spark, d)).select("doc_id", "bytes_saved")


@query("SELECT doc_id, md5(CASE WHEN lang = 'en' THEN '[Read: ' || (length(text) - length(replace(text, chr(10), '')) + 1) || ' lines]' ELSE '[' || lang || ': ' || left(text, 80) || '...]' END) AS digest FROM placed WHERE aggr > 0.8e0 AND length(text) > 200", t.BLOCKS, placed("blk"))
def r16_nuclear(spark, d):
    b = t.blocks(spark, d).withColumn("kind", F.when(F.col("lang") == "en", "read").otherwise("other")).withColumn("tool_name", F.col("lang"))
    return reduce.nuclear(b).select("doc_id", F.md5(F.col("new_text").cast("binary")).alias("digest"))


@query("SELECT doc_id, strlen(text)::BIGINT AS n_bytes, length(CASE WHEN length(text) <= 32768 THEN text ELSE left(text, 16384) || chr(10) || '[...mega-block truncated ' || length(text) || '->32768...]' || chr(10) || right(text, 16384) END)::BIGINT AS new_len FROM documents WHERE strlen(text) > 32768")
def r26_mega_blocks(spark, d):
    return reduce.mega_blocks(t.blocks(spark, d)).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.length("new_text").cast("long").alias("new_len"))


@query("SELECT name, sum(value)::BIGINT AS value FROM (SELECT 'errors' AS name, count(*) AS value FROM events WHERE event_type = 'error' UNION ALL SELECT 'views', count(*) FROM events WHERE event_type = 'view' UNION ALL SELECT 'views', count(*) FROM events WHERE event_type = 'click') GROUP BY 1")
def r28_stats_merge(spark, d):
    e = t.table(spark, d, "events")
    part = lambda kind, name: e.where(F.col("event_type") == kind).agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("name"), "value")
    return part("error", "errors").unionByName(part("view", "views")).unionByName(part("click", "views")).groupBy("name").agg(F.sum("value").alias("value"))


# ---- detectors ----------------------------------------------------------------------------------------------------------
@query("SELECT event_id FROM ev JOIN fe USING (session_id, path) WHERE kind = 'read' AND fe.f > pos", t.EV, FIRST_EDIT)
def d01_stale_reads(spark, d):
    return detect.stale_reads(t.ev(spark, d)).select("event_id")


@query("SELECT event_id FROM ev e WHERE kind IN ('edit', 'write') AND path <> '' AND NOT EXISTS (SELECT 1 FROM ev r WHERE r.session_id = e.session_id AND r.path = e.path AND r.kind = 'read' AND r.pos < e.pos)", t.EV)
def d02_blind_edits(spark, d):
    return detect.blind_edits(t.ev(spark, d)).select("event_id")


@query("SELECT event_id FROM ev JOIN fe USING (session_id, path) WHERE kind IN ('edit', 'write') AND fe.l > pos", t.EV, FIRST_EDIT)
def d03_superseded_edits(spark, d):
    return detect.superseded_edits(t.ev(spark, d)).select("event_id")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value > 50")
def d04_passing_builds(spark, d):
    e = t.ev(spark, d).withColumn("kind", F.when(F.col("event_type") == "click", "build").otherwise(F.col("kind"))).withColumn("passed", F.col("value") > 50)
    return detect.passing_builds(e).select("event_id")


@query("SELECT event_id FROM (SELECT *, max(pos) OVER (PARTITION BY session_id, path) AS m FROM ev WHERE kind = 'run') WHERE is_error AND m > pos", t.EV)
def d05_error_retries(spark, d):
    return detect.error_retries(t.ev(spark, d)).select("event_id")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM conversations) WHERE length(s) < 120 AND regexp_matches(regexp_replace(lower(s), '[.,!?;:]+$', ''), '^(th|an|the|on)')")
def d06_confirmations(spark, d):
    return t.table(spark, d, "conversations").where(text.is_confirmation(F.col("text"), ("th", "an", "the", "on"), below=120)).select("conv_id", "turn")


@query("SELECT event_id FROM ev LEFT JOIN fe USING (session_id, path) WHERE kind = 'read' AND (fe.f IS NULL OR fe.f <= pos)", t.EV, FIRST_EDIT)
def d07_unmodified_reads(spark, d):
    return detect.unmodified_reads(t.ev(spark, d)).select("event_id")


@query("SELECT event_id FROM (SELECT *, max(pos) OVER (PARTITION BY session_id, path) AS m FROM ev WHERE kind = 'read') WHERE m > pos", t.EV)
def d08_superseded_reads(spark, d):
    return detect.superseded_reads(t.ev(spark, d)).select("event_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY session_id, lang, left(text, 300) ORDER BY pos) AS rn FROM blk) WHERE rn > 1", t.BLOCKS)
def d09_duplicate_refs(spark, d):
    return detect.duplicate_references(t.blocks(spark, d), tool="lang").select("doc_id")


@query("SELECT session_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, text ORDER BY pos, bi) AS rn FROM blk WHERE length(text) >= 64) WHERE rn > 1", t.BLOCKS)
def d10_duplicate_blocks(spark, d):
    return detect.duplicate_blocks(t.blocks(spark, d)).select("session_id", "doc_id")


@query("SELECT session_id, field, count(*) AS n FROM (SELECT source AS session_id, 'lang' AS field, lang AS value FROM documents UNION ALL SELECT source, 'source', source FROM documents) WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 2 AND min(value) = max(value)")
def d11_constant_fields(spark, d):
    docs = t.table(spark, d, "documents").withColumn("session_id", F.col("source"))
    return detect.constant_fields(docs, ["lang", "source"])


@query(
    """SELECT finding, count(*) AS n FROM (
  SELECT 'stale_read' AS finding FROM ev JOIN fe USING (session_id, path) WHERE kind = 'read' AND f > pos UNION ALL
  SELECT 'unmodified_read' FROM ev LEFT JOIN fe USING (session_id, path) WHERE kind = 'read' AND (f IS NULL OR f <= pos) UNION ALL
  SELECT 'superseded_edit' FROM ev JOIN fe USING (session_id, path) WHERE kind IN ('edit', 'write') AND l > pos UNION ALL
  SELECT 'blind_edit' FROM ev LEFT JOIN (SELECT session_id, path, min(pos) AS r FROM ev WHERE kind = 'read' GROUP BY ALL) USING (session_id, path) WHERE kind IN ('edit', 'write') AND path <> '' AND (r IS NULL OR r >= pos) UNION ALL
  SELECT 'superseded_read' FROM (SELECT *, max(pos) OVER (PARTITION BY session_id, path) AS m FROM ev WHERE kind = 'read') WHERE m > pos UNION ALL
  SELECT 'error_retry' FROM (SELECT *, max(pos) OVER (PARTITION BY session_id, path) AS m FROM ev WHERE kind = 'run') WHERE is_error AND m > pos) GROUP BY 1""",
    t.EV,
    FIRST_EDIT,
)
def d12_findings(spark, d):
    return agg.counts(detect.findings(t.ev(spark, d)), "finding")


# ---- graphs and joins ---------------------------------------------------------------------------------------------------
WALK = """RECURSIVE ev AS (SELECT user_id AS session_id, event_id, row_number() OVER w - 1 AS pos, lag(event_id) OVER w AS parent, event_type = 'error' AS is_error FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
walk AS (SELECT event_id, parent, parent AS anc FROM ev WHERE NOT is_error UNION ALL SELECT w.event_id, w.parent, e.parent FROM walk w JOIN ev e ON w.anc = e.event_id WHERE e.is_error),
ends AS (SELECT w.event_id, w.parent, w.anc FROM walk w LEFT JOIN ev e ON w.anc = e.event_id WHERE e.event_id IS NULL OR NOT e.is_error)"""


def _dropped(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    return e.where("NOT is_error"), e.where("is_error").selectExpr("event_id AS node", "parent AS up")


@query("SELECT event_id, coalesce(anc, parent) AS new_parent FROM ends", WALK)
def g01_relink(spark, d):
    return relink.relink(*_dropped(t.ev(spark, d))).select("event_id", "new_parent")


@query("SELECT event_id, anc AS new_parent FROM ends", WALK)
def g02_relink_null(spark, d):
    return relink.relink(*_dropped(t.ev(spark, d)), keep_original=False).select("event_id", "new_parent")


@query("SELECT DISTINCT anc AS node FROM r WHERE k = 12", "RECURSIVE e AS (SELECT DISTINCT l_suppkey % 97 AS node, (l_suppkey % 97 * 7 + 3) % 97 // 2 AS up FROM lineitem)", "f AS (SELECT node, max(up) AS up FROM e GROUP BY 1)", "p AS (SELECT a.node, b.up FROM f a JOIN f b ON a.up = b.node)", "q AS (SELECT a.node, b.up FROM p a JOIN p b ON a.up = b.node)", "s AS (SELECT a.node, b.up FROM q a JOIN q b ON a.up = b.node)", "u AS (SELECT a.node, b.up FROM s a JOIN s b ON a.up = b.node)", "r AS (SELECT node, up AS anc, 1 AS k FROM u UNION ALL SELECT r.node, u.up, k + 1 FROM r JOIN u ON r.anc = u.node WHERE k < 12)")
def g03_cycles(spark, d):
    x = t.table(spark, d, "lineitem").select((F.col("l_suppkey") % 97).alias("node")).distinct()
    return relink.on_cycles(x.select("node", F.floor((F.col("node") * 7 + 3) % 97 / 2).cast("long").alias("up")))


@query("SELECT event_id, coalesce(CASE WHEN parent = (SELECT max(event_id) FROM ev) THEN NULL END, parent) AS parent FROM ev WHERE event_id <> (SELECT max(event_id) FROM ev) AND (parent IS NULL OR parent <> (SELECT max(event_id) FROM ev)) UNION ALL SELECT e.event_id, g.parent FROM ev e, (SELECT event_id, parent FROM ev WHERE event_id = (SELECT max(event_id) FROM ev)) g WHERE e.parent = g.event_id", t.EV)
def g05_delete_record(spark, d):
    e = t.ev(spark, d)
    last = e.agg(F.max("event_id")).head()[0]
    return relink.delete_record(e, last).select("event_id", "parent")


@query("SELECT o_orderkey, min_by(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def j01_first_result(spark, d):
    o = t.table(spark, d, "orders").select("o_orderkey")
    li = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("n"), "l_linenumber")
    return joins.with_first_result(o, li, ["o_orderkey"], ["l_linenumber", "n"], ["n"])


@query("SELECT event_id FROM ev WHERE EXISTS (SELECT 1 FROM fe WHERE fe.session_id = ev.session_id AND fe.path = ev.path) AND kind = 'read'", t.EV, FIRST_EDIT)
def j02_semi(spark, d):
    e = t.ev(spark, d)
    return e.where("kind = 'read'").join(e.where("kind IN ('edit', 'write') AND path <> ''").select("session_id", "path"), ["session_id", "path"], "left_semi").select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def j04_orphans(spark, d):
    li = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber")
    o = t.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("key"))
    return joins.orphans(li, o, ["key"]).select(F.col("key").alias("l_orderkey"), "l_linenumber")


KEPT = "kept AS (SELECT * FROM ev WHERE NOT is_error)"


@query("SELECT event_id, parent FROM kept WHERE parent IS NOT NULL AND parent NOT IN (SELECT event_id FROM kept)", t.EV, KEPT)
def j05_broken_parents(spark, d):
    return relink.broken_parents(t.ev(spark, d).where("NOT is_error")).select("event_id", "parent")


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT ALL SELECT doc_id FROM documents WHERE source = 'src1'")
def j06_missing(spark, d):
    docs = t.table(spark, d, "documents")
    return joins.missing(docs.where("lang = 'en'").select("doc_id"), docs.where("source = 'src1'"), "doc_id")


@query("SELECT event_id, CASE WHEN parent IS NOT NULL AND parent NOT IN (SELECT event_id FROM kept) THEN lag(event_id) OVER (PARTITION BY session_id ORDER BY pos) ELSE parent END AS new_parent FROM kept", t.EV, KEPT)
def j08_asof_repair(spark, d):
    return relink.repair_parents(t.ev(spark, d).where("NOT is_error")).select("event_id", "new_parent")


@query("SELECT event_id, last_value(CASE WHEN kind IN ('read', 'edit') THEN event_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearest FROM ev", t.EV)
def j10_summary_graft(spark, d):
    return relink.nearest_before(t.ev(spark, d), accept=F.col("kind").isin("read", "edit")).select("event_id", "nearest")


@query("SELECT e.event_id, min_by(r.event_id, r.pos) AS match FROM ev e JOIN ev r ON e.session_id = r.session_id AND e.path = r.path AND r.kind = 'read' AND r.pos < e.pos AND r.pos >= e.pos - 10 WHERE e.kind = 'edit' GROUP BY 1", t.EV)
def j11_band_join(spark, d):
    e = t.ev(spark, d).select("session_id", "path", "pos", "event_id", "kind")
    return joins.band(e.where("kind = 'edit'"), e.where("kind = 'read'"), ["session_id", "path"], 10).select("event_id", "match")


# ---- ordering, sets -----------------------------------------------------------------------------------------------------
@query("SELECT source, doc_id, row_number() OVER (ORDER BY lower(source), n_chars DESC, doc_id) AS place FROM documents")
def o01_session_sort(spark, d):
    from pyspark.sql import Window

    return t.table(spark, d, "documents").select("source", "doc_id", F.row_number().over(Window.orderBy(F.lower("source"), F.desc("n_chars"), "doc_id")).cast("long").alias("place"))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100 OFFSET 100)")
def o05_page(spark, d):
    return agg.page(t.table(spark, d, "documents").select("doc_id"), "doc_id", 1)


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id = 3 AND turn = 1")
def o07_point_lookup(spark, d):
    return t.table(spark, d, "conversations").where("conv_id = 3 AND turn = 1").select("conv_id", "turn", "text")


@query("SELECT session_id, path FROM ev WHERE kind = 'read' EXCEPT SELECT session_id, path FROM ev WHERE kind = 'edit'", t.EV)
def u02_difference(spark, d):
    e = t.ev(spark, d).select("session_id", "path", "kind")
    return e.where("kind = 'read'").drop("kind").subtract(e.where("kind = 'edit'").drop("kind"))


@query("SELECT session_id, path FROM ev WHERE kind = 'read' INTERSECT SELECT session_id, path FROM ev WHERE kind = 'edit'", t.EV)
def u03_intersection(spark, d):
    e = t.ev(spark, d).select("session_id", "path", "kind")
    return e.where("kind = 'read'").drop("kind").intersect(e.where("kind = 'edit'").drop("kind"))


# ---- text ---------------------------------------------------------------------------------------------------------------
@query(
    """SELECT doc_id, md5(CASE WHEN length(text) <= lim THEN text ELSE left(text, lim // 2) || chr(10) || '[...text truncated ' || length(text) || '->' || lim || '...]' || chr(10) || right(text, lim // 2) END) AS digest
FROM (SELECT *, trunc(8000e0 + aggr * -6500e0)::INT AS lim FROM placed)""",
    t.BLOCKS,
    placed("blk"),
)
def x02_truncate(spark, d):
    return reduce.limited_text(t.blocks(spark, d), "user_text", "text").select("doc_id", F.md5(F.col("new_text").cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents")
def x08_x10_native_text(spark, d):
    x = text.collapse_blank_lines(text.strip_non_ascii(F.col("text")))
    return t.table(spark, d, "documents").select("doc_id", F.md5(x.cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g')) AS digest FROM documents")
def x19_ascii(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.md5(text.ascii_replace(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(CASE WHEN length(s) <= 200 THEN s ELSE left(s, 199) || '…' END) AS digest FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents)")
def x20_excerpt(spark, d):
    return t.table(spark, d, "documents").select("doc_id", F.md5(text.excerpt(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, b AS is_build, b AS passed FROM (SELECT doc_id, (contains(text, 'and') OR contains(text, 'que')) AND NOT (contains(text, 'idiot') OR contains(text, 'token')) AS b FROM documents)")
def x21_build_outcome(spark, d):
    is_build, passed = text.build_outcome(F.col("text"), F.lit(False), ("and", "que"), ("idiot", "token"))
    return t.table(spark, d, "documents").select("doc_id", is_build.alias("is_build"), passed.alias("passed"))


@query("SELECT session_id, max_by(left(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\n', ' ', 'g'), 60), pos) AS snippet FROM conv WHERE role = 'user' GROUP BY 1", t.CONV)
def x24_snippet(spark, d):
    return t.conv(spark, d).where("role = 'user'").groupBy("session_id").agg(F.max_by(text.one_line(F.col("text"), 60), F.col("pos")).alias("snippet"))


@query("SELECT doc_id, CASE WHEN n_chars >= 1000000 THEN printf('%.1fM', n_chars / 1e6) WHEN n_chars >= 1000 THEN (n_chars // 1000) || 'k' ELSE n_chars::VARCHAR END AS shown FROM documents")
def x25_token_format(spark, d):
    return t.table(spark, d, "documents").select("doc_id", text.format_tokens(F.col("n_chars")).alias("shown"))


@query("SELECT event_id, CASE WHEN s >= 86400 THEN (s // 86400) || 'd' WHEN s >= 3600 THEN (s // 3600) || 'h' ELSE (s // 60) || 'm' END AS age FROM (SELECT event_id, greatest(floor(epoch(TIMESTAMP '2025-01-01 00:00:00') - floor(epoch(ts)))::BIGINT, 0) AS s FROM events)")
def y02_relative_age(spark, d):
    return t.table(spark, d, "events").select("event_id", scalar.relative_age(F.col("ts"), F.expr("cast('2025-01-01 00:00:00' AS timestamp)")).alias("age"))


@query("SELECT doc_id, CASE WHEN n_chars * 100 < 200000 THEN 'green' WHEN n_chars * 100 < 500000 THEN 'yellow' WHEN n_chars * 100 < 800000 THEN 'orange' ELSE 'red' END AS colour FROM documents")
def y04_token_colour(spark, d):
    return t.table(spark, d, "documents").select("doc_id", scalar.token_colour(F.col("n_chars") * 100).alias("colour"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def y10_content_hash(spark, d):
    return t.table(spark, d, "documents").select("doc_id", scalar.content_hash(F.col("text")).alias("digest"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 12 THEN p_name ELSE NULL END AS name FROM part")
def y14_tool_name(spark, d):
    p = t.table(spark, d, "part")
    return p.select("p_partkey", F.when(F.length("p_name") <= 12, text.repair_tool_name(F.col("p_name"), 12)).alias("name"))


# ---- diagnosis, routing -------------------------------------------------------------------------------------------------
@query(
    """SELECT name, session_id, hits FROM (
  SELECT 'parent_chain' AS name, session_id, count(*) AS hits FROM kept WHERE parent IS NOT NULL AND parent NOT IN (SELECT event_id FROM kept) GROUP BY ALL UNION ALL
  SELECT 'null_parent_at_non_root', session_id, count(*) FROM kept WHERE parent IS NULL AND pos > 0 GROUP BY ALL UNION ALL
  SELECT 'unreduced_metadata', session_id, count(*) FROM kept WHERE kind = 'write' GROUP BY ALL UNION ALL
  SELECT 'corrupted_tool_use', session_id, count(*) FROM kept WHERE length(path) > 2 GROUP BY ALL)""",
    t.EV,
    KEPT,
)
def v00_doctor_summary(spark, d):
    e = t.ev(spark, d).where("NOT is_error")
    found = doctor.diagnose(e, {"null_parent_at_non_root": F.col("parent").isNull() & (F.col("pos") > 0), "unreduced_metadata": F.col("kind") == "write", "corrupted_tool_use": F.length("path") > 2})
    chain = agg.counts(relink.broken_parents(e), "session_id").select(F.lit("parent_chain").alias("name"), "session_id", F.col("n").alias("hits"))
    return found.select("name", "session_id", "hits").unionByName(chain)


@query("SELECT name, CASE WHEN hits = 0 THEN 'ok' ELSE 'warning' END AS severity, hits FROM (SELECT 'stale_tokens' AS name, count(*) AS hits FROM (SELECT session_id, sum(length(text)) // 4 AS est, max_by(length(text), pos) AS last FROM conv GROUP BY 1) WHERE est >= 100 AND abs(last - est) > 0.1e0 * est)", t.CONV)
def v17_stale_tokens(spark, d):
    return doctor.stale_tokens(t.conv(spark, d), F.length("text"), F.length("text"))


@query("SELECT session_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS rn FROM conv) WHERE rn <= 20 AND role = 'assistant' AND contains(text, 'que')", t.CONV)
def v01_api_errors(spark, d):
    return doctor.api_errors(t.conv(spark, d), ("que",)).select("session_id", "pos")


@query("SELECT category, route, count(*) AS n FROM (SELECT CASE WHEN role = 'user' AND contains(text, '?') THEN 'INQUIRY' WHEN role = 'user' THEN 'INSTRUCTION' WHEN role = 'system' THEN 'NOTIFICATION' WHEN length(text) > 400 THEN 'EXPLANATION' ELSE 'STATUS_UPDATE' END AS category, CASE WHEN role = 'user' THEN 'KEEP' WHEN role = 'system' THEN 'HEURISTIC' WHEN length(text) > 400 THEN 'DISTILL' ELSE 'HEURISTIC' END AS route FROM conv) GROUP BY ALL", t.CONV)
def l02_routes(spark, d):
    c = t.conv(spark, d).withColumn("category", routing.rule_category(F.col("role"), F.col("text")))
    return agg.counts(c.withColumn("route", routing.route(F.col("category"))), "category", "route")


@query()
def x12_entropy(spark, d):
    from tracelens.functions import python_text

    return t.table(spark, d, "documents").select("doc_id", F.round(python_text.entropy_ratio(F.col("text")), 6).alias("ratio"))


@query()
def x03_structural(spark, d):
    from tracelens.functions import python_text

    b = reduce.with_aggressiveness(t.blocks(spark, d))
    return b.select("doc_id", F.md5(python_text.structural("standard", "/home/me")(F.col("text"), F.col("aggr")).cast("binary")).alias("digest"))


@query("SELECT session_id, path, count(*) FILTER (WHERE kind = 'read' AND f > pos) AS stale, count(*) FILTER (WHERE is_error) AS errors, count(*) AS n FROM ev LEFT JOIN fe USING (session_id, path) GROUP BY ALL", t.EV, FIRST_EDIT)
def flagship_path_health(spark, d):
    return flagship(spark, d)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session and path: reads made stale by a later change, failed commands, and all events."""
    e = t.ev(spark, sf_dir)
    first = e.where("kind IN ('edit', 'write') AND path <> ''").groupBy("session_id", "path").agg(F.min("pos").alias("f"))
    rows = e.join(first, ["session_id", "path"], "left")
    return rows.groupBy("session_id", "path").agg(F.count_if(F.expr("kind = 'read' AND f > pos")).alias("stale"), F.count_if(F.col("is_error")).alias("errors"), F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
