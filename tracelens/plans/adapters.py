"""The driver's tables as transcripts, and the same relations for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as verb events: a session per user, a path per key."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "signup", "write").otherwise("run")
    return e.select(F.col("user_id").alias("session_id"), "event_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), F.lag("event_id").over(w).alias("parent"), F.get_json_object("props", "$.k").alias("path"), kind.alias("kind"), (F.col("event_type") == "error").alias("is_error"), "event_type", "value", "ts")


EV = """ev AS (SELECT user_id AS session_id, event_id, row_number() OVER w - 1 AS pos, lag(event_id) OVER w AS parent, json_extract_string(props, '$.k') AS path,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'edit' WHEN 'signup' THEN 'write' ELSE 'run' END AS kind, event_type = 'error' AS is_error, event_type, value, ts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` as records."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), "turn", "role", "text", F.concat_ws("-", "conv_id", "turn").alias("uuid"))


CONV = """conv AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn, role, text, conv_id || '-' || turn AS uuid FROM conversations)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as text blocks, a session per source."""
    w = Window.partitionBy("source").orderBy("doc_id")
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("session_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.lit(0).alias("bi"), "doc_id", "text", "lang")


BLOCKS = """blk AS (SELECT source AS session_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, 0 AS bi, doc_id, text, lang FROM documents)"""
