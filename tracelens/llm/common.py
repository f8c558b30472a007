"""Shared folder, stage tables and whole-table readers for the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: maximal runs of characters that are neither space nor \t..\r.
WORD = r"[^\x20\x09-\x0D]+"

_opened: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session on this one machine
    gets a local folder; a cluster has no such folder, and needs the setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "tracelens-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _opened:
        try:
            _delete(spark, path)
        except Exception:  # the session has gone; the folder is the cluster's to clean
            return


atexit.register(_sweep)


class Workspace:
    """A folder of its own in the shared folder for one run of an operator.

    Tables written here cut the lineage: a lost executor costs a re-read, never a recomputation. `drop` frees a table as
    soon as nothing reads it; what is left goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _opened.append((spark, self.path))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.path}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grows(side: DataFrame) -> DataFrame:
    """A side of an equi-join that grows with the input: joined by a merge. Spark sizes a table by the one it is made of, so
    after an explode, or where a file's columns compress well, it would broadcast far more than its threshold."""
    return side.hint("merge")


def text_key(doc_id: Column, text: Column) -> Column:
    """With doc_id, tells rows apart by content; rows equal in both are one row repeated, which every operator treats alike."""
    return F.xxhash64(doc_id, text)


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
