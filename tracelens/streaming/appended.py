"""Transcripts that grow: lines appended to files as a stream, and detectors that keep their state per session."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class _Part(InputPartition):
    def __init__(self, file: str, start: int, end: int, prefix: str | None):
        super().__init__(f"{file}:{start}")
        self.file, self.start, self.end, self.prefix = file, start, end, prefix


class AppendedReader(DataSourceStreamReader):
    """Offsets are each file's size up to its last line break, and a digest of its beginning: a file that was rewritten fails the batch."""

    HEAD = 4096

    def __init__(self, options: dict):
        self.folder = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for name in sorted(os.listdir(self.folder)):
            path = os.path.join(self.folder, name)
            if name.endswith(".jsonl") and os.path.isfile(path):
                with open(path, "rb") as f:
                    data = f.read()
                end = data.rfind(b"\n") + 1
                if end:
                    out[name] = f"{end}:{hashlib.md5(data[: min(end, self.HEAD)]).hexdigest()}"
        return out

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        out = []
        for name, now in end.items():
            size, digest = now.split(":")
            before, head = start.get(name, "0:").split(":")
            if head and int(before) >= self.HEAD and head != digest:
                raise ValueError(f"{name} was rewritten, not appended to")
            if int(size) < int(before):
                raise ValueError(f"{name} was cut short")
            if int(size) > int(before):
                out.append(_Part(name, int(before), int(size), None))
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(os.path.join(self.folder, partition.file), "rb") as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        at = partition.start
        for line in data.split(b"\n"):
            if line.strip():
                yield partition.file, at, line.decode("utf-8", "replace")
            at += len(line) + 1

    def commit(self, end: dict) -> None:
        return None


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "file string, byte_offset long, raw string"

    def streamReader(self, schema) -> AppendedReader:
        return AppendedReader(self.options)


def appended_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, byte_offset, raw) of lines as they are appended to a folder's .jsonl files, which driver and workers both see."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").option("path", folder).load()


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def counts_by_window(events: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type by tumbling window, late ones up to the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def blind_edits(events: DataFrame) -> DataFrame:
    """Changes of a path that the session hasn't read so far: the state of a session and path is one flag."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else False
        rows = pd.concat(parts).sort_values("pos")
        out = []
        for r in rows.itertuples():
            if r.kind == "read":
                seen = True
            elif r.kind in ("edit", "write") and not seen:
                out.append(r.event_id)
        state.update((bool(seen),))
        yield pd.DataFrame({"event_id": pd.Series(out, dtype="int64")})

    return events.select("session_id", "path", "pos", "event_id", "kind").groupBy("session_id", "path").applyInPandasWithState(run, "event_id long", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def untagged(records: DataFrame, version: int, rank: int) -> DataFrame:
    """Records that no earlier run has worked on at this version and a profile of this rank or above."""
    done = (F.coalesce(F.get_json_object("raw", "$._reduce.v").cast("int"), F.lit(-1)) >= version) & (F.coalesce(F.get_json_object("raw", "$._reduce.rank").cast("int"), F.lit(-1)) >= rank)
    return records.where(~done)
