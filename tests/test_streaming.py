"""Appended lines and stateful detection."""

from tracelens.operators import detect
from tracelens.plans import adapters
from tracelens.streaming import appended

DATA = "/root/testdata/sf0.001"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_appended_lines(spark, tmp_path):
    folder, check = tmp_path / "in", str(tmp_path / "check")
    folder.mkdir()
    out = str(tmp_path / "out")
    f = folder / "a.jsonl"

    def step():
        q = appended.appended_lines(spark, str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(once=True).start()
        q.awaitTermination()
        return [r.raw for r in spark.read.parquet(out).orderBy("byte_offset").collect()]

    f.write_text('{"a":1}\n{"b":2}\n{"half"')
    assert step() == ['{"a":1}', '{"b":2}']
    with f.open("a") as h:
        h.write(":3}\n")
    assert step() == ['{"a":1}', '{"b":2}', '{"half":3}']


def test_blind_edits_as_stream(spark, tmp_path):
    ev = adapters.ev(spark, DATA)
    ev.write.parquet(str(tmp_path / "ev"))
    stream = appended.event_stream(spark, str(tmp_path / "ev"), ev.schema)
    got = {r.event_id for r in run(appended.blind_edits(stream), "blind").collect()}
    assert got == {r.event_id for r in detect.blind_edits(ev).collect()}


def test_counts_by_window(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(str(tmp_path / "e"))
    stream = appended.event_stream(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema)
    assert run(appended.counts_by_window(stream), "counts", "complete").groupBy().sum("n").head()[0] == spark.read.parquet(str(tmp_path / "e")).count()
