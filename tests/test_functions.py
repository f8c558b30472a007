"""Text and number functions on literals."""

import pytest
from pyspark.sql import functions as F

from tracelens.functions import python_text, scalar, text
from tracelens.operators import routing


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).head()[0]


@pytest.mark.parametrize(("limit", "want"), [(10, "abcdefghij"), (4, "ab\n[...t truncated 10->4...]\nij"), (1, "\n[...t truncated 10->1...]\nabcdefghij")])
def test_truncate(spark, limit, want):
    assert one(spark, text.truncate(F.col("t"), limit, "t"), t="abcdefghij") == want


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("cat a b", ("read", ["a", "b"], [], "cat")),
        ("grep x f", ("read", ["f"], [], "grep")),
        ("sed -i s/a/b/ f", ("edit", ["f"], [], "sed")),
        ("echo x > out", ("write", ["out"], [], "echo")),
        ("sudo pytest -q", ("build", [], [], "pytest")),
        ("cat a && rm b", ("write", ["b"], ["a"], "rm")),
        ("bash -c 'cat a.py'", ("read", ["a.py"], [], "cat")),
        ("git apply x.patch", ("edit", [], [], "git")),
        ("head -n 50 a.py", ("read", ["a.py"], [], "head")),
        ("make 2> err.txt", ("write", ["err.txt"], [], "make")),
        ("cat < in", ("read", ["in"], [], "cat")),
        ("cp a b", ("write", ["a", "b"], [], "cp")),
        ("rg needle", ("read", [], [], "rg")),
        ("timeout 5 env A=1 ruff check", ("build", [], [], "ruff")),
        ("python -m pytest -q", ("build", [], [], "python")),
        ("python x.py", ("run", [], [], "python")),
        ("cat a > b ; ls", ("write", ["b"], ["a"], "cat")),
        ("true && make ; touch x && sed -i s/a/b/ y", ("edit", ["y"], [], "sed")),
        ("cat a | tee b", ("write", ["b"], ["a"], "tee")),
        ("echo 'unclosed", ("run", [], [], None)),
        ("", ("run", [], [], None)),
    ],
)
def test_shell(command, want):
    assert python_text.shell_intent(command) == want


def test_text_columns(spark):
    assert one(spark, text.strip_line_numbers(F.col("t")), t="  1→a\n 12│b") == "a\nb"
    assert one(spark, text.collapse_indent(F.col("t")), t="     x\n  y") == "   x\n  y"
    assert one(spark, text.collapse_blank_lines(F.col("t")), t="a\n\n\n\nb") == "a\n\nb"
    assert one(spark, text.shorten_paths(F.col("t"), "/home/me"), t="/home/me/src/mine/p/q") == "~/p/q"
    assert one(spark, text.is_confirmation(F.col("t")), t=" OK! ") is True
    assert one(spark, text.is_confirmation(F.col("t"), strict=True), t="build it") is False
    assert one(spark, text.is_confirmation(F.col("t")), t="build it") is True
    assert one(spark, text.dedup_reminders_count(F.col("t")), t="<system-reminder>a</system-reminder>x<system-reminder>a</system-reminder>") == 1
    assert one(spark, text.format_bytes(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, text.repair_tool_name(F.col("t")), t='Read" ' + "x" * 300) == "Read"
    assert one(spark, text.build_outcome(F.col("t"), F.lit(False))[1], t="3 passed, 1 failed") is False


def test_python_text():
    assert python_text.collapse_runs("a" + "-" * 12) == "a-*12"
    assert python_text.redundancy("") == 0.0 and python_text.redundancy("ab" * 500) > 0.9
    assert python_text.collapse_diff("todo\n- a\n1\n2\n3\n4\n5\n6\nend") == "todo\n- a\n1\n2\n3\n4\n5\n6\nend"
    hunk = ["diff --git a b", "@@ -1 +1 @@", *"abcdefgh", "+y", *"ijklmnop", "-z", "q", "@@ -9 +9 @@", "k"]
    assert python_text.collapse_diff("\n".join(hunk)) == "\n".join(["diff --git a b", "@@ -1 +1 @@", *"fgh", "+y", *"ijk", "...", *"nop", "-z", "q", "@@ -9 +9 @@", "k"])
    assert python_text.minify_code("def f():\n    # why\n    return 1  // one\n\n/* a\n b */ x\n") == "def f():\n return 1\nx"
    assert python_text.minify_code("plain words\n\n# here") == "plain words\n\n# here"
    assert python_text.collapse_progress("a\nCompiling x\n  Fresh y\nUpdating z\nb") == "a\nCompiling x\n  [...2 more cargo lines...]\nb"
    assert python_text.strip_banners("hi\n  ____/ /_/ / /____\n /_/____|__/_/\n\n\nrest") == "hi\nrest"
    assert python_text.minify_json('{"a": 1,   "b":   [1, 2]  }') == '{"a":1,"b":[1,2]}' and python_text.minify_json('{"a":1}') is None and python_text.minify_json("x") is None
    long = "international performance measurement"
    thin = python_text.drop_characters(long, 0.9)
    assert thin == python_text.drop_characters(long, 0.9) and len(thin) < len(long) and [w[0] + w[-1] for w in thin.split()] == ["il", "pe", "mt"]
    assert python_text.drop_characters(long, 0.3) == long
    assert python_text.dedup_reminders("<system-reminder>a</system-reminder>\nq <system-reminder>a</system-reminder>") == "<system-reminder>a</system-reminder>\nq"


def test_times(spark):
    at = F.timestamp_seconds(F.col("s"))
    colour = lambda age: one(spark, scalar.age_colour(at, F.timestamp_seconds(F.col("s") + age)), s=1_700_000_000)
    assert [colour(a) for a in (0, 3600, 86400, 10**8)] == ["#00d4aa", "#5ac882", "#b4c850", "#3c2819"]
    assert one(spark, scalar.age_colour(F.lit(None).cast("timestamp"), at), s=1) == "#555555"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [one(spark, F.unix_timestamp(scalar.parse_time(F.col("t"))), t=t) for t in ("1970-01-01T00:01:00", "1970-01-01T00:01:00Z", "1970-01-01T01:01:00+01:00", "soon")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [60, 60, 60, None]
    assert one(spark, scalar.tokens_by_size(F.col("n"), F.lit(29), F.lit(False)), n=1400) == 2


def test_curve_and_limits(spark):
    at = [one(spark, scalar.aggressiveness(F.col("p")), p=p) for p in (0.0, 0.1, 0.4, 0.9)]
    assert at == [0.2, 0.2, 1.0, 0.2]
    assert one(spark, scalar.blended_limit("user_text", F.col("a")), a=1.0) == 1500
    assert one(spark, scalar.blended_limit(F.col("k"), F.lit(0.0)), k="nobody") == 6000
    assert one(spark, scalar.message_type(F.col("r"), F.col("t")), r="Developer", t="x") == "assistant"


def test_routing(spark):
    assert routing.parse_categories(["ANALYSIS", "nonsense"], 3) == ["ANALYSIS", "SCAFFOLDING", "SCAFFOLDING"]
    df = spark.createDataFrame([("a. " + "b" * 500, 0.9), ("short", 0.9)], "text string, aggr double")
    out = routing.distill(routing.classify(df, routing.HeadProvider()), routing.HeadProvider()).collect()
    assert sorted(r.new_text for r in out) == ["a", "short"]


def test_functions_of_documents_hold_one_text_at_a_time():
    """A batch of documents stays in Arrow; as strings of pandas it was in hand twice, four times where a letter lies beyond Latin."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"{k} " + "слово word " * 400 for k in range(2000)] + [None, ""])
    for of, others in ((python_text.entropy_ratio, ()), (python_text.structural("standard", "/home/me"), (pa.array([0.0] * len(texts)),))):
        tracemalloc.start()
        try:
            out = of.func(texts, *others)
            peak = tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()
        assert len(out) == len(texts) and peak < 1, peak
    ratios = python_text.entropy_ratio.func(texts).to_pylist()
    assert ratios == [python_text.redundancy(t or "") for t in texts.to_pylist()]
