"""Native text functions. Lengths are in code points unless a name says bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: markers of build output
ERROR_WORDS = ("error", "panic", "FAILED", "failed", "exception")
SUCCESS_MARKERS = ("Finished", "passed", "exit code 0", "Build succeeded", "OK")
# fixed values: short affirmations
CONFIRMATIONS = (
    "yes", "ok", "okay", "sure", "fine", "go ahead", "go", "do it", "proceed", "continue", "right", "correct", "y", "yeah", "yep", "yup",
    "agreed", "sounds good", "lets go", "looks good", "lgtm", "thanks", "thank you", "thx", "exactly", "perfect", "good", "great", "nice",
    "awesome", "cool", "done", "a", "b", "c", "1", "2", "3",
)


def truncate(text: Column, limit: Column | int, label: str) -> Column:
    """Head and tail of half the limit each around a marker; as it is if short enough. With half 0 the whole text is its tail."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    half = F.floor(limit / 2).cast("int")
    marker = F.concat(F.lit(f"\n[...{label} truncated "), F.length(text).cast("string"), F.lit("->"), limit.cast("string"), F.lit("...]\n"))
    tail = F.when(half > 0, F.right(text, half)).otherwise(text)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, half), marker, tail))


def shorten_paths(text: Column, home: str) -> Column:
    """<home>/src/mine/<project>/ becomes ~/<project>/."""
    return F.regexp_replace(text, rf"\Q{home}\E/src/mine/([^/\s]+)/", "~/$1/")


def strip_line_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^ *\d+[→│]\s?", "")


def collapse_indent(text: Column) -> Column:
    """Each line's n >= 4 leading blanks become n // 4 * 2 + n % 4."""

    def line(x: Column) -> Column:
        n = F.length(x) - F.length(F.ltrim(x))
        return F.when(n >= 4, F.concat(F.repeat(F.lit(" "), (F.floor(n / 4) * 2 + n % 4).cast("int")), F.ltrim(x))).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def strip_non_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def ascii_replace(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def strip_white(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def excerpt(text: Column, limit: int = 200) -> Column:
    s = strip_white(text)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.left(s, F.lit(limit - 1)), F.lit("…")))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def build_outcome(output: Column, is_error: Column, markers: tuple[str, ...] = SUCCESS_MARKERS, errors: tuple[str, ...] = ERROR_WORDS) -> tuple[Column, Column]:
    """(is a build, passed) of a command's output."""
    passed, failed = output.rlike(r"\d+\s+passed"), output.rlike(r"\d+\s+failed")
    lucky = contains_any(output, markers) & ~contains_any(output, errors) & ~is_error
    return passed | failed | lucky, F.when(passed | failed, passed & ~failed & ~is_error).otherwise(lucky)


def is_confirmation(text: Column, phrases: tuple[str, ...] = CONFIRMATIONS, below: int = 20, strict: bool = False) -> Column:
    """Short texts that are, or (unless strict) begin with, one of the phrases."""
    s = F.regexp_replace(F.lower(strip_white(text)), r"[.,!?;:]+$", "")
    hit = s.isin(*phrases)
    if not strict:
        for p in phrases:
            hit = hit | s.startswith(p)
    return (F.length(strip_white(text)) < below) & hit


def is_continuation_summary(text: Column) -> Column:
    return text.rlike(r"(?i)being continued from a previous conversation")


def dedup_reminders_count(text: Column, tag: str = "system-reminder") -> Column:
    """How many tagged passages repeat an earlier one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)(<{tag}>.*?</{tag}>)"), F.lit(1))
    return F.size(found) - F.size(F.array_distinct(found))


def one_line(text: Column, n: int) -> Column:
    return F.left(F.regexp_replace(strip_white(text), r"\n", " "), F.lit(n))


def format_tokens(n: Column) -> Column:
    """42k, 1.2M."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%dk", F.floor(n / 1000).cast("long"))).otherwise(n.cast("string"))


def format_bytes(n: Column) -> Column:
    return F.when(n >= 1 << 20, F.format_string("%.1f MB", n / float(1 << 20))).when(n >= 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%d B", n.cast("long")))


def spark_char(value: Column, most: Column) -> Column:
    """One of nine block characters for value / most."""
    chars = F.array(*[F.lit(c) for c in " ▁▂▃▄▅▆▇█"])
    return F.when(most > 0, F.element_at(chars, (F.least(F.lit(8), F.ceil(value * 8 / most)) + 1).cast("int"))).otherwise(F.lit(" "))


def repair_tool_name(name: Column, most: int = 200) -> Column:
    """A corrupted tool name's part before its first quote, if that is a word; null if it can't be repaired."""
    first = F.split_part(name, F.lit('"'), F.lit(1))
    return F.when(F.length(name) <= most, name).when(first.rlike(r"^\w+$") & (F.length(first) <= most), first)
