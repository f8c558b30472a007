"""Position curves, limits, times, sizes, hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: (gentle end, aggressive end) of each limit by profile
LIMITS = {
    "gentle": {
        "Bash": (12000, 3000), "Read": (16000, 4000), "Agent": (20000, 6000), "Write": (8000, 2000), "Edit": (6000, 1500), "mcp": (32000, 8000), "default": (16000, 4000),
        "tur.originalFile": (2000, 500), "tur.stdout": (12000, 3000), "tur.content": (8000, 2000), "tur.oldString": (6000, 1500), "tur.newString": (6000, 1500), "tur.file": (8000, 2000),
        "tool_input.Write": (8000, 2000), "tool_input.Edit": (6000, 1500), "tool_input.Agent": (12000, 3000), "thinking": (8000, 1000), "user_text": (20000, 4000),
    },
    "standard": {
        "Bash": (4000, 800), "Read": (6000, 800), "Agent": (8000, 1000), "Write": (3000, 600), "Edit": (2000, 500), "mcp": (10000, 2000), "default": (6000, 800),
        "tur.originalFile": (800, 200), "tur.stdout": (4000, 800), "tur.content": (3000, 600), "tur.oldString": (2000, 500), "tur.newString": (2000, 500), "tur.file": (3000, 600),
        "tool_input.Write": (3000, 600), "tool_input.Edit": (2000, 500), "tool_input.Agent": (3000, 800), "tool_input.Bash": (3000, 600), "thinking": (3000, 0), "user_text": (8000, 1500),
    },
    "aggressive": {
        "Bash": (3000, 400), "Read": (4000, 400), "Agent": (6000, 500), "Write": (2000, 400), "Edit": (1500, 300), "mcp": (6000, 800), "default": (3000, 400),
        "tur.originalFile": (400, 100), "tur.stdout": (3000, 400), "tur.content": (2000, 400), "tur.oldString": (1500, 200), "tur.newString": (1500, 200), "tur.file": (2000, 400),
        "tool_input.Write": (2000, 200), "tool_input.Edit": (1500, 200), "tool_input.Agent": (3000, 300), "tool_input.Bash": (2000, 400), "thinking": (2000, 0), "user_text": (6000, 800),
    },
}
PROFILE_RANK = {"gentle": 0, "standard": 1, "aggressive": 2}
CHARS_PER_TOKEN = 3.7


def aggressiveness(p: Column, cut: float = 0.10, fade: float = 0.75) -> Column:
    """0.2 at both ends of a session, 1 in its middle, with ramps of a third of the span between cut and fade. p: in [0, 1]."""
    span = fade - cut
    up, down = cut + span / 3, fade - span / 3
    low = F.lit(0.2)
    return (
        F.when(p < F.lit(cut), low)
        .when(p < F.lit(up), F.lit(0.2) + F.lit(0.8) * (p - F.lit(cut)) / F.lit(up - cut))
        .when(p < F.lit(down), F.lit(1.0))
        .when(p < F.lit(fade), F.lit(1.0) - F.lit(0.8) * (p - F.lit(down)) / F.lit(fade - down))
        .otherwise(low)
    )


def relative_position(pos: Column, n: Column) -> Column:
    return pos.cast("double") / F.greatest(n - 1, F.lit(1))


def blended_limit(key: Column | str, aggr: Column, profile: str = "standard") -> Column:
    """Between a key's gentle and aggressive ends; unknown keys have the default's."""
    table = LIMITS[profile]

    def of(name: str) -> Column:
        g, a = table[name]
        return (F.lit(float(g)) + aggr * F.lit(float(a - g))).cast("int")

    if isinstance(key, str):
        return of(key if key in table else "default")
    out = F.when(key == F.lit("default"), of("default"))
    for name in table:
        if name != "default":
            out = out.when(key == F.lit(name), of(name))
    return out.otherwise(of("default"))


def entropy_limit(ratio: Column, length: Column, limit: Column) -> Column:
    return F.when(length < 200, limit).when(ratio < 0.3, (limit * 1.5).cast("int")).when(ratio > 0.5, (limit * 0.5).cast("int")).otherwise(limit)


def age_limits(aggr: Column) -> tuple[Column, Column]:
    """(mid, old): turns after which a tool result is shortened, then replaced."""
    return (F.lit(15.0) - aggr * 7.0).cast("int"), (F.lit(40.0) - aggr * 20.0).cast("int")


def item_tokens(chars: Column) -> Column:
    return (chars / F.lit(CHARS_PER_TOKEN)).cast("int")


def parse_time(text: Column) -> Column:
    """ISO times; without an offset they are UTC, whatever the session's zone is; anything else is null."""
    zoned = text.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned | ~text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), text).otherwise(F.concat(text, F.lit("Z"))))


# fixed values: seconds of age and the red, green and blue at them
AGE_STOPS = ((0, (0, 212, 170)), (3600, (90, 200, 130)), (86400, (180, 200, 80)), (7 * 86400, (170, 130, 60)), (30 * 86400, (110, 70, 35)), (90 * 86400, (60, 40, 25)))


def age_colour(ts: Column, now: Column) -> Column:
    """#rrggbb from fresh to old, even in the logarithm of the age between stops; #555555 without a time."""
    s = F.greatest(now.cast("double") - ts.cast("double"), F.lit(0.0))
    ends = [(math.log1p(a), ca, math.log1p(b), cb) for (a, ca), (b, cb) in zip(AGE_STOPS, AGE_STOPS[1:])]
    parts = []
    for k in range(3):
        part = F.lit(AGE_STOPS[-1][1][k])
        for (stop, _), (a, ca, b, cb) in list(zip(AGE_STOPS[1:], ends))[::-1]:
            between = F.bround(F.lit(float(ca[k])) + F.lit(float(cb[k] - ca[k])) * (F.log1p(s) - F.lit(a)) / F.lit(b - a)).cast("int")
            part = F.when(s < stop, between).otherwise(part)
        parts.append(F.lower(F.lpad(F.hex(part), 2, "0")))
    return F.when(ts.isNull(), F.lit("#555555")).otherwise(F.concat(F.lit("#"), *parts))


def tokens_by_size(size: Column, line_count: Column, has_exchanges: Column) -> Column:
    """Estimate without counts: a fourteenth of the bytes, or of the lines where there are no exchanges."""
    return F.floor(F.when(has_exchanges, size).otherwise(line_count) / 14).cast("long")


def relative_age(ts: Column, now: Column) -> Column:
    """3d, 5h or 7m; the future is 0m."""
    s = F.greatest(F.unix_timestamp(now) - F.unix_timestamp(ts), F.lit(0))
    return F.when(s >= 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit("d"))).when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m")))


def token_colour(n: Column) -> Column:
    return F.when(n < 200_000, "green").when(n < 500_000, "yellow").when(n < 800_000, "orange").otherwise("red")


def usage_total(usage: Column) -> Column:
    parts = [F.coalesce(usage[c], F.lit(0)) for c in ("input", "cache_read", "cache_create")]
    return parts[0] + parts[1] + parts[2]


def head_tail(items: Column, head: Column, tail: Column, marker: str) -> Column:
    """The first and last items of an array around a marker, if there are more than both."""
    n = F.size(items)
    return F.when(n <= head + tail, items).otherwise(F.concat(F.slice(items, 1, head), F.array(F.lit(marker)), F.slice(items, n - tail + 1, tail)))


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def message_type(role: Column, type_: Column) -> Column:
    """A known role wins over the record's type; event-like types are the assistant's."""
    r = F.when(F.lower(role) == "developer", F.lit("assistant")).otherwise(F.lower(role))
    eventlike = type_.rlike(r"^(?i:event|rollout)") | type_.isin("response", "response_item")
    return F.when(r.isin("user", "assistant", "system", "tool"), r).when(F.coalesce(type_, F.lit("")).isin("", "unknown"), "unknown").when(eventlike, "assistant").otherwise(type_)
