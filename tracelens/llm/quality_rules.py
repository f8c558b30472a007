"""Quality rules: a decision list learned from labelled statistics, applied as ordered Spark conditions.

Statistics of whole texts are SQL functions. The learner covers low-quality rows one rule after another: it grows a
conjunction of thresholds on two thirds of the remaining rows by information gain, prunes its last conditions on the other
third, and stops when a rule isn't right often enough. It sees those of at most `max_rows` labelled rows, chosen by a hash
of their ids, that pass the base rule, as numbers; everything else is DataFrame expressions.

Null or empty text has no words and fails the base rule. Rows that repeat are alike, and labels that repeat or contradict
are all learned from. Without labels, or with labels of one kind only, the list is empty and keeps all that passes the base
rule. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import WORD, Workspace
from tracelens.llm.learning import chosen_labels

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_marks", "n_distinct", "n_lines"]
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "n_words": "cast(n_words as double)",
}
MAX_ROWS = 20_000


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the base and extra counts) of each row's whole text."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    w = text.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).withColumn("lines", F.expr(r"filter(split(t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    g = w.withColumn("g", F.expr("CASE WHEN size(w) >= 5 THEN transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) ELSE cast(array() AS array<bigint>) END"))
    # only texts in which some window repeats are sorted with places
    g = g.withColumn("s", F.expr("CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (h, i) -> struct(h, i))) END"))
    g = g.withColumn("p", F.expr("sort_array(transform(filter(transform(s, (x, k) -> struct(x.i AS i, x.h <=> get(s, k - 1).h OR x.h <=> get(s, k + 1).h AS hit)), x -> x.hit), x -> x.i))"))
    covered = "coalesce(aggregate(transform(p, (x, k) -> least(5, coalesce(get(p, k + 1) - x, 5))), 0L, (a, x) -> a + x), 0L)"
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    return g.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        (F.length("t") - count(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        count(r"\p{Lu}").alias("n_upper"),
        count(r"[!?]").alias("n_marks"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rejects where all conditions hold."""

    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def _holds(x: dict[str, np.ndarray], c: Condition) -> np.ndarray:
    return x[c.feature] > c.threshold if c.above else x[c.feature] <= c.threshold


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[Condition]:
    inside, rule = np.ones(len(bad), bool), []
    while len(rule) < most:
        p, n = int(bad[inside].sum()), int(inside.sum())
        if not p or p == n:
            break
        before, best, chosen = math.log2(p / n), 1e-9, None
        for name in FEATURES:
            value, b = x[name][inside], bad[inside]
            place = np.searchsorted(cuts[name], value, "left")  # value <= cut j for all j >= place
            size = len(cuts[name]) + 1
            below, below_bad = np.cumsum(np.bincount(place, minlength=size))[:-1], np.cumsum(np.bincount(place, weights=b, minlength=size))[:-1]
            for above, m, q in ((False, below, below_bad), (True, n - below, p - below_bad)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(q > 0, q * (np.log2(q / m) - before), -1.0)
                if len(gain) and gain.max() > best:
                    best, chosen = float(gain.max()), Condition(name, above, float(cuts[name][int(gain.argmax())]))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= _holds(x, chosen)
    return rule


def _prune(x: dict[str, np.ndarray], bad: np.ndarray, rule: list[Condition]) -> list[Condition]:
    """The beginning of the rule that does best on rows it wasn't grown on: (bad - good) over covered, ties to the shorter."""
    inside, best, keep = np.ones(len(bad), bool), -math.inf, 1
    for k, c in enumerate(rule, 1):
        inside = inside & _holds(x, c)
        p, n = int(bad[inside].sum()), int(inside.sum())
        if n and (2 * p - n) / n > best:
            best, keep = (2 * p - n) / n, k
    return rule[:keep]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, precision: float = 0.9, least: int = 8, n_cuts: int = 64) -> list[Rule]:
    """Ordered rules for bad rows by sequential covering; deterministic in its input's order."""
    rules: list[Rule] = []
    left = np.arange(len(bad))
    held = (np.arange(len(bad)) * 2654435761 % (1 << 32)) % 3 == 0
    while len(rules) < max_rules and len(left) and bad[left].any() and not bad[left].all():
        cuts = {f: np.unique(np.quantile(x[f][left], np.linspace(0, 1, n_cuts), method="lower")) for f in FEATURES}
        grow, prune = left[~held[left]], left[held[left]]
        rule = _grow({f: v[grow] for f, v in x.items()}, bad[grow], cuts, max_conditions)
        if not rule:
            break
        rule = _prune({f: v[prune] for f, v in x.items()}, bad[prune], rule)
        inside = np.ones(len(left), bool)
        for c in rule:
            inside &= _holds({f: v[left] for f, v in x.items()}, c)
        p, n = int(bad[left][inside].sum()), int(inside.sum())
        if p < least or p < precision * n:
            break
        rules.append(Rule(tuple(rule), p / n, n))
        left = left[~inside]
    return rules


def fit(work: Workspace, stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **how) -> list[Rule]:
    """Rules from the labelled rows that pass the base rule. The labels are chosen before the join: they alone are sorted."""
    chosen = chosen_labels(labels, "quality", F.lit(True), max_rows)
    rows = stats.where(~base_failed()).join(F.broadcast(chosen), "doc_id")
    sample = work.table(rows.select(F.xxhash64("doc_id").alias("h"), "y", *[F.expr(e).alias(f) for f, e in FEATURES.items()]), "sample")
    got = sorted(sample.collect())  # max_rows rows of numbers, or more only where documents repeat their ids
    if not got:
        return []
    return learn({f: np.array([r[f] for r in got], float) for f in FEATURES}, np.array([r.y == 0 for r in got]), **how)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects the row, from 1; 0 if none does."""
    if not rules:
        return F.lit(0)
    out = F.when(rules[0].column(), F.lit(1))
    for k, r in enumerate(rules[1:], 2):
        out = out.when(r.column(), F.lit(k))
    return out.otherwise(F.lit(0))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The base counts of each document, the base verdict, and whether it is kept."""
    work = Workspace(spark, "quality-rules")
    stats = work.table(statistics(docs), "statistics")
    rejected = verdict(fit(work, stats, labels, **how))
    rows = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(F.col("base_failed"), F.lit(None).cast("int")).otherwise(rejected))
    return rows.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
