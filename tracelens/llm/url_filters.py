"""URL filters: block and allow rules by host and path, carried over to a page's aliases.

Pages are joined to the URLs that redirect to or from them (a refresh in their head) or that they name as canonical (a link
in their head); URLs that differ only in scheme, case of host or fragment are one. Connected components of these edges are
classes of aliases. The longest rule that fits a URL decides it. Without one: an allowed alias allows it, else a blocked
alias blocks it, else it is allowed.

A null URL, or one without "://", has an empty host and path, belongs to no class and is allowed. Null html has no links.
Repeated rows are alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import Workspace
from tracelens.llm.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*['"]?([^"'\s>]+)"""


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("org", "/", True),
    UrlRule("example.org", "/es/", False),
    UrlRule("example.org", "/en/1", False),
    UrlRule("com", "/fr/", True),
    UrlRule("com", "/de/", False),
)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda's variable, so that generated code holds one copy of its expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def identity(url: Column) -> Column:
    """One string for URLs that differ only in scheme, case of host or fragment; null without a host."""

    def of(url: Column) -> Column:
        path, query = path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
        rest = F.concat(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), query)
        return _bound(host_of(url), lambda host: F.when(host != "", F.concat(host, rest)))

    return _bound(url, of)


def absolute(link: Column, base: Column) -> Column:
    """A link as it stands in a page at base: absolute, without scheme, from the host's root, or beside the page."""
    # scheme and host, and the folder; a base without a path has the root as its folder
    root, beside = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0), F.regexp_extract(path_of(base), r"(?s)^.*/", 0)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^[^:/?#]+", 0), F.lit(":"), link))
        .otherwise(F.concat(root, F.when(link.startswith("/"), F.lit("")).when(beside == "", F.lit("/")).otherwise(beside), link))
    )


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """Text of the longest rule that fits; null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)) if out is None else out.when(fits, F.lit(r.text))
    return out if out is not None else F.lit(None).cast("string")


def _allows(rule: Column, rules: tuple[UrlRule, ...]) -> Column:
    allowed = [r.text for r in rules if r.allow]
    return F.when(rule.isNotNull(), rule.isin(allowed) if allowed else F.lit(False))


def edges(pages: DataFrame) -> DataFrame:
    """(u, v): a page's URL and one that it redirects to or names as canonical."""
    head = F.coalesce(F.col("html"), F.lit(""))
    links = F.array(F.regexp_extract(head, CANONICAL, 1), F.regexp_extract(head, REFRESH, 1))
    found = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select("url", F.explode(links).alias("link")).where("link <> ''")
    ends = found.select(F.explode(F.array(F.struct(identity(F.col("url")).alias("u"), identity(absolute(F.col("link"), F.col("url"))).alias("v")))).alias("e"))
    return ends.select("e.u", "e.v").where("u IS NOT NULL AND v IS NOT NULL")


def judge(spark: SparkSession, pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Host, path, fitting rule and verdict of each page. redirects: further edges (from_url, to_url), such as a crawl's log."""
    work = Workspace(spark, "url-filters")
    links = edges(pages)
    if redirects is not None:
        links = links.unionAll(redirects.select(identity(F.col("from_url")).alias("u"), identity(F.col("to_url")).alias("v")).where("u IS NOT NULL AND v IS NOT NULL"))
    classes = work.table(components(work, links), "classes").selectExpr("node AS __node", "root AS __root")
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), identity(url).alias("__node")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    classed = rows.join(classes, "__node", "left").withColumn("__class", F.coalesce("__root", "__node"))
    # a class also has the URLs that only links name
    named = classes.select("__root", F.regexp_extract("__node", r"^[^/]*", 0).alias("host"), F.regexp_extract("__node", r"^[^/]*([^?]*)", 1).alias("path"))
    votes = named.select(F.col("__root").alias("__class"), _allows(rule_of(F.col("host"), F.col("path"), rules), rules).alias("a"))
    votes = votes.where("a IS NOT NULL").groupBy("__class").agg(F.max("a").alias("__alias"))
    judged = classed.join(votes, "__class", "left")
    allow = F.coalesce(_allows(F.col("rule"), rules), F.col("__alias"), F.lit(True))
    return judged.select("page_id", "host", "path", "rule", F.when(allow, "allow").otherwise("block").alias("verdict"))
