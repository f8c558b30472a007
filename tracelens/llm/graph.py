"""Connected components of a graph given as edges, by alternating large and small stars.

Each round is joins and grouped minima over edges, written to the shared folder, so no vertex's neighbours are ever in one
place and nothing but two numbers a round reaches the driver. The number of rounds grows with the logarithm of the size of
the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.llm.common import Workspace


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.selectExpr("v AS u", "u AS v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
    return both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """edges: each from a vertex to a smaller one."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v")
    return rest.unionAll(least.selectExpr("u", "m AS v")).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
    return (r.n, r.s)


def components(work: Workspace, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each vertex of edges (u, v) that has an edge to another; root: the least vertex of its component."""
    now = work.table(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), f"{name}-0")
    state, k = _state(now), 0
    while state[0]:
        new = work.table(_small(_large(now)), f"{name}-{k + 1}")
        work.drop(f"{name}-{k}")
        last, state, k, now = state, _state(new), k + 1, new
        if last == state:
            break
    return now.selectExpr("u AS node", "v AS root").unionAll(now.selectExpr("v AS node", "v AS root").distinct()).distinct()
