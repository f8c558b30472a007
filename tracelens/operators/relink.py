"""Parent chains: re-linking through dropped records, cycles, and repairs from the nearest earlier record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def jump(dropped: DataFrame, rounds: int = 24) -> DataFrame:
    """(node, up) for each dropped (node, up): the first ancestor that isn't dropped, null at the end of the chain or on a cycle.

    Pointer doubling: each round follows twice as far, so a run of n dropped records takes log2(n) joins. The rounds that
    are left when no pointer ends at a dropped node change nothing, and stop early. Lineage is cut by a checkpoint where
    the session has a folder for them.
    """
    spark = dropped.sparkSession
    now = dropped.select("node", "up")
    for _ in range(rounds):
        at = now.selectExpr("node AS __at", "up AS __next")
        step = now.join(at, F.col("up") == F.col("__at"), "left").select("node", F.when(F.col("__at").isNull(), F.col("up")).otherwise(F.col("__next")).alias("up"), F.col("__at").isNotNull().alias("moved"))
        step = step.checkpoint() if spark.sparkContext.getCheckpointDir() else step
        now = step.select("node", "up")
        if not step.where("moved").head(1):
            return now
    ends = now.join(dropped.selectExpr("node AS __at"), F.col("up") == F.col("__at"), "left")
    return ends.select("node", F.when(F.col("__at").isNull(), F.col("up")).alias("up"))


def relink(kept: DataFrame, dropped: DataFrame, parent: str = "parent", keep_original: bool = True, rounds: int = 24) -> DataFrame:
    """kept with its parents moved past dropped (node, up). A chain that ends nowhere leaves the parent, or nulls it."""
    ends = jump(dropped, rounds).selectExpr("node AS __node", "up AS __up")
    moved = kept.join(ends, F.col(parent) == F.col("__node"), "left")
    new = F.when(F.col("__node").isNull(), F.col(parent)).otherwise(F.coalesce("__up", parent) if keep_original else F.col("__up"))
    return moved.withColumn("new_parent", new).drop("__node", "__up")


def broken_parents(records: DataFrame, node: str = "event_id", parent: str = "parent") -> DataFrame:
    return records.where(F.col(parent).isNotNull()).join(records.select(F.col(node).alias(parent)).distinct(), parent, "left_anti")


def nearest_before(records: DataFrame, node: str = "event_id", accept=None) -> DataFrame:
    """records with `nearest`: the node of the closest earlier record of the session that is accepted (any, by default)."""
    w = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    value = F.col(node) if accept is None else F.when(accept, F.col(node))
    return records.withColumn("nearest", F.last(value, ignorenulls=True).over(w))


def repair_parents(records: DataFrame, node: str = "event_id", parent: str = "parent") -> DataFrame:
    """Broken parents become the closest earlier record."""
    broken = broken_parents(records, node, parent).select(F.col(node).alias("__broken"))
    rows = nearest_before(records, node)
    return rows.join(broken, F.col(node) == F.col("__broken"), "left").withColumn("new_parent", F.when(F.col("__broken").isNotNull(), F.col("nearest")).otherwise(F.col(parent))).drop("__broken", "nearest")


def on_cycles(edges: DataFrame, rounds: int = 24) -> DataFrame:
    """Nodes of (node, up), one up each, that lie on a cycle.

    After as many doublings as reach past the longest chain, what a node that never ends points to lies on a cycle; the
    images of all nodes are then exactly the cycles' nodes.
    """
    spark = edges.sparkSession
    now = edges.select("node", "up").where("up IS NOT NULL")
    for _ in range(rounds):
        size = now.count()
        if not size:
            break
        new = now.join(now.selectExpr("node AS __at", "up AS __next"), F.col("up") == F.col("__at")).selectExpr("node", "__next AS up")
        new = new.checkpoint() if spark.sparkContext.getCheckpointDir() else new
        images, before = new.select("up").distinct().count(), now.select("up").distinct().count()
        done = images == before and new.count() == size
        now = new
        if done:
            break
    return now.selectExpr("up AS node").distinct()


def sever_cycles(edges: DataFrame) -> DataFrame:
    """The edges with one parent of each cycle nulled: that of its least node."""
    cyclic = on_cycles(edges)
    inner = edges.join(cyclic, "node").select("node", "up")
    # the least node of each cycle, by spreading minima along it
    low = inner.withColumn("low", F.col("node"))
    while True:
        step = low.join(low.selectExpr("node AS up", "low AS other"), "up").select("node", "up", F.least("low", "other").alias("low"))
        step = step.checkpoint() if edges.sparkSession.sparkContext.getCheckpointDir() else step
        changed = step.join(low.selectExpr("node", "low AS old"), "node").where("low <> old").head(1)
        low = step
        if not changed:
            break
    cut = low.where("node = low").selectExpr("node AS __cut")
    return edges.join(cut, F.col("node") == F.col("__cut"), "left").select("node", F.when(F.col("__cut").isNull(), F.col("up")).alias("up"))


def delete_record(records: DataFrame, uuid, node: str = "event_id", parent: str = "parent") -> DataFrame:
    """Without one record; its children take its parent."""
    gone = records.where(F.col(node) == F.lit(uuid)).select(F.col(node).alias("__gone"), F.col(parent).alias("__up"))
    return records.where(F.col(node) != F.lit(uuid)).join(F.broadcast(gone.limit(1)), F.col(parent) == F.col("__gone"), "left").withColumn(parent, F.when(F.col("__gone").isNotNull(), F.col("__up")).otherwise(F.col(parent))).drop("__gone", "__up")
