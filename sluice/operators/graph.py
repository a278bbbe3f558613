"""Graphs of edges: components, cycles, and ancestry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import cut


def cyclic_nodes(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node) of the nodes that a cycle can pass: those left when nodes without incoming or without outgoing edges are taken off again and again.

    Each round is two semi joins over what is left, cut from its lineage. Nodes on a path between
    two cycles are left too; `in_cycle` tells them apart.
    """
    left = cut(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where(F.col("s").isNotNull() & F.col("d").isNotNull()).distinct())
    n = left.count()
    while n:
        kept = left.join(left.select(F.col("d").alias("s")).distinct(), "s", "left_semi").join(left.select(F.col("s").alias("d")).distinct(), "d", "left_semi")
        left = cut(kept.select("s", "d"))
        m = left.count()
        if m == n:
            break
        n = m
    return left.select(F.col("s").alias("node")).distinct()


def reachable(edges: DataFrame, start: DataFrame, src: str, dst: str) -> DataFrame:
    """(start, node) of everything that each start reaches, itself included; frontier by frontier, until one is empty."""
    e = cut(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct())
    seen = cut(start.select(F.col(start.columns[0]).alias("start"), F.col(start.columns[0]).alias("node")).distinct())
    frontier = seen
    while True:
        step = frontier.join(e, F.col("node") == F.col("s")).select("start", F.col("d").alias("node")).distinct()
        frontier = cut(step.join(seen, ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))


def provenance_trace(events: DataFrame, start: DataFrame, event_id: str = "provenance_event_id", parents: str = "parent_event_ids") -> DataFrame:
    """(start, node): each event with all its ancestors."""
    return reachable(events.select(F.col(event_id).alias("s"), F.explode(parents).alias("d")), start, "s", "d")


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) of nodes on cycles; root is the smallest node of the strongly connected component.

    On the nodes that are left after trimming: the smallest node that reaches each node and the
    smallest that each node reaches are spread along the edges; where they agree the node
    belongs to that node's component. Found components are taken out and the rest starts anew.
    """
    nodes = cyclic_nodes(edges, src, dst)
    rest = cut(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct().join(nodes.select(F.col("node").alias("s")), "s", "left_semi").join(nodes.select(F.col("node").alias("d")), "d", "left_semi"))
    found = None
    while not rest.isEmpty():
        fore, back = _least(rest, "s", "d"), _least(rest, "d", "s")
        # The smallest node that reaches a node and is reached by it names the component.
        agreed = cut(fore.withColumnRenamed("least", "f").join(back.withColumnRenamed("least", "b"), "node").where(F.col("f") == F.col("b")).select("node", F.col("f").alias("root")))
        found = agreed if found is None else found.unionByName(agreed)
        gone = agreed.select("node")
        rest = cut(rest.join(gone.withColumnRenamed("node", "s"), "s", "left_anti").join(gone.withColumnRenamed("node", "d"), "d", "left_anti").select("s", "d"))
    if found is None:
        return nodes.select("node", F.col("node").alias("root")).limit(0)
    loops = edges.where(F.col(src) == F.col(dst)).select(F.col(src).alias("node")).distinct()
    size = found.groupBy("root").count()
    return found.join(size, "root").join(loops.withColumn("_loop", F.lit(True)), "node", "left").where((F.col("count") > 1) | F.col("_loop")).select("node", "root")


def _least(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, least): the smallest node with a path along a -> b to the node, itself included."""
    labels = cut(edges.select(F.explode(F.array(a, b)).alias("node")).distinct().withColumn("least", F.col("node")))
    while True:
        sent = edges.join(labels.withColumnRenamed("node", a), a).groupBy(F.col(b).alias("node")).agg(F.min("least").alias("in_"))
        stepped = cut(labels.join(sent, "node", "left").select("node", F.least("least", F.coalesce("in_", "least")).alias("least"), (F.col("in_") < F.col("least")).alias("moved")))
        done = stepped.where("moved").isEmpty()
        labels = stepped.select("node", "least")
        if done:
            return labels
