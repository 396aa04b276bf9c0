"""Connected components of an edge table, by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved


def _forest(edges: DataFrame) -> DataFrame:
    """(node, root): each node follows its smallest neighbour below itself until that stands still."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
    tree = saved(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = saved(tree.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")))
        tree = jumped.select("node", "root")
        if not jumped.filter("moved").limit(1).count():
            return tree


def components(edges: DataFrame, keep: bool = False) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that edges reach.

    Each round contracts every tree to its root and goes on with the edges between roots, so the number
    of rounds is logarithmic in the longest path. Self loops and repeated edges are allowed; an empty
    table gives an empty table. keep: see saved().

    A component of a third of all nodes makes its root a hot key of the joins on roots. Rows are two numbers, the other side has
    one row for each root, and adaptive execution splits such partitions of the outer or the larger side.
    """
    edges = saved(edges.select("a", "b").filter("a <> b").distinct())
    known = None
    while known is None or edges.limit(1).count():
        tree = _forest(edges)
        known = tree.withColumnRenamed("root", "component") if known is None else saved(
            known.join(tree.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        )
        left = edges.join(tree.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(tree.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = saved(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct())
    return saved(known, keep) if keep else known
