"""Connected components by contracting edges, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of the edges (``x``, ``y``).

    In each step a node goes over to its smallest neighbour and on to that one's, edges are
    redrawn between the nodes that are left, and edges inside one node vanish. Every node
    with a smaller neighbour goes, so few steps do for any graph and one for a star. The root
    is one of the component's nodes; an edgeless table gives an empty one.
    """
    edges = stored(edges.where("x <> y").select("x", "y").distinct(), "edges")
    moved = None
    while True:
        ends = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        nearest = stored(ends.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("to")), "nearest")
        onward = nearest.select(F.col("x").alias("to"), F.col("to").alias("root"))
        step = stored(nearest.join(onward, "to").select("x", "root"), "step")
        if moved is None:
            moved = step.select(F.col("x").alias("node"), "root")
        else:
            after = step.select(F.col("x").alias("root"), F.col("root").alias("_next"))
            moved = stored(
                moved.join(after, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "moved"
            )
        by_x = step.select("x", F.col("root").alias("_x"))
        by_y = step.select(F.col("x").alias("y"), F.col("root").alias("_y"))
        redrawn = edges.join(by_x, "x").join(by_y, "y").where("_x <> _y")
        edges = stored(redrawn.select(F.col("_x").alias("x"), F.col("_y").alias("y")).distinct(), "edges")
        if not edges.limit(1).count():
            return moved
