"""Connected components of links between numbered nodes, in rounds of following and contracting.

Each node takes its least neighbour below it as its parent; parents are followed to the root by
jumping, which halves the way each time; links between different roots are the next round's links, so
a round works on what is left. All tables hold numbers only. A hub of very many nodes makes one
partition of a join large, which AQE splits: nothing after these joins needs their partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written


def follow(parents: DataFrame) -> DataFrame:
    """``node, root`` from ``node, parent``, where parents are less than their nodes."""
    now = written(parents, "parents")
    while True:
        above = now.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = now.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        then = written(step, "parents")
        discard(now)
        if then.where("moved").isEmpty():
            return then.select("node", F.col("parent").alias("root"))
        now = then.drop("moved")


def renamed(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``node, root`` where ``more`` gives some roots a root of their own."""
    new = more.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return roots.join(new, "root", "left").select("node", F.coalesce("new", "root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges (u, v)``; the root is the component's least node."""
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    roots = None
    while True:
        step = follow(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent")))
        # Nodes that were roots before get a root now; their own nodes follow them.
        roots = step if roots is None else written(renamed(roots, step).unionByName(step), "roots")
        left = now
        for end in ("u", "v"):
            left = left.join(step.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
        left = written(left.where("ru != rv").select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct(), "edges")
        discard(now)
        now = left
        if now.isEmpty():
            discard(now)
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
