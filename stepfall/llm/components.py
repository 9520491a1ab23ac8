"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfall.plans.materialize import cut


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b); root is the least node of its component.

    Every round each node takes its least neighbour (or itself) as parent, parents are looked up
    once more, and links are redrawn between parents; links inside one node vanish.  The number of
    nodes that still have links at least halves, and components never leave the cluster.
    """
    edges = cut(links.select("a", "b").filter("a <> b").distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = cut(both.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")))
        again = parent.select(F.col("a").alias("up"), F.col("up").alias("upper"))
        step = cut(parent.join(again, "up", "left").select(
            F.col("a").alias("root"), F.coalesce("upper", "up").alias("next")))
        roots = cut(roots.join(step, "root", "left").select(
            "node", F.coalesce("next", "root").alias("root")))
        to = lambda side: step.select(F.col("root").alias(side), F.col("next").alias(f"{side}2"))
        edges = cut(edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(
            F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
            .filter("a <> b").distinct())
    return roots
