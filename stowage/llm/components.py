"""Connected components by alternating large-star and small-star steps.

Each step is a pre-aggregated minimum and one join of two written tables, so a vertex with very many links is
split by adaptive execution and no step holds the neighbours of a vertex together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of edges (a, b); root is the smallest node that can be reached.

    Null ends are left out. An edge from a node to itself keeps that node.
    """
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = cut(_down(edges), "edges")
    while not _stars_only(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        # large star: neighbours above a vertex go to the least of its neighbourhood
        met = now.select(F.col("b").alias("k"), F.col("a").alias("v")).join(least, F.col("k") == F.col("a"))
        large = cut(_down(met.select(F.col("v").alias("a"), F.col("m").alias("b"))), "edges")
        drop(now, least)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        # small star: neighbours below a vertex, and the vertex, go to the least of them
        met = large.select(F.col("a").alias("k"), F.col("b").alias("v")).join(least, F.col("k") == F.col("a"))
        moved = met.select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = cut(_down(moved.union(least.select("a", F.col("m").alias("b")))), "edges")
        drop(large, least)
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots, F.col("node") == F.col("a"), "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def _down(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller end."""
    return edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).filter(F.col("a") != F.col("b")).distinct()


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has either one link down, to a root, or only links from above: then all roots are found."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()
