"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest
    node reachable.  Edges are rewritten until each node points to its root;
    each round is checkpointed, and only its count and checksum reach the
    driver.  Hubs are joined, not collected, so AQE can split them; sides that
    grow with the input are never broadcast, which would pass the driver.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .where("u <> v").distinct())
    last = _sum(edges)
    while last[0]:
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = (both.join(least.hint("merge"), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        edges = checkpoint(edges)
        # small star: smaller neighbours and the node itself point to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = (edges.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = checkpoint(small)
        now = _sum(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _sum(edges: DataFrame) -> tuple:
    # checksum in decimal: wraps nowhere, also under ANSI arithmetic
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
