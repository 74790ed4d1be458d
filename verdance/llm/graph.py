"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: A node with more than this part of all edge ends is joined by broadcast.
HOT_PART = 1_000


def joined(edges: DataFrame, least: DataFrame, on: str, ends: int) -> DataFrame:
    """edges with the m of least, joined on a node. Nodes with more than ends / HOT_PART edges, of which there are
    at most HOT_PART, are broadcast, so that none gathers its edges in one task; the others are joined by shuffle."""
    is_hot = F.col("n") * HOT_PART > ends
    hot = least.where(is_hot).select(on, "m")
    rows = edges.join(F.broadcast(hot), on, "left")
    rest = rows.where("m IS NULL").drop("m").join(least.where(~is_hot).select(on, "m"), on)
    return rows.where("m IS NOT NULL").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of the edges (a, b).

    Rounds of hashing to the minimum and shortcutting: every node points to the smallest label
    among its own and its neighbours', and labels are then followed once more, so that the
    number of rounds grows with the logarithm of the longest path. Each round is written to the
    checkpoint folder; only a count returns to the driver. Groups are reduced by min before
    they are shuffled; in the large star, where a group's leader has all of its edges,
    nodes of very many edges are joined by broadcast. Nodes can be of any type that has an order.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    digest = None
    while True:
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if digest == (row["n"], row["sum"]):
            break
        digest = (row["n"], row["sum"])
        # Large star: the neighbours above a node point to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
        large = joined(both.where("b > a"), least, "a", 2 * row["n"]).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: the smaller neighbours of a node, and the node, point to the least of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b")
        edges = cut(small.select(F.col("m").alias("a"), "b").distinct())
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
