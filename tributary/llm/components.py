"""Connected components of links, by alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Scratch


def _checksum(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Every neighbour larger than a node is tied to the smallest neighbour of that node, or to the node if it is smaller.

    Edges are (u, v) with u > v, so a node's smallest neighbour is known from the edges it is the larger end of.  That is a table
    of its own: a join of two tables is one whose hot keys (v, the smallest of a large group) adaptive execution can split.
    """
    low = scratch.write(edges.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m")), name)
    return edges.join(low.hint("merge"), F.col("v") == F.col("at"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours and itself are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select("v", "m").unionAll(least.select(F.col("u").alias("v"), "m")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for each node of a link, label the smallest node of its component.

    Each round is two joins on the contracted links; rounds grow with the logarithm of the longest path.  Links with a null end
    are left out, repeated ones count once, and without links there are no rows; other columns are not read.
    """
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v AND a IS NOT NULL AND b IS NOT NULL").distinct(), f"{name}-0")
    before = _checksum(edges)
    k = 0
    while before[0]:
        k += 1
        edges = scratch.write(small_star(large_star(edges, scratch, f"{name}-low")), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = _checksum(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
