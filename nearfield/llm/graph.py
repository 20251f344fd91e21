"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return scratch.table(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.table(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return scratch.table(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")


def _print(edges: DataFrame) -> tuple:
    # the sum of hashes is taken in halves, so that it can't overflow
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """u, v: every node of an edge but the least of its component, with that least node.

    edges: columns u and v, of an ordered type. Nodes that meet in both steps'
    hot groups are joined to one small row each, which Spark may split.
    """
    now = scratch.table(edges.filter("u <> v").select("u", "v"), "edges")
    mark = _print(now)
    while True:
        large = _large_star(now, scratch)
        small = _small_star(large, scratch)
        then = _print(small)
        scratch.drop(now, large)
        if then == mark:
            return small
        now, mark = small, then
