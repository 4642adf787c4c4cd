"""Connected components by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
Each step links neighbours to the smallest node known and never makes more
links than it read; a node with very many neighbours needs only its smallest
one (a minimum, combined before the shuffle) and a join that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_STEPS = 60


def large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest neighbour or itself."""
    both = edges.select("a", "b").unionByName(edges.selectExpr("b as a", "a as b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").selectExpr("m as a", "b").where("a < b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    down = edges.selectExpr("b as node", "a as low")
    least = down.groupBy("node").agg(F.min("low").alias("m"))
    moved = down.join(least, "node")
    return moved.selectExpr("m as a", "low as b").unionByName(least.selectExpr("m as a", "node as b")).where("a < b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b with a < b) and the smallest node of its component."""
    now = common.stored(edges.select("a", "b"), "links")
    before = None
    for _ in range(MAX_STEPS):
        # done once every b has one a, and no a is itself a b: stars with the smallest node in the middle
        now = common.stored(small_star(large_star(now)), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            return now.selectExpr("b as node", "a as root")
        before = state
    raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
