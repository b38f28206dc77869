"""Connected components by alternating large-star and small-star steps.

Every step links nodes to the smallest neighbour, found by an aggregation that is summed before the
shuffle.  Bringing it back is a join on the node: the links of a node with very many of them are split
by Spark's adaptive skew join (on by default), not by a salt, which would double the many small shuffles
of the rounds.  Each round is written to the shared scratch folder; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component): the smallest node reachable, for every node with a link.
    Self links are ignored; no links give an empty result."""
    edges = edges.where(F.col("u") != F.col("v")).select("u", "v")
    state, before = written(_small_star(edges).distinct(), "stars"), None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        state = written(_small_star(_large_star(state).distinct()).distinct(), "stars")
    roots = state.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
