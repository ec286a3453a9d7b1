"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

The steps reach a fixed point, in which every node points at the smallest of its component, in O(log^2 n) rounds (proved
there), so the loop needs no bound. Every step is a grouped minimum (partial aggregation) and a join back of one row a node, whose other side the adaptive planner
splits where a node has very many neighbours; rounds are written to the shared folder, and only one number a round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root) for every node that has an edge to another; root is the component's smallest node."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        after = saved(_small(_large(now)), "edges")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        dropped(now)
        now = after
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
