"""Connected components over an edge table, by alternating large-star and small-star contraction.

Only (node, node) rows move, every step ends in a written table, and minima are pre-aggregated before each shuffle, so a
node that touches a third of all edges is neither gathered nor joined in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm._common import materialise


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, not null). Returns node, root: the least node that it reaches; nodes without an edge to another are left out."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _digest(edges)
    while before[0]:
        # Large star: each larger neighbour of a node goes to the least node around it.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = materialise(edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).distinct(), "large-star")
        # Small star: a node and its smaller neighbours go to the least of them.
        small = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(moved.union(small.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = _digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
