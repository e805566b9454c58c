"""A kept adjacency: made once from a relation table, then walked bucket by bucket.

Each row is a node with up to `width` of its steps, so a hub is several rows rather than one that grows; rows are dealt
into buckets by node, and a node's rows are spread over `spread` files of its bucket. A walk reads the buckets of its
frontier alone, and the relation table itself never again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.sources.sinks import keep


def _bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def adjacency(relations: DataFrame, width: int = 512) -> DataFrame:
    """node, steps array<struct<id, src, rel_type, dst, next>>: both ways of each relation, at most about `width` a row. Relations without an id column give null ids; ends that are null lead nowhere."""
    own = F.col("id").cast("long") if "id" in relations.columns else F.lit(None).cast("long")
    step = lambda node, to: F.struct(own.alias("id"), "src", "rel_type", "dst", F.col(to).alias("next"))
    ways = relations.where("src IS NOT NULL AND dst IS NOT NULL").select(F.explode(F.array(F.struct(F.col("src").alias("node"), step("src", "dst").alias("s")), F.struct(F.col("dst").alias("node"), step("dst", "src").alias("s")))).alias("w")).select("w.node", "w.s")
    degrees = ways.groupBy("node").agg(F.ceil(F.count("*") / width).cast("int").alias("rows"))
    dealt = ways.join(degrees, "node").withColumn("row", F.pmod(F.xxhash64("s.rel_type", "s.src", "s.dst"), F.col("rows")).cast("int"))
    return dealt.groupBy("node", "row").agg(F.collect_list("s").alias("steps")).select("node", "row", "steps")


def write_adjacency(relations: DataFrame, path: str, buckets: int = 64, spread: int = 4, width: int = 512) -> None:
    """Write the adjacency of relations to path, replacing what is there."""
    rows = adjacency(relations, width).withColumn("bucket", _bucket(F.col("node"), buckets))
    rows.repartition("bucket", F.pmod(F.xxhash64("node", "row"), F.lit(spread))).sortWithinPartitions("bucket", "node").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _edges(hop: DataFrame, rel_types: list[str] | None, direction: str) -> DataFrame:
    edges = hop.select("query_id", "seed", F.col("node").alias("__from"), F.explode("steps").alias("s")).select("query_id", "seed", "__from", "s.id", "s.src", "s.rel_type", "s.dst", F.col("s.next").alias("__next"))
    if rel_types:
        edges = edges.where(F.col("rel_type").isin(rel_types))
    ahead = {"out": F.col("__from") == F.col("src"), "in": F.col("__from") == F.col("dst"), "both": F.lit(True)}[direction]
    # A loop is stored once for each of its ends.
    return edges.where(ahead & (F.lit(direction == "both") | (F.col("__next") == F.col({"out": "dst", "in": "src", "both": "dst"}[direction]))))


def walk(steps: DataFrame, seeds: DataFrame, depth: int = 1, rel_types: list[str] | None = None, direction: str = "both", buckets: int | None = None) -> DataFrame:
    """query_id, seed, src, rel_type, dst, depth, id: what graph.graph_expand gives, from rows of adjacency().

    Each level is one join of the frontier with the adjacency and is kept as a table, so that neither is computed again; a node is
    visited once a seed. buckets: steps has a column of that many buckets, and a level reads only those of its frontier (at
    most so many numbers come to the driver).
    """
    visited = frontier = keep(seeds.select("query_id", "seed", F.col("seed").alias("node")).where("node IS NOT NULL").distinct(), "frontier")
    levels = []
    for level in range(1, min(3, max(1, depth)) + 1):
        near = steps
        if buckets:
            near = near.where(F.col("bucket").isin([r[0] for r in frontier.select(_bucket(F.col("node"), buckets)).distinct().collect()]))
        edges = keep(_edges(frontier.join(near.select("node", "steps"), "node"), rel_types, direction).withColumn("depth", F.lit(level)), "level")
        levels.append(edges)
        if level < depth:
            frontier = keep(edges.select("query_id", "seed", F.col("__next").alias("node")).distinct().join(visited, ["query_id", "seed", "node"], "left_anti"), "frontier")
            visited = visited.unionByName(frontier)
    found = reduce(DataFrame.unionByName, levels)
    return found.groupBy("query_id", "seed", "src", "rel_type", "dst").agg(F.min("depth").alias("depth"), F.min("id").alias("id"))


def walk_kept(spark: SparkSession, path: str, seeds: DataFrame, depth: int = 1, rel_types: list[str] | None = None, direction: str = "both", buckets: int = 64) -> DataFrame:
    """walk() on a written adjacency."""
    return walk(spark.read.parquet(path), seeds, depth, rel_types, direction, buckets)
