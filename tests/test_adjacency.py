"""The kept adjacency against the level-by-level joins and a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from wayfind.operators import adjacency, graph
from wayfind.sources import sinks


def plain_walk(edges, seeds, depth, rel_types, direction):
    out = {}
    for q, seed in seeds:
        frontier, visited = {seed}, {seed}
        for level in range(1, depth + 1):
            following = set()
            for i, s, r, d in edges:
                if rel_types and r not in rel_types:
                    continue
                for node, to, way in ((s, d, "out"), (d, s, "in")):
                    if node in frontier and direction in (way, "both"):
                        key = (q, seed, s, r, d)
                        out[key] = (min(out.get(key, (9, 0))[0], level), min(out.get(key, (0, 1 << 60))[1], i))
                        following.add(to)
            frontier = following - visited
            visited |= frontier
    return sorted((*k, *v) for k, v in out.items())


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(2)
    hub = [(500 + k, 1, "R", 100 + k) for k in range(60)]  # node 1 is a hub
    return [(k, rng.randrange(30), rng.choice("RST"), rng.randrange(30)) for k in range(70)] + hub + [(900, 7, "R", 7), (901, 7, "R", 7)]


@pytest.mark.parametrize(("depth", "rel_types", "direction"), [(1, None, "both"), (3, None, "both"), (2, ["R", "S"], "out"), (3, ["R"], "in")])
def test_walk(spark, edges, tmp_path, depth, rel_types, direction):
    rels = spark.createDataFrame(edges, "id long, src long, rel_type string, dst long")
    seeds = [(0, 1), (0, 2), (1, 7), (2, 9999)]
    asked = spark.createDataFrame([*seeds, (3, None), (0, 1)], "query_id long, seed long")
    path = str(tmp_path / "adjacency")
    adjacency.write_adjacency(rels, path, buckets=8, width=10)
    found = adjacency.walk_kept(spark, path, asked, depth, rel_types, direction, buckets=8)
    want = plain_walk(edges, seeds, depth, rel_types, direction)
    assert sorted(map(tuple, found.select("query_id", "seed", "src", "rel_type", "dst", "depth", "id").collect())) == want
    joins = graph.graph_expand(asked.where("seed IS NOT NULL"), rels, depth, rel_types, direction)
    assert sorted(map(tuple, joins.select("query_id", "seed", "src", "rel_type", "dst", "depth", "id").collect())) == want


@pytest.mark.parametrize("most", [250_000, 0])
@pytest.mark.parametrize(("depth", "rel_types", "direction"), [(1, None, "both"), (3, None, "both"), (2, ["R", "S"], "out"), (3, ["R"], "in")])
def test_walk_of_nodes(spark, edges, monkeypatch, depth, rel_types, direction, most):
    """Distances of nodes give the same edges and depths as the walk, whether nodes go to all tasks or are merged, and nothing
    the last level reaches is written: only edges, nodes and their lists are."""
    monkeypatch.setattr(graph, "MOST_NODES", most)
    written = []
    monkeypatch.setattr(graph, "keep", lambda df, name: written.append(df.columns) or sinks.keep(df, name))
    rels = spark.createDataFrame([*edges, (950, 3, "R", None)], "id long, src long, rel_type string, dst long")
    seeds = [(0, 1), (0, 2), (1, 7), (2, 9999)]
    asked = spark.createDataFrame([*seeds, (3, None), (0, 1)], "query_id long, seed long")
    found = graph.expand_by_nodes(asked, rels, depth, rel_types, direction)
    assert sorted(map(tuple, found.select("query_id", "seed", "src", "rel_type", "dst", "depth", "id").collect())) == plain_walk(edges, seeds, depth, rel_types, direction)
    assert not any({"seed", "src"} <= set(columns) for columns in written)
    bare = graph.expand_by_nodes(asked, rels.drop("id"), depth, rel_types, direction)
    assert bare.count() == found.count() and bare.where("id IS NOT NULL").isEmpty()


def test_hubs_are_split_and_buckets_pruned(spark, edges, tmp_path):
    rels = spark.createDataFrame(edges, "id long, src long, rel_type string, dst long")
    rows = adjacency.adjacency(rels, 10)
    assert rows.where("node = 1").count() >= 6 and rows.agg(F.max(F.size("steps"))).first()[0] <= 40
    assert rows.select(F.sum(F.size("steps"))).first()[0] == 2 * len(edges)
    path = str(tmp_path / "adjacency")
    adjacency.write_adjacency(rels, path, buckets=8)
    near = adjacency._edges(spark.createDataFrame([(0, 1, 1)], "query_id long, seed long, node long").join(spark.read.parquet(path).where("bucket = 3"), "node"), None, "both")
    assert "PartitionFilters: [isnotnull(bucket" in near._jdf.queryExecution().executedPlan().toString()


def test_empty_and_without_ids(spark):
    none = spark.createDataFrame([], "src long, rel_type string, dst long")
    asked = spark.createDataFrame([(0, 1)], "query_id long, seed long")
    assert adjacency.walk(adjacency.adjacency(none), asked, 2).collect() == []
    one = spark.createDataFrame([(1, "R", 2), (2, "R", None)], "src long, rel_type string, dst long")
    assert [tuple(r) for r in adjacency.walk(adjacency.adjacency(one), asked, 3).collect()] == [(0, 1, 1, "R", 2, 1, None)]
