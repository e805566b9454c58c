"""Entity resolution, bounded expansion and relation scans, for many questions at once.

entities: id, type, canonical_name. aliases: entity_id, alias. relations: id, src, rel_type, dst. Frontiers are
DataFrames keyed by (query_id, seed), so one join a level serves every question and seed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import text as T
from wayfind.sources.sinks import bounded, keep

# How relations read in a context line, and below, the texts of candidates.
RELATION_LABELS = {
    "USES": "사용 중인 제품",
    "BELONGS_TO": "소속 부서",
    "HEAD_IS": "부서장",
    "MANAGES_ACCOUNT": "담당 고객사",
    "HAS_PROJECT": "진행 프로젝트",
    "LEADS": "이끄는 프로젝트",
    "REPORTED_ISSUE": "기술지원 이슈를 제기한 제품",
}


def relation_label(rel_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RELATION_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, rel_type), rel_type)


def entity_key(kind: Column, entity_id: Column) -> Column:
    return F.concat(F.lit("entity:"), kind, F.lit("#"), entity_id.cast("string"))


#: Distinct runs of the terms that go to the names as a list: of three characters each.
MOST_RUNS = 5000
#: Rows of nodes that go to all tasks, at most: tens of megabytes.
MOST_NODES = 250_000


def grams(text: Column, n: Column | int = 3) -> Column:
    """The distinct runs of n characters; of length 0 there is one, the empty run."""
    n = n if isinstance(n, Column) else F.lit(n)
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def match_terms(terms: DataFrame, entities: DataFrame, aliases: DataFrame, like_wildcards: bool = True, best_of: int | None = None) -> DataFrame:
    """query_id, id, type, canonical_name, via, matched, score: the best match of each entity.

    4 for the whole name, 3 for a whole alias, 2 for a prefix, 1 for a part. like_wildcards: `_` and `%` in a term stand for
    anything. A name that holds a term holds all its runs of three characters, so names and terms meet on that run of the
    term's longest literal piece that fewest names have, and the test for a part comes after; a term with a run that no name has
    meets none. Where that piece is shorter, it
    is the run itself, of two characters, one or none, so that these meet in the same join. Names come from all entities and
    become many runs each, so they are never gathered: the terms go to them (or both are merged), and where the terms have at
    most MOST_RUNS distinct runs, all others are dropped inside the row. best_of: so many of a question's entities, in the order of
    top_matches, are among the rows if they match; what stands further back may be left out before matches are grouped.
    """
    own = entities.select("id", F.lower("canonical_name").alias("name"), F.lit("canonical").alias("via"), F.lit(4).alias("exact"))
    other = aliases.select(F.col("entity_id").alias("id"), F.lower("alias").alias("name"), F.lit("alias").alias("via"), F.lit(3).alias("exact"))
    names = own.unionByName(other)
    pieces = F.split(F.lower("term"), "[_%]") if like_wildcards else F.array(F.lower("term"))
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    # A column first: inside the lambda of grams an expression would be worked out again for each run.
    asked = terms.select("query_id", "term").distinct().select("query_id", "term", F.lower("term").alias("low"), longest.alias("piece"))
    asked = keep(asked.select("query_id", "term", "low", grams(F.col("piece"), F.least(F.length("piece"), F.lit(3))).alias("grams")), "asked")
    if like_wildcards:
        part, start = F.expr("name LIKE concat('%', low, '%')"), F.expr("name LIKE concat(low, '%')")
    else:
        part, start = F.contains("name", F.col("low")), F.startswith(F.col("name"), F.col("low"))
    wanted = asked.select("query_id", "term", "low", F.size("grams").alias("held"), F.explode("grams").alias("gram"))
    distinct = keep(wanted.select("gram").distinct(), "runs-asked")
    few = [r[0] for r in distinct.limit(MOST_RUNS + 1).collect()]
    sizes = {len(g) for g in few} if len(few) <= MOST_RUNS else {r[0] for r in distinct.select(F.length("gram")).distinct().collect()}
    of_name = F.concat(*[grams(F.col("name"), n) for n in sorted(sizes)], F.array().cast("array<string>"))
    if len(few) <= MOST_RUNS:
        cut = lambda df: df.withColumn("gram", F.explode(F.filter(of_name, lambda g: g.isin(few))))
    else:
        sought = bounded(distinct, "runs-asked")
        cut = lambda df: df.withColumn("gram", F.explode(of_name)).join(sought, "gram", "left_semi")
    known = cut(names).groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(bounded(known, "runs-known"), "gram").groupBy("query_id", "term", "low", "held").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"), F.count("*").alias("known"))
    rarest = rarest.where("known = held").drop("known", "held")  # a term with a run that no name has is in no name
    if best_of:
        names = names.join(entities.select("id", F.length("canonical_name").alias("long")).hint("merge"), "id")
    met = cut(names).join(bounded(rarest, "rarest-runs"), "gram").where(part).select("query_id", "id", "term", "low", "name", "via", "exact", *["long"] * bool(best_of))
    score = F.when(F.col("name") == F.col("low"), F.col("exact")).when(start, 2).otherwise(1)
    hits = met.select("query_id", "id", "via", F.col("term").alias("matched"), score.alias("score"), *["long"] * bool(best_of))
    if best_of:  # an entity has at most four scores, so its best is within so many places if it is among the best
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "long", "id")
        hits = hits.withColumn("at", F.dense_rank().over(w)).where(F.col("at") <= 4 * best_of)
    best = hits.groupBy("query_id", "id").agg(
        F.min(F.struct(-F.col("score"), "via")).alias("v"),
        F.min(F.struct(-F.col("score"), "matched")).alias("m"),
        F.max("score").alias("score"),
    )
    return entities.select("id", "type", "canonical_name").join(bounded(best, "matches"), "id").select("query_id", "id", "type", "canonical_name", F.col("v.via").alias("via"), F.col("m.matched").alias("matched"), "score")


def ontology_search(queries: DataFrame, entities: DataFrame, aliases: DataFrame, k: int = 5, like_wildcards: bool = True) -> DataFrame:
    """The k best entities of each question (query_id, query), ranked by score, then shorter name, then id."""
    terms = queries.select("query_id", F.explode(T.seed_terms(F.col("query"))).alias("term"))
    return top_matches(match_terms(terms, entities, aliases, like_wildcards), k)


def ontology_search_many(queries: DataFrame, entities: DataFrame, aliases: DataFrame, k: int = 5, like_wildcards: bool = True) -> DataFrame:
    """What ontology_search gives, for many questions that share terms.

    Each distinct term meets the names once and keeps its k best. What is among the k best of a question is among the k best of
    the term that gave it its score, since the order within a term is that within the question, so nothing is lost.
    """
    terms = keep(queries.select("query_id", F.explode(T.seed_terms(F.col("query"))).alias("term")), "terms")
    once = terms.select(F.col("term").alias("query_id"), "term").distinct()
    best = keep(top_matches(match_terms(once, entities, aliases, like_wildcards, k), k).withColumnRenamed("query_id", "term").drop("rank"), "term-hits")
    hits = terms.join(best, "term")
    per = hits.groupBy("query_id", "id").agg(F.min(F.struct(-F.col("score"), "via")).alias("v"), F.min(F.struct(-F.col("score"), "matched")).alias("m"), F.max("score").alias("score"), F.first("type").alias("type"), F.first("canonical_name").alias("canonical_name"))
    return top_matches(per.select("query_id", "id", "type", "canonical_name", F.col("v.via").alias("via"), F.col("m.matched").alias("matched"), "score"), k)


def top_matches(matches: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.length("canonical_name"), "id")
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_seeds(hits: DataFrame) -> DataFrame:
    """Only the hits with the question's largest score are expanded."""
    w = Window.partitionBy("query_id")
    return hits.withColumn("top", F.max("score").over(w)).where("score = top").drop("top")


def graph_expand(seeds: DataFrame, relations: DataFrame, depth: int = 1, rel_types: list[str] | None = None, direction: str = "both") -> DataFrame:
    """query_id, seed, id, src, rel_type, dst, depth: the edges within `depth` (1 to 3) steps of each seed.

    seeds: query_id, seed. An edge comes once, with the first level that saw it; nodes are visited once, so cycles end.
    Relations without an id column give null ids.
    """
    depth = min(3, max(1, depth))
    rels = relations if not rel_types else relations.where(F.col("rel_type").isin(rel_types))
    rels = rels.select(F.col("id") if "id" in rels.columns else F.lit(None).cast("long").alias("id"), "src", "rel_type", "dst")
    out_way = rels.withColumn("node", F.col("src")).withColumn("next", F.col("dst"))
    in_way = rels.withColumn("node", F.col("dst")).withColumn("next", F.col("src"))
    steps = {"out": out_way, "in": in_way, "both": out_way.unionByName(in_way)}[direction]
    frontier = bounded(seeds.select("query_id", "seed", F.col("seed").alias("node")).distinct(), "frontier")
    visited, found = frontier, None
    for level in range(1, depth + 1):
        hop = frontier.join(steps, "node").withColumn("depth", F.lit(level))
        edges = hop.select("query_id", "seed", "id", "src", "rel_type", "dst", "depth")
        found = edges if found is None else found.unionByName(edges)
        if level < depth:
            frontier = hop.select("query_id", "seed", F.col("next").alias("node")).distinct().join(visited, ["query_id", "seed", "node"], "left_anti")
            visited = visited.unionByName(frontier)
    return found.groupBy("query_id", "seed", "src", "rel_type", "dst").agg(F.min("depth").alias("depth"), F.min("id").alias("id"))


def _reach(edges: DataFrame, frontier: DataFrame, direction: str) -> DataFrame:
    """query_id, seed, node: where the edges of a frontier lead."""
    ways = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    return reduce(DataFrame.unionByName, [edges.select(F.col(near).alias("node"), F.col(far).alias("next")).join(frontier, "node").select("query_id", "seed", F.col("next").alias("node")) for near, far in ways])


def expand_by_nodes(seeds: DataFrame, relations: DataFrame, depth: int = 1, rel_types: list[str] | None = None, direction: str = "both") -> DataFrame:
    """What adjacency.walk gives, from the relations themselves, for few seeds that reach much of the graph.

    An edge's depth follows from the distances of its ends, so only nodes are walked, level by level, and kept; what the nodes of
    all levels but the last reach is never written. Each edge then meets the list of seeds that reach one end and that of the
    other, one row a node, and no edges are grouped. A node's list has a place a seed, so for very many seeds adjacency.walk serves.
    """
    depth = min(3, max(1, depth))
    rels = relations if not rel_types else relations.where(F.col("rel_type").isin(rel_types))
    own = F.min("id") if "id" in rels.columns else F.lit(None).cast("long")
    edges = rels.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "rel_type", "dst").agg(own.alias("id"))
    if depth > 1:
        edges = keep(edges, "edges")
    reached = keep(seeds.select("query_id", "seed", F.col("seed").alias("node"), F.lit(0).alias("far")).where("node IS NOT NULL").distinct(), "reached")
    for level in range(1, depth):
        frontier = bounded(reached.where(F.col("far") == level - 1).drop("far"), "frontier", MOST_NODES)
        following = _reach(edges, frontier, direction).distinct().withColumn("far", F.lit(level))
        reached = keep(reached.unionByName(following).groupBy("query_id", "seed", "node").agg(F.min("far").alias("far")), "reached")
    lists = bounded(reached.groupBy("node").agg(F.collect_list(F.struct("query_id", "seed", "far")).alias("by")), "lists", MOST_NODES)
    by = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    for end in by:
        edges = edges.join(lists.toDF(end, f"by_{end}"), end, "left")
    found = F.col(f"by_{by[0]}")
    if direction == "both":
        edges = edges.withColumn("by", F.sort_array(F.concat("by_src", "by_dst")))  # null unless both ends are reached
        before = lambda i: F.get(F.col("by"), i - 1)
        least = F.filter("by", lambda x, i: (i == 0) | (x["seed"] != before(i)["seed"]) | ~x["query_id"].eqNullSafe(before(i)["query_id"]))  # of a seed's two distances
        found = F.when(F.col("by").isNotNull(), least).otherwise(F.coalesce("by_src", "by_dst"))
    rows = edges.select("src", "rel_type", "dst", "id", F.explode(found).alias("s"))
    return rows.select("s.query_id", "s.seed", "src", "rel_type", "dst", (F.col("s.far") + 1).alias("depth"), "id")


def named(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """edges with the type and name of both ends."""
    e = entities.select("id", "type", "canonical_name")
    return edges.join(e.toDF("src", "src_type", "src_name"), "src").join(e.toDF("dst", "dst_type", "dst_name"), "dst")


def named_few(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """What named() gives, for edges that may be few beside the entities: only the entities at their ends are joined with them."""
    edges = keep(edges, "edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return named(edges, keep(entities.select("id", "type", "canonical_name").join(bounded(ends, "ends"), "id"), "end-names"))


def relation_scan(relations: DataFrame, entities: DataFrame, rel_types: list[str], filter_side: str | None = None, filter_key: str | None = None, filter_value: str | None = None) -> DataFrame:
    """The named edges of the given types, filtered on a property of one end. Missing properties raise, they don't pass."""
    out = named(relations.where(F.col("rel_type").isin(rel_types)), entities)
    if filter_side:
        if "properties" not in entities.columns:
            raise ValueError("entities have no properties to filter on")
        value = F.get_json_object("properties", f"$.{filter_key}") if dict(entities.dtypes)["properties"] == "string" else F.try_element_at("properties", F.lit(filter_key))
        fit = entities.where(value == filter_value).select(F.col("id").alias({"source": "src", "target": "dst"}[filter_side]))
        out = out.join(fit, fit.columns[0], "left_semi")
    return out


def degree_ranking(edges: DataFrame, side: str = "target") -> DataFrame:
    """entity_id, name, type, count, rank (1 2 2 4), tied: over all edges, ordered by count, then id."""
    end = {"source": "src", "target": "dst"}[side]
    counts = edges.groupBy(F.col(end).alias("entity_id"), F.col(f"{end}_name").alias("name"), F.col(f"{end}_type").alias("type")).agg(F.count("*").alias("count"))
    same = counts.groupBy("count").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    places = same.withColumn("rank", (F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).cast("int"))  # one row a distinct count
    return counts.join(places, "count").select("entity_id", "name", "type", "count", "rank", (F.col("n") > 1).alias("tied"))


def ranking_candidates(ranking: DataFrame, rel_type: str, top: int = 5) -> DataFrame:
    text = F.concat(F.lit("[그래프 집계] "), "name", F.lit(" ("), "type", F.lit(") — "), relation_label(F.lit(rel_type)), F.lit(" "), F.col("count").cast("string"), F.lit("건, "), F.when(F.col("tied"), "공동 ").otherwise(""), F.col("rank").cast("string"), F.lit("위"))
    first = ranking.orderBy(F.desc("count"), "entity_id").limit(top)
    return first.select(entity_key(F.col("type"), F.col("entity_id")).alias("canonical_key"), text.alias("text"), "count", "rank", "tied", "entity_id")


def edge_candidates(edges: DataFrame, seed: Column | None = None) -> DataFrame:
    """Candidates of named edges, keyed by the end that answers: not the seed's, the destination without one."""
    by_source = (F.col("dst") == seed) if seed is not None else F.lit(False)
    text = F.concat(F.lit("[그래프] "), "src_name", F.lit("의 "), relation_label(F.col("rel_type")), F.lit(": "), "dst_name", F.lit(" ("), "src_type", F.lit("→"), "dst_type", F.lit(", "), "rel_type", F.lit(")"))
    key = F.when(by_source, entity_key(F.col("src_type"), F.col("src"))).otherwise(entity_key(F.col("dst_type"), F.col("dst")))
    return edges.withColumn("canonical_key", key).withColumn("text", text)


def ontology_candidates(hits: DataFrame) -> DataFrame:
    text = F.concat(F.lit("[온톨로지] "), "canonical_name", F.lit(" ("), "type", F.lit(", "), "via", F.lit(": "), "matched", F.lit(")"))
    return hits.withColumn("canonical_key", entity_key(F.col("type"), F.col("id"))).withColumn("text", text)


def neighbors(seeds: DataFrame, relations: DataFrame, entities: DataFrame, rel: str, direction: str = "out") -> DataFrame:
    """query_id, name of what a relation reaches from each seed."""
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    hop = seeds.join(relations.where(F.col("rel_type") == rel), F.col("seed") == F.col(near)).select("query_id", F.col(far).alias("id"))
    return hop.join(entities.select("id", "canonical_name"), "id").select("query_id", F.col("canonical_name").alias("name")).distinct()


def two_hop(seeds: DataFrame, relations: DataFrame, entities: DataFrame, rel1: str, dir1: str, rel2: str, dir2: str) -> DataFrame:
    near, far = ("src", "dst") if dir1 == "out" else ("dst", "src")
    hop = seeds.join(relations.where(F.col("rel_type") == rel1), F.col("seed") == F.col(near)).select("query_id", F.col(far).alias("seed")).distinct()
    return neighbors(hop, relations, entities, rel2, dir2).distinct()


def argmax(relations: DataFrame, entities: DataFrame, rel: str, over: str) -> DataFrame:
    """name, count of all ends that share the largest degree."""
    return degree_ranking(relation_scan(relations, entities, [rel]), over).where("rank = 1").select("name", "count")
