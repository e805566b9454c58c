"""Retrieval for many questions in one keyed plan: query_id goes through every lane, and what fails is a row.

questions: query_id, query. A lane is a ranked list (query_id, rank, key, source, text). A lane that fails as a whole leaves
the others, and a row (query_id, lane, error) for each of its questions; a question that fails alone leaves one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.operators import adjacency, curate, fusion, graph, keyword, router, sql_lane, vector
from wayfind.operators.places import places
from wayfind.sources.sinks import keep

LIST = ["query_id", "rank", "key", "source", "text"]


@dataclass
class Lanes:
    """lists: by name, in the order in which they are fused. failures: query_id, lane, error."""

    lists: dict[str, DataFrame]
    failures: DataFrame

    def ranked(self) -> DataFrame:
        """All lists as input of fusion: with list_idx, the place of the lane."""
        return reduce(DataFrame.unionByName, [df.withColumn("list_idx", F.lit(i)) for i, df in enumerate(self.lists.values())])


def _reason(e: Exception) -> str:
    return (str(e).strip() or type(e).__name__).splitlines()[0][:300]


def run_lanes(questions: DataFrame, lanes: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]], asked: dict[str, DataFrame] | None = None) -> Lanes:
    """Each lane is a function of its questions (asked: those of a lane, if not all) to a list and failures of single
    questions (query_id, error) or None. A lane's list is written before the next begins, so that what is broken in it shows there."""
    lists, failures = {}, [questions.select("query_id", F.lit("").alias("lane"), F.lit("").alias("error")).limit(0)]
    for name, make in lanes.items():
        mine = (asked or {}).get(name, questions)
        try:
            found, failed = make(mine)
            lists[name] = keep(found.select(*LIST), f"lane-{name}")
            if failed is not None:
                failures.append(keep(failed.select("query_id", F.lit(name).alias("lane"), "error"), f"failures-{name}"))
        except Exception as e:
            failures.append(mine.select("query_id", F.lit(name).alias("lane"), F.lit(_reason(e)).alias("error")))
    return Lanes(lists, reduce(DataFrame.unionByName, failures))


def vector_hits(questions: DataFrame, documents: DataFrame, k: float = 5, embedder: Callable[[list[str]], list] | None = None, dim: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Hits (query_id, doc_id, score, rank) and failures (query_id, error).

    Equal questions are embedded and searched once. embedder: takes a list of texts; without one, vectors are hashed terms.
    """
    rows = questions.select("query_id", F.coalesce("query", F.lit("")).alias("query"))
    once = keep(rows.groupBy("query").agg(F.min("query_id").alias("first")), "asked")
    failed = None
    if embedder:
        vectors = keep(vector.embed_rows(once, embedder, dim, "first", "query", strict=False), "asked-vectors")
        asked, docs = vectors.where("error IS NULL").select("first", "embedding"), documents.select("doc_id", "embedding")
        back = rows.join(once, "query").select("query_id", "first")
        failed = back.join(vectors.where("error IS NOT NULL").select("first", "error"), "first").select("query_id", "error")
        hits = vector.cosine_topk_many(docs, asked, k, "doc_id", query_col="first")
    else:
        hits = vector.hash_topk(documents.select("doc_id", "text"), once.withColumnRenamed("first", "query_id"), k).withColumnRenamed("query_id", "first")
    found = rows.join(once, "query").select("query_id", "first").join(hits, "first").drop("first")
    return found, failed


def vector_list(hits: DataFrame, documents: DataFrame, links: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Hits with their texts, keyed by the entity that a link names, or by document."""
    texts = hits.join(documents.select("doc_id", "text"), "doc_id")
    own = F.concat(F.lit("documents#"), F.col("doc_id").cast("string"))
    keyed = texts.withColumn("canonical_key", own) if links is None else fusion.bridge(texts, links, entities)
    return keyed.select("query_id", "rank", F.col("canonical_key").alias("key"), F.lit("vector").alias("source"), "text")


def graph_parts(questions: DataFrame, entities: DataFrame, aliases: DataFrame, steps: DataFrame | Callable[[DataFrame], DataFrame], k: int = 5, expand: int = 3, depth: int = 1, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What graph_list is made of, each once: the entities that a question names; its seeds (query_id, seed, at, n edges,
    `before` them those of its seeds before, entities named); the edges of each seed with their places.

    steps: rows of adjacency(), or a function of distinct seeds (seed) to their edges (seed, src, rel_type, dst, depth), where no
    adjacency is at hand and the seeds are few."""
    hits = keep(graph.ontology_search_many(questions, entities, aliases, k), "hits")
    seeds = keep(hits.where(F.col("rank") <= expand).select("query_id", F.col("id").alias("seed"), F.col("rank").alias("at")), "seeds")
    once = seeds.select(F.lit(0).alias("query_id"), "seed").distinct()
    walked = steps(once.select("seed")) if callable(steps) else adjacency.walk(steps, once, depth).drop("query_id")
    order = [F.col(c) for c in ("depth", "rel_type", "src", "dst")]
    edges = places(walked, order, ("seed",))
    edges = keep(edges if most is None else edges.where(F.col("place") <= most), "edges")
    counts = edges.groupBy("seed").agg(F.count("*").alias("n"))
    per_question = Window.partitionBy("query_id")
    starts = seeds.join(counts, "seed", "left").withColumn("before", F.coalesce(F.sum("n").over(per_question.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return hits, starts.join(hits.groupBy("query_id").agg(F.count("*").alias("named")), "query_id"), edges


def graph_list(questions: DataFrame, entities: DataFrame, aliases: DataFrame, steps: DataFrame, k: int = 5, expand: int = 3, depth: int = 1, absent: bool = False, most: int | None = None) -> DataFrame:
    """The k entities that each question names, then what the first `expand` of them have edges to.

    steps: rows of adjacency(). Each seed is walked once, whatever number of questions name it, and its edges get their
    places among themselves (depth, relation, source, destination), by ranges where a seed is a hub. A question's places
    follow from those and from how many edges its seeds before have, so no question's list is sorted. most: edges of a seed at most
    (None: all). absent: a question that names nothing has one row that says so.
    """
    hits, starts, edges = graph_parts(questions, entities, aliases, steps, k, expand, depth, most)
    texts = graph.edge_candidates(graph.named(edges, entities), F.col("seed")).select("seed", "place", "canonical_key", "text")
    facts = starts.join(texts, "seed").select("query_id", (F.col("named") + F.col("before") + F.col("place")).alias("rank"), F.col("canonical_key").alias("key"), "text")
    out = graph.ontology_candidates(hits).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("canonical_key").alias("key"), "text").unionByName(facts)
    if absent:
        none = questions.join(hits.select("query_id").distinct(), "query_id", "left_anti").withColumn("terms", graph.T.seed_terms(F.col("query")))
        text = F.concat(F.lit("[그래프] 질의에 등장한 대상("), F.array_join("terms", ", "), F.lit(")을 지식그래프에서 찾지 못했습니다."))
        out = out.unionByName(none.select("query_id", F.lit(1).cast("long").alias("rank"), F.concat(F.lit("unresolved#"), F.array_join("terms", "+")).alias("key"), text.alias("text")))
    return out.withColumn("source", F.lit("graph"))


def kg_retrieve_many(questions: DataFrame, documents: DataFrame, entities: DataFrame, aliases: DataFrame, steps: DataFrame, links: DataFrame | None = None, k: int = 5, expand: int = 3, embedder: Callable[[list[str]], list] | None = None, dim: int | None = None) -> Lanes:
    """The vector and the graph list of each question; fuse them with fusion.rrf_named(lanes.ranked())."""

    def by_vector(asked: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        hits, failed = vector_hits(asked, documents, k, embedder, dim)
        return vector_list(hits, documents, links, entities), failed

    return run_lanes(questions, {"vector": by_vector, "graph": lambda asked: (graph_list(asked, entities, aliases, steps, k, expand), None)})


def kg_summary_many(questions: DataFrame, documents: DataFrame, entities: DataFrame, aliases: DataFrame, steps: DataFrame | Callable[[DataFrame], DataFrame], links: DataFrame | None = None, k: int = 5, expand: int = 3, best: int = 5) -> DataFrame:
    """query_id, n_vector, n_graph (rows of the lists of kg_retrieve_many), fused, agreed (keys, and those in both lists), best
    (the keys of greatest fused score, in order): for each question with a list.

    The graph lists of many questions share seeds, and a seed may be a hub, so none is written out. The keys of a seed's
    edges are kept once a seed, and counted once for each set of seeds that some question has; a question looks up its own
    few keys there. Among the best can be only its vector keys and the first `best` others of its graph list, and those
    are among the first `best` + 2 k keys of each seed.
    """
    vector = keep(vector_list(vector_hits(questions, documents, k)[0], documents, links, entities).select("query_id", "rank", "key"), "vector-keys")
    hits, starts, edges = graph_parts(questions, entities, aliases, steps, k, expand)
    hits, starts = hits.select("query_id", "rank", graph.entity_key(F.col("type"), F.col("id")).alias("key")), keep(starts.select("query_id", "seed", (F.col("named") + F.col("before")).alias("before")), "starts")
    facts = graph.edge_candidates(graph.named_few(edges, entities), F.col("seed")).groupBy("seed", F.col("canonical_key").alias("key")).agg(F.min("place").alias("place"), F.count("*").alias("n"))
    facts = keep(facts.withColumn("nth", F.row_number().over(Window.partitionBy("seed").orderBy("place"))), "seed-keys")
    # How many keys the seeds of a question lead to, by set of seeds.
    sets = keep(starts.groupBy("query_id").agg(F.array_sort(F.collect_list("seed")).alias("seeds")), "seed-sets")
    union = sets.select("seeds").distinct().select("seeds", F.explode("seeds").alias("seed")).join(facts.select("seed", "key"), "seed").select("seeds", "key").distinct()
    reached = sets.join(union.groupBy("seeds").agg(F.count("*").alias("reached")), "seeds", "left").select("query_id", F.coalesce("reached", F.lit(0)).alias("reached"))
    sizes = facts.groupBy("seed").agg(F.sum("n").alias("n"))
    listed = hits.groupBy("query_id").agg(F.count("*").alias("named")).join(starts.join(sizes, "seed").groupBy("query_id").agg(F.sum("n").alias("edges")), "query_id", "left")
    # Where a question's own keys stand in its graph list, at first.
    own = vector.select("query_id", "key").unionByName(hits.select("query_id", "key")).distinct()
    through = own.join(starts, "query_id").join(facts.select("seed", "key", "place"), ["seed", "key"]).groupBy("query_id", "key").agg(F.min(F.col("before") + F.col("place")).alias("through"))
    named = hits.groupBy("query_id", "key").agg(F.min("rank").cast("long").alias("named_at"))
    given = vector.groupBy("query_id", "key").agg(F.min("rank").cast("long").alias("given_at"))
    own = own.join(through, ["query_id", "key"], "left").join(named, ["query_id", "key"], "left").join(given, ["query_id", "key"], "left")
    own = keep(own.withColumn("graph_at", F.least("named_at", "through")), "own-keys")  # least passes over nulls
    more = F.sum((F.col("through").isNull() & (F.col("named_at").isNotNull() | F.col("given_at").isNotNull())).cast("long"))  # keys that no edge leads to
    counts = own.groupBy("query_id").agg(more.alias("more"), F.count(F.when(F.col("graph_at").isNotNull() & F.col("given_at").isNotNull(), 1)).alias("agreed"))
    first = starts.join(facts.where(F.col("nth") <= best + 2 * k), "seed").select("query_id", F.lit(1).alias("list_idx"), (F.col("before") + F.col("place")).alias("rank"), "key")
    found = own.where("graph_at IS NOT NULL").select("query_id", F.lit(1).alias("list_idx"), F.col("graph_at").alias("rank"), "key").unionByName(first)
    found = found.unionByName(own.where("given_at IS NOT NULL").select("query_id", F.lit(0).alias("list_idx"), F.col("given_at").alias("rank"), "key"))
    named_lists = found.withColumn("source", F.when(F.col("list_idx") == 0, "vector").otherwise("graph")).withColumn("text", F.lit(None).cast("string"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.size("sources")), "key")
    top = fusion.named_scores(named_lists).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    top = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("best"))
    out = counts.join(reached, "query_id", "left").join(listed, "query_id", "left").join(vector.groupBy("query_id").agg(F.count("*").alias("n_vector")), "query_id", "left").join(top, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("query_id", zero("n_vector").alias("n_vector"), (zero("named") + zero("edges")).alias("n_graph"), (zero("reached") + F.col("more")).alias("fused"), "agreed", "best")


def sql_list(questions: DataFrame, statements: DataFrame, views: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of each question's statement (statements: query_id, sql), and the questions whose statement fails.

    A distinct statement runs once, as a job of its own, and its rows (at most the row cap of sql_query) are given to
    all questions that ask for it. Questions whose statement is null have no rows.
    """
    spark = questions.sparkSession
    mine = keep(questions.select("query_id").join(statements.where(F.col("sql").isNotNull()), "query_id"), "statements")
    rows, failed, kinds = [], [], "sql string, rank int, key string, text string"
    answers = [spark.createDataFrame([], kinds)]
    for (sql,) in mine.select("sql").distinct().toLocalIterator():
        result = sql_lane.sql_query(spark, sql, views) if views is not None else sql_lane.sql_query(spark, sql)
        if not result.ok:
            failed.append((sql, result.error))
        for i, r in enumerate(result.rows or []):
            rows.append((sql, i + 1, f"sql#{i}", f"[{sql}] " + " | ".join(f"{c}={'null' if v is None else v}" for c, v in r.items())))
        if len(rows) >= 10_000:  # what the driver holds is bounded, however many statements there are
            answers.append(keep(spark.createDataFrame(rows, kinds), "answers"))
            rows = []
    answers = reduce(DataFrame.unionByName, [*answers, spark.createDataFrame(rows, kinds)])
    broken = spark.createDataFrame(failed, "sql string, error string")
    return mine.join(answers, "sql").select("query_id", "rank", "key", F.lit("sql").alias("source"), "text"), mine.join(broken, "sql").select("query_id", "error")


@dataclass
class RetrievedMany:
    """contexts: query_id, route, tools, kept, dropped, tokens_used, context, errors. fused: query_id, key, score, sources, text, rank."""

    contexts: DataFrame
    fused: DataFrame
    failures: DataFrame


def retrieve_many(questions: DataFrame, documents: DataFrame | None = None, entities: DataFrame | None = None, aliases: DataFrame | None = None, steps: DataFrame | None = None, keyword_index: DataFrame | None = None, links: DataFrame | None = None, statements: DataFrame | None = None, lexicon: DataFrame | None = None, pairs: DataFrame | None = None, budget: int = 256, k: int = 5, top: int = 200, embedder: Callable[[list[str]], list] | None = None, dim: int | None = None, extra: dict[str, Callable] | None = None) -> RetrievedMany:
    """Route, run the lanes that each question's tools name, fuse, and choose what fits the budget: for all questions at once.

    top: places of the fused list that go on to the choice. statements: query_id, sql; without, the template rules make them.
    extra: further lanes over all questions. A question all of whose lanes fail has an empty context and its errors.
    """
    routed = keep(router.route(questions, lexicon, pairs).select("query_id", "query", "route", "tools"), "routed")
    of = lambda tool: routed.where(F.array_contains("tools", tool)).select("query_id", "query")
    lanes: dict[str, Callable] = {}
    asked = {"sql": of(router.SQL), "vector": of(router.VECTOR), "keyword": of(router.VECTOR), "graph": of(router.GRAPH)}
    made = statements if statements is not None else routed.select("query_id", sql_lane.template_sql(F.col("query")).alias("sql"))
    lanes["sql"] = lambda mine: sql_list(mine, made)
    if documents is not None:

        def by_vector(mine: DataFrame) -> tuple[DataFrame, DataFrame | None]:
            hits, failed = vector_hits(mine, documents, k, embedder, dim)
            return vector_list(hits, documents, links, entities), failed

        def by_word(mine: DataFrame) -> tuple[DataFrame, None]:
            return vector_list(keyword.keyword_search(keyword_index, mine, k), documents).withColumn("source", F.lit("keyword")), None

        lanes["vector"] = by_vector
        if keyword.has_index(keyword_index):
            lanes["keyword"] = by_word
    if entities is not None:
        lanes["graph"] = lambda mine: (graph_list(mine, entities, aliases, steps, k, absent=True), None)
    lanes |= extra or {}
    found = run_lanes(routed.select("query_id", "query"), lanes, asked)
    failures = keep(found.failures, "failures")
    if found.lists:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.size("sources")), "key")
        fused = keep(fusion.named_scores(found.ranked()).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top), "fused")
    else:
        fused = questions.sparkSession.createDataFrame([], "query_id long, key string, score double, sources array<string>, text string, rank int")
    items = fused.select("query_id", (F.col("rank") - 1).alias("idx"), "text")
    chosen = curate.curate(items, routed.select("query_id", "query"), budget)
    told = failures.groupBy("query_id").agg(F.array_sort(F.collect_list(F.concat("lane", F.lit(": "), "error"))).alias("errors"))
    contexts = routed.select("query_id", "query", "route", "tools").join(chosen, "query_id", "left").join(told, "query_id", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    contexts = contexts.withColumns({"kept": F.coalesce("kept", none("int")), "dropped": F.coalesce("dropped", none("int")), "tokens_used": F.coalesce("tokens_used", F.lit(0)), "context": F.coalesce("context", F.lit("")), "errors": F.coalesce("errors", none("string"))})
    return RetrievedMany(contexts, fused, failures)
