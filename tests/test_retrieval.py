"""Retrieval for many questions: the same as one by one, and lanes that fail apart."""

import pytest
from pyspark.sql import functions as F

from wayfind.engine import Engine
from wayfind.operators import adjacency, fusion, graph, retrieval
from wayfind.sources import kg, sinks


@pytest.fixture(scope="module")
def world(spark):
    ents = spark.createDataFrame([(1, "product", "Product-C1"), (2, "product", "Product-C2"), (3, "client", "Client-A"), (4, "employee", "김철수"), (5, "client", "Hub")], "id long, type string, canonical_name string")
    als = spark.createDataFrame([(1, "prod_1"), (3, "acme"), (5, "ab")], "entity_id long, alias string")
    rels = spark.createDataFrame([(1, 3, "USES", 1), (2, 3, "USES", 2), (3, 4, "MANAGES_ACCOUNT", 3)] + [(10 + i, 5, "USES", 1 + i % 2) for i in range(2)], "id long, src long, rel_type string, dst long")
    docs = spark.createDataFrame([(1, "guide to product version one"), (2, "the client has a contract"), (3, "nothing here"), (4, None)], "doc_id long, text string")
    links = spark.createDataFrame([("vector", 1, 1), ("vector", 2, 3)], "source_kind string, document_id long, entity_id long")
    return {"documents": docs, "entities": ents, "aliases": als, "relations": rels, "links": links, "steps": adjacency.adjacency(rels)}


ASKED = [(1, "Client-A uses what product version"), (2, "ab"), (3, "Product-C1 acme"), (4, ""), (5, None), (6, "acme 담당 김철수"), (7, "Client-A uses what product version"), (8, "x_1 o a_b")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id long, query string")


def test_terms_meet_once(asked, world):
    """Each distinct term keeps its best only, and short terms meet in the same join."""
    one = graph.ontology_search(asked, world["entities"], world["aliases"], 3)
    many = graph.ontology_search_many(asked, world["entities"], world["aliases"], 3)
    cols = ["query_id", "id", "type", "canonical_name", "via", "matched", "score", "rank"]
    assert sorted(many.select(cols).collect()) == sorted(one.select(cols).collect()) != []
    assert "NestedLoop" not in one._jdf.queryExecution().executedPlan().toString()


def test_lists_are_those_of_plain_code(asked, world):
    hits = {}
    for r in graph.ontology_search(asked, world["entities"], world["aliases"], 5).collect():
        hits.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    types = {r["id"]: r["type"] for r in world["entities"].collect()}
    rels = sorted((r["rel_type"], r["src"], r["dst"]) for r in world["relations"].collect())
    want = {}
    for q, found in hits.items():
        keys = [i for _, i in sorted(found)]
        for seed in keys[:3]:
            keys = keys + [s if d == seed else d for _, s, d in rels if seed in (s, d)]
        want[q] = [f"entity:{types[i]}#{i}" for i in keys]
    got = {}
    for r in retrieval.graph_list(asked, world["entities"], world["aliases"], world["steps"]).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["key"])
    assert got == want and len(want) > 3
    absent = retrieval.graph_list(asked, world["entities"], world["aliases"], world["steps"], absent=True)
    assert {r[0] for r in absent.where(F.startswith("key", F.lit("unresolved#"))).select("query_id").collect()} == {q for q, _ in ASKED} - set(want)


def test_kg_retrieve_many_goes_on_without_vectors(spark, asked, world):
    def broken(texts):
        raise ConnectionError("no vectors today")

    def picky(texts):
        if any("Product-C1" in t for t in texts):
            raise ValueError("this text is refused")
        return [[1.0, float(len(t))] for t in texts]

    plain = {k: world[k] for k in ("entities", "aliases", "steps", "links")}
    both = retrieval.kg_retrieve_many(asked, world["documents"], **plain)
    assert both.failures.isEmpty() and set(both.lists) == {"vector", "graph"}
    agreed = {r["query_id"]: r["agreed"] for r in fusion.agreement(fusion.rrf_named(both.ranked())).collect()}
    assert agreed[1] == agreed[7] > 0
    docs = world["documents"].withColumn("embedding", F.array(F.lit(1.0), F.col("doc_id").cast("double")))
    down = retrieval.kg_retrieve_many(asked, docs, embedder=broken, dim=2, **plain)
    assert {(r["query_id"], r["lane"], r["error"]) for r in down.failures.collect()} == {(q, "vector", "no vectors today") for q, _ in ASKED}
    assert down.lists["graph"].count() == both.lists["graph"].count() > 0
    some = retrieval.kg_retrieve_many(asked, docs, embedder=picky, dim=2, **plain)
    assert [(r["query_id"], r["error"]) for r in some.failures.collect()] == [(3, "this text is refused")]
    assert {r[0] for r in some.lists["vector"].select("query_id").distinct().collect()} == {q for q, _ in ASKED} - {3}
    gone = retrieval.kg_retrieve_many(asked, docs.drop("text"), embedder=picky, dim=2, **plain)  # the lane as a whole
    assert set(gone.lists) == {"graph"} and gone.failures.count() == len(ASKED)


def test_retrieve_many(spark, world):
    rows = [(1, "Client-A와 연결된 제품"), (2, "설치 guide 설명해줘"), (3, "전체 주문 건수는 몇 개야"), (4, "안녕"), (5, "Client-Z와 연결된 제품")]
    asked = spark.createDataFrame(rows, "query_id long, query string")
    spark.createDataFrame([(1,), (2,)], "id int").createOrReplaceTempView("retrieved_orders")
    statements = spark.createDataFrame([(3, "SELECT count(*) AS n FROM retrieved_orders"), (4, "SELECT nothing FROM nowhere")], "query_id long, sql string")
    whole = {k: world[k] for k in ("documents", "entities", "aliases", "steps", "links")}

    def falls(mine):
        raise RuntimeError("the lane is broken")

    out = retrieval.retrieve_many(asked, **whole, statements=statements, extra={"other": falls}, budget=64)
    got = {r["query_id"]: r for r in out.contexts.collect()}
    assert len(got) == 5 and all("other: the lane is broken" in r["errors"] for r in got.values())
    assert got[1]["route"] == "graph" and "Product-C1" in got[1]["context"]
    assert "guide to product" in got[2]["context"]
    assert "n=2" in got[3]["context"]
    assert any(e.startswith("sql: ") for e in got[4]["errors"]) and not any(e.startswith("sql: ") for e in got[3]["errors"])
    assert "찾지 못했습니다" in got[5]["context"]
    assert all(r["tokens_used"] <= 64 for r in got.values())
    nothing = retrieval.retrieve_many(asked, statements=statements.limit(0), extra={"other": falls})
    assert all(r["context"] == "" and r["errors"] for r in nothing.contexts.collect())


def test_engine_goes_on_without_vectors(spark, world):
    def broken(text):
        raise ConnectionError("no vectors today")

    docs = world["documents"].withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    engine = Engine(spark, docs, world["entities"], world["aliases"], world["relations"], embedder=broken, vector_dim=2)
    with pytest.raises(ConnectionError):
        engine.kg_retrieve("Client-A")
    errors = []
    assert {tuple(r["sources"]) for r in engine.kg_retrieve("Client-A", errors=errors).collect()} == {("graph",)} and errors == ["vector: no vectors today"]
    asked = spark.createDataFrame([(1, "Client-A와 연결된 제품"), (2, "설치 guide 설명해줘")], "query_id long, query string")
    got = {r["query_id"]: r for r in engine.retrieve_many(asked, statements=spark.createDataFrame([], "query_id long, sql string")).contexts.collect()}
    assert "Product-C1" in got[1]["context"] and got[2]["errors"] == ["vector: no vectors today"]


def gathered(plan):
    """The parts of a plan that are sent to all tasks."""
    lines, out = plan.splitlines(), []
    deep = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(k + 1, len(lines)) if deep(lines[j]) <= deep(line)), len(lines))
            out.append("\n".join(lines[k:end]))
    return out


def test_names_are_never_gathered(spark, small, monkeypatch):
    """Names are many once they are cut into runs, whatever the size of their files: the terms go to them, or both are merged."""
    asked = spark.createDataFrame([(1, "customer_7"), (2, "nation_1 BUILDING")], "query_id int, query string")
    ents, als = kg.entities(spark, small), kg.aliases(spark, small)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, want = [], None

    def kept(df, name, keep=sinks.keep):
        plans.append(plan(df))
        return keep(df, name)

    monkeypatch.setattr(sinks, "keep", kept)
    for runs, rows in ((5000, 100_000), (0, 100_000), (0, 0)):
        monkeypatch.setattr(graph, "MOST_RUNS", runs, raising=False)
        monkeypatch.setattr(graph, "bounded", lambda df, name, rows=rows: sinks.bounded(df, name, rows), raising=False)
        found = graph.ontology_search(asked, ents, als)
        plans.append(plan(found))
        got = sorted(map(tuple, found.collect()))
        want = want or got
        assert got == want and got
    assert not any("Union" in part for p in plans for part in gathered(p))


def test_summaries_are_those_of_the_lists(asked, world):
    """What kg_summary_many looks up a seed at a time is what the written lists give, by fusing them."""
    plain = {k: world[k] for k in ("entities", "aliases", "steps", "links")}
    lists = retrieval.kg_retrieve_many(asked, world["documents"], **plain).ranked()
    sizes = {r["query_id"]: (r["v"], r["g"]) for r in lists.groupBy("query_id").agg(F.count(F.when(F.col("source") == "vector", 1)).alias("v"), F.count(F.when(F.col("source") == "graph", 1)).alias("g")).collect()}
    fused: dict = {}
    for r in sorted(fusion.rrf_named(lists).collect(), key=lambda r: r["rank"]):
        fused.setdefault(r["query_id"], []).append((r["key"], len(r["sources"])))
    want = {q: (*sizes[q], len(rows), sum(n > 1 for _, n in rows), [key for key, _ in rows[:2]]) for q, rows in fused.items()}
    got = {r[0]: tuple(r[1:]) for r in retrieval.kg_summary_many(asked, world["documents"], **plain, best=2).collect()}
    assert got == want and any(row[3] for row in got.values())


def test_a_term_with_a_run_of_no_name_is_dropped(spark, world, monkeypatch):
    met = {}

    def bounded(df, name, most=100_000):
        met[name] = [tuple(r) for r in df.collect()]
        return df

    monkeypatch.setattr(graph, "bounded", bounded)
    terms = spark.createDataFrame([(1, "product-c1"), (1, "products"), (2, "duct-z")], "query_id int, term string")
    assert [r["id"] for r in graph.match_terms(terms, world["entities"], world["aliases"]).collect()] == [1]
    assert [r[1] for r in met["rarest-runs"]] == ["product-c1"]


def test_edges_at_seeds_are_those_of_the_walk(spark, small, monkeypatch):
    """Without an adjacency of the whole graph, sent to all tasks or merged: hubs, both ends of an edge, and seeds that are not there."""
    ids = [kg.OFFSETS["region"] + 1, kg.OFFSETS["nation"] + 3, kg.OFFSETS["supplier"] + 2, kg.OFFSETS["customer"] + 7, kg.OFFSETS["part"] + 5, kg.OFFSETS["part"] + 6, 5]
    seeds = spark.createDataFrame([(i,) for i in [*ids, None]], "seed long")
    cols = ["seed", "src", "rel_type", "dst", "depth"]
    steps = adjacency.adjacency(kg.relations(spark, small))
    want = sorted(map(tuple, adjacency.walk(steps, seeds.select(F.lit(0).alias("query_id"), "seed")).select(cols).collect()))
    assert {kind for _, _, kind, _, _ in want} == {"IN_REGION", "IN_NATION", "SUPPLIES", "ORDERED"}
    for most in (100_000, 0):
        monkeypatch.setattr(kg, "bounded", lambda df, name, most=most: sinks.bounded(df, name, most))
        assert sorted(map(tuple, kg.relations_at(spark, small, seeds).select(cols).collect())) == want


def test_matches_behind_the_best_are_left_out_before_grouping(spark, small, monkeypatch):
    """A term in the names of all customers groups a few of them, not all, and the hits are those of one question at a time."""
    asked = spark.createDataFrame([(1, "er customer st"), (2, "BUILDING cu"), (3, "Customer#000000007 er")], "query_id int, query string")
    ents, als, grouped = kg.entities(spark, small), kg.aliases(spark, small), []
    cols = ["query_id", "id", "type", "canonical_name", "via", "matched", "score", "rank"]
    want = sorted(graph.ontology_search(asked, ents, als, 3).select(cols).collect())

    def bounded(df, name):
        out = sinks.bounded(df, name)
        grouped.extend([out.count()] if name == "matches" else [])
        return out

    monkeypatch.setattr(graph, "bounded", bounded)
    assert sorted(graph.ontology_search_many(asked, ents, als, 3).select(cols).collect()) == want
    assert len(grouped) == 1 and grouped[0] <= 6 * 4 * 3
