"""Operators of the engine on literal fixtures."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfind.engine import Engine
from wayfind.functions import text as T
from wayfind.functions import vectors as V
from wayfind.operators import audit, claims, curate, evaluate, fusion, graph, keyword, multistep, router, sql_lane, vector
from wayfind.operators.evaluate import MatchOptions, results_match
from wayfind.sources import kg, profile, readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Text


@pytest.mark.parametrize(("text", "n"), [("", 0), (None, 0), ("one", 1), ("가나 ab1 c!", 5), ("é", 1), ("a　b", 2), ("a_b", 2), ("🙂", 1)])
def test_est_tokens(spark, text, n):
    assert one(spark, T.est_tokens(F.lit(text).cast("string"))) == n


def test_content_terms(spark):
    assert one(spark, T.content_terms(F.lit("The 고객사가 of PRICE 고객사를 a1 x"))) == ["고객사", "price", "a1"]


def test_seed_terms(spark):
    assert one(spark, T.seed_terms(F.lit("Product-C1을 사용하는 고객사 Client_A2 a"))) == ["Product-C1", "사용하", "Client_A2"]  # a verb form loses its ending too


@pytest.mark.parametrize(("word", "bare"), [("고객사가", "고객사"), ("서울에서는", "서울"), ("이가", "이가"), ("확인합니다", "확인"), ("product", "product")])
def test_strip_tails(spark, word, bare):
    assert one(spark, T.strip_tails(F.lit(word))) == bare


def test_normalize(spark):
    tokens = one(spark, T.normalize_tokens(F.lit("Product-C1 고객 사 목록")))
    assert tokens[:2] == ["product", "제품"] and {"c1", "productc1", "고객", "고객사", "사목록"} <= set(tokens)
    assert one(spark, T.normalize_tokens(F.lit("ＡＢＣ１２"))) == one(spark, T.normalize_tokens(F.lit("abc12")))
    assert one(spark, T.normalize_tokens(F.lit("x"))) == [] and one(spark, T.normalize_tokens(F.lit(None).cast("string"))) == []
    q = one(spark, T.normalize_query(F.lit("클라이언트를 보여줘")))
    assert q["stripped"] and q["synonyms"] == ["클라이언트 -> 고객사"] and ":*" in q["tsquery"]


def test_fnv1a(spark):
    def plain(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h

    for s in ("", "a", "foobar", "고객사", "é"):
        assert one(spark, T.fnv1a(F.lit(s))) == plain(s)


# Vectors


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.cosine(a, a)) == pytest.approx(1) and one(spark, V.cosine(a, z)) == 0
    assert one(spark, V.truncate(a, 1)) == [1.0] and one(spark, V.truncate(z, 2)) == [0.0, 0.0]
    assert [vector.clamp_k(k) for k in (0, -3, math.nan, 1000, 2.9, None)] == [5, 1, 5, 50, 2, 5]


def test_topk_blocks_agree(spark, monkeypatch):
    rows = [(i, [float((i * k) % 7 - 3) for k in range(1, 9)] if i % 9 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 10 = 1").withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, vector.cosine_topk_many(df, queries, 4).select("query_id", "vec_id", "rank").collect()))
    monkeypatch.setattr(vector, "MOST_QUERY_NUMBERS", 8)
    assert sorted(map(tuple, vector.cosine_topk_many(df, queries, 4).select("query_id", "vec_id", "rank").collect())) == whole
    single = vector.cosine_topk(df, rows[11][1], 4).collect()
    assert [r["vec_id"] for r in single] == [v for q, v, _ in sorted(whole, key=lambda r: (r[0], r[2])) if q == 11]


def test_hash_vectors(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta"), (3, ""), (4, None)], "doc_id long, text string")
    v = vector.hash_vectors(docs, 64)
    assert v.select("doc_id").distinct().count() == 2
    assert v.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).where("abs(n - 1) > 1e-9").isEmpty()
    best = vector.hash_topk(docs, spark.createDataFrame([(7, "alpha beta")], "query_id int, query string"), dim=64).orderBy("rank").collect()
    assert [r["doc_id"] for r in best] == [2, 1] and best[0]["score"] == pytest.approx(1)
    signed = vector._Signed(64)
    for term in ("alpha", "고객", "𝒳y"):  # the last one beyond the basic plane: two units
        h = 2166136261
        for c in np.frombuffer(term.encode("utf-16-le"), "<u2").tolist():
            h = (h ^ c) * 16777619 % (1 << 32)
        assert signed[term] == (h % 64, 1.0 if (h ^ 35) * 16777619 % 2 else -1.0)


def test_content_terms_by_word(spark):
    """The passes over the whole text against the rule a word."""
    import re

    from wayfind.functions import text as T

    texts = ["고객은 제품을 a가b 은 는 는는 에서으로 사용", "the Client한테 x1을 가나다라마로부터 가이", "만만만 도로도로 에서에서 abc에서def", "", None, "A the 있다 있다는 하지만", "é고객é은é"]
    stop = set(T.STOP_WORDS.split())
    want = []
    for t in texts:
        words = [re.sub(f"({T.PARTICLES})$", "", w) for w in re.findall("[가-힣]+|[a-z0-9]+", (t or "").lower())]
        want.append(list(dict.fromkeys(w for w in words if len(w) >= 2 and w not in stop)))
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.content_terms(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == want


def test_replace_table(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/table"
    read = lambda: sorted(r[0] for r in spark.read.parquet(path).collect())
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.read.parquet(path).selectExpr("id + 10 AS id"), path)  # reads what it replaces
    assert read() == [10, 11, 12] and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(Exception, match="broken"):  # fails midway: the old rows stay
        sinks.replace_table(spark.range(5).selectExpr("CASE WHEN id = 4 THEN raise_error('broken') ELSE id END AS id"), path)
    assert read() == [10, 11, 12]
    (tmp_path / "file").write_text("x")
    with pytest.raises(Exception):  # noqa: B017
        sinks.replace_table(spark.range(1), f"{tmp_path}/file/under")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "")], "doc_id long, text string")
    assert vector.backfill(docs, f"{tmp_path}/vectors", 32) == {"updated": 2, "dim": 32}
    assert vector.backfill(docs, f"{tmp_path}/vectors", 64) == {"updated": 2, "dim": 64}
    assert spark.read.parquet(f"{tmp_path}/vectors").count() == 2
    sinks.write_json(docs, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2


def test_replace_table_puts_the_old_one_back(spark, tmp_path):
    """The second rename fails: here, because what is renamed is gone."""
    path = f"{tmp_path}/table"
    sinks.replace_table(spark.range(3), path)

    class Gone:
        """A frame whose write leaves nothing."""

        sparkSession = spark

        class write:  # noqa: N801
            @staticmethod
            def parquet(_):
                return None

    with pytest.raises(Exception):  # noqa: B017
        sinks.replace_table(Gone, path)
    assert spark.read.parquet(path).count() == 3


def test_keyword(spark):
    docs = spark.createDataFrame([(1, "Product-C1 설치"), (2, "product guide"), (3, "other")], "doc_id long, text string")
    index = keyword.build_index(docs)
    asked = spark.createDataFrame([(0, "product c1"), (1, "zzz")], "query_id long, query string")
    found = keyword.keyword_search(index, asked)
    assert [r["doc_id"] for r in found.orderBy("rank").collect()] == [1, 2]
    assert keyword.has_index(index) and not keyword.has_index(None)
    dense = spark.createDataFrame([(0, 9, 1)], "query_id long, doc_id long, rank int")
    gated = keyword.gated(dense, found.select("query_id", "doc_id", "rank"), spark.createDataFrame([(0, "plain words"), (1, "none")], "query_id long, query string"))
    assert [r["doc_id"] for r in gated.collect()] == [9]


# SQL lane


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([(i, f"n{i};--x" if i % 2 else None) for i in range(300)], "id int, name string").createOrReplaceTempView("things")
    return ["things"]


@pytest.mark.parametrize(
    "sql",
    ["SELECT 1", "select * from things -- c", "WITH a AS (SELECT * FROM things) SELECT count(*) FROM a", "SELECT ';' AS a, '--x' AS b", "SELECT * FROM things WHERE id IN (SELECT id FROM things)", "SELECT * FROM (SELECT id FROM things) t ORDER BY id LIMIT 3", "SELECT CASE WHEN id > 1 THEN 'a' END FROM things", "SELECT id::string FROM things", "SELECT a.id FROM things a LEFT JOIN things b ON a.id = b.id", "SELECT id FROM things UNION ALL SELECT 1", "SELECT rank() OVER (ORDER BY id) r FROM things", "SELECT count(*) FROM things HAVING count(*) > 0", "SELECT * FROM VALUES (1), (2) AS t(x)", "SELECT EXISTS (SELECT 1 FROM things)", "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT * FROM b",
     "WITH a AS (WITH b AS (SELECT 2 AS x) SELECT * FROM b) SELECT * FROM a", "WITH a AS (SELECT 1 AS x) SELECT (SELECT max(x) FROM a), (SELECT count(*) FROM things)",
     "WITH secrets AS (SELECT 1 AS x) SELECT * FROM secrets", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r"],
)
def test_guard_accepts(spark, views, sql):
    assert sql_lane.sql_query(spark, sql, views).ok


@pytest.mark.parametrize(
    "sql",
    ["INSERT INTO things VALUES (1, 'a')", "WITH a AS (SELECT 1) INSERT INTO things SELECT * FROM a", "DROP VIEW things", "CREATE TABLE t AS SELECT 1", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM secrets", "SELECT * FROM things WHERE id IN (SELECT id FROM secrets)", "WITH a AS (SELECT * FROM secrets) SELECT * FROM a", "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT (SELECT reflect('java.lang.System', 'getenv', 'x'))", "SHOW TABLES", "SET a = b", "", "not sql", "EXPLAIN SELECT 1", "CACHE TABLE things",
     "WITH secrets AS (SELECT * FROM secrets) SELECT * FROM secrets", "SELECT b.v FROM (WITH secrets AS (SELECT 1 AS x) SELECT * FROM secrets) a CROSS JOIN secrets b",
     "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a", "WITH a AS (WITH secrets AS (SELECT 1 AS x) SELECT * FROM secrets) SELECT * FROM a, secrets",
     "SELECT (WITH secrets AS (SELECT 1 AS x) SELECT max(x) FROM secrets), (SELECT max(v) FROM secrets)", "WITH SECRETS AS (SELECT * FROM Secrets) SELECT 1",
     "WITH secrets AS (SELECT 1 AS v) SELECT * FROM spark_catalog.default.secrets", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r, secrets WHERE n < 3) SELECT * FROM r"],
)
def test_guard_refuses(spark, views, sql):
    spark.range(1).selectExpr("'hidden' AS v").createOrReplaceTempView("secrets")
    result = sql_lane.sql_query(spark, sql, views)
    assert not result.ok and result.error.startswith("refused")
    assert spark.table("things").count() == 300


@pytest.mark.parametrize(
    "sql",
    ["SELECT id, row_number() OVER w AS s FROM things WINDOW w AS (ORDER BY CASE WHEN exists(SELECT 1 FROM secrets WHERE v LIKE 'TOP%') THEN id ELSE -id END)",
     "SELECT first_value(name) OVER w FROM things WINDOW w AS (ORDER BY reflect('java.lang.System','getProperty','java.version'))",
     "SELECT IDENTIFIER('reflect')('java.lang.System','getProperty','user.home')", "SELECT IDENTIFIER('java_method')('java.lang.System','getProperty','user.home')",
     "SELECT IDENTIFIER('re' || 'flect')('java.lang.System','getProperty','user.home') FROM things", "SELECT * FROM IDENTIFIER('secrets')", "SELECT try_reflect('java.lang.System','getProperty','user.home')",
     "SELECT transform(array(id), x -> reflect('java.lang.System','getProperty','user.home')) FROM things", "SELECT id FROM things ORDER BY reflect('java.lang.System','getProperty','user.home')",
     "SELECT max(id) FROM things GROUP BY name HAVING max(id) > (SELECT count(*) FROM secrets)", "SELECT t.id FROM things t JOIN things u ON t.id = u.id AND exists(SELECT 1 FROM secrets)",
     "SELECT * FROM things, LATERAL (SELECT v FROM secrets)", "SELECT sum(id) OVER (PARTITION BY (SELECT max(v) FROM secrets)) FROM things", "SELECT sum(id) FILTER (WHERE name IN (SELECT v FROM secrets)) FROM things",
     "SELECT CASE WHEN EXISTS (WITH a AS (SELECT * FROM secrets) SELECT * FROM a) THEN 1 END FROM things", "SELECT * FROM (SELECT * FROM things UNION ALL SELECT 1, v FROM secrets)", "FROM secrets SELECT v",
     "SELECT * FROM things PIVOT (count(*) FOR name IN ('a')) WHERE EXISTS (SELECT 1 FROM secrets)", "TABLE secrets", "SELECT own_secret(id) FROM things", "SELECT input_file_name() FROM things", "SELECT current_user() FROM things"],
)
def test_guard_decides_on_the_analysed_plan(spark, views, sql):
    spark.range(1).selectExpr("'TOP' AS v").createOrReplaceTempView("secrets")
    spark.udf.register("own_secret", lambda x: str(x))
    result = sql_lane.sql_query(spark, sql, views)
    assert not result.ok and result.error.startswith("refused"), result
    with pytest.raises(sql_lane.Refused):
        sql_lane.guard(spark, sql, views)


@pytest.mark.parametrize(
    "sql",
    ["SELECT id, sum(id) OVER w AS s FROM things WINDOW w AS (PARTITION BY id % 3 ORDER BY id)", "SELECT IDENTIFIER('upper')(name) AS u FROM things LIMIT 3", "SELECT count(DISTINCT name) FILTER (WHERE id > 3) FROM things",
     "SELECT transform(array(id, 2), x -> x + 1)[0] AS x FROM things", "WITH secrets AS (SELECT 1 AS v) SELECT v FROM secrets", "SELECT a.id FROM things a LEFT ANTI JOIN things b ON a.id = b.id + 1",
     "SELECT id FROM things INTERSECT SELECT id FROM things EXCEPT SELECT 3", "SELECT * FROM range(3), LATERAL explode(array(1, 2)) AS e(x)", "SELECT id % 2 AS k, percentile_approx(id, 0.5) AS m FROM things GROUP BY ROLLUP(id % 2)",
     "SELECT * FROM (SELECT id % 2 AS k, id FROM things) PIVOT (sum(id) FOR k IN (0, 1))", "SELECT (SELECT max(b.id) FROM things b WHERE b.id < a.id) AS m FROM things a ORDER BY a.id DESC LIMIT 2 OFFSET 1",
     "SELECT date_trunc('month', DATE'2020-02-03') AS d, regexp_extract('a1', '([0-9])', 1) AS r, CAST(1.5 AS DECIMAL(4, 1)) AS c", "SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(x, y)"],
)
def test_guard_lets_reads_pass(spark, views, sql):
    result = sql_lane.sql_query(spark, sql, views)
    assert result.ok, result.error


def test_guard_allows_named_functions_and_trusts_views(spark, views):
    spark.udf.register("doubled", lambda x: 2 * x, "long")
    spark.range(2).selectExpr("id AS v").createOrReplaceTempView("secrets")
    spark.sql("SELECT v + 1 AS v FROM secrets").createOrReplaceTempView("shown")
    with pytest.raises(sql_lane.Refused):
        sql_lane.guard(spark, "SELECT doubled(id) FROM things", views)
    assert sql_lane.guard(spark, "SELECT doubled(id) FROM things", views, ["DOUBLED"])
    assert sql_lane.sql_query(spark, "SELECT max(v) AS v FROM shown", ["shown"]).rows == [{"v": 2}]
    assert not sql_lane.sql_query(spark, "SELECT max(v) AS v FROM shown JOIN secrets USING (v)", ["shown"]).ok


def test_sql_result(spark, views):
    r = sql_lane.sql_query(spark, "SELECT id FROM things", views)
    assert (len(r.rows), r.row_count, r.truncated, r.columns) == (200, 300, True, ["id"])
    bad = sql_lane.sql_query(spark, "SELECT nope FROM things", views)
    assert not bad.ok and "nope" in bad.error and not bad.error.startswith("refused")
    seen = []
    sql, fixed = sql_lane.repair(spark, "q", "SELECT nope FROM things", bad, lambda *a: seen.append(a) or "SELECT id FROM things LIMIT 1")
    assert fixed.ok and seen[0][3] == {"things": ["id", "name"]}
    refused = sql_lane.sql_query(spark, "DROP VIEW things", views)
    assert sql_lane.repair(spark, "q", "x", refused, lambda *a: pytest.fail("repaired"))[1] is refused
    texts = [r["text"] for r in sql_lane.render_rows(spark.sql("SELECT id, name FROM things WHERE id < 2 ORDER BY id"), "S").collect()]
    assert texts == ["[S] id=0 | name=null", "[S] id=1 | name=n1;--x"]


def test_sql_time_bound(spark, views):
    slow = "SELECT count(*) FROM things a, things b, things c WHERE sha2(concat(a.id, b.id, c.id), 512) LIKE '0000%'"
    r = sql_lane.sql_query(spark, slow, views, seconds=0.5)
    assert not r.ok and "cancel" in r.error.lower()
    assert sql_lane.sql_query(spark, "SELECT 1 AS a", views, seconds=0.5).ok


# Graph


@pytest.fixture(scope="module")
def world(spark):
    ents = spark.createDataFrame([(1, "client", "Client-A", None), (2, "product", "Product-C1", None), (3, "employee", "Kim", None), (4, "project", "project_12", '{"status": "in_progress"}'), (5, "project", "projectX12", '{"status": "completed"}'), (6, "employee", "Client-Alpha Lead", None)], "id long, type string, canonical_name string, properties string")
    als = spark.createDataFrame([(3, "client-a"), (2, "c-one")], "entity_id long, alias string")
    rels = spark.createDataFrame([(1, 1, "USES", 2), (2, 3, "MANAGES_ACCOUNT", 1), (3, 3, "LEADS", 4), (4, 6, "LEADS", 5), (5, 2, "USES", 1), (6, 3, "LEADS", 5)], "id long, src long, rel_type string, dst long")
    return ents, als, rels


def test_ontology(spark, world):
    ents, als, _ = world
    asked = spark.createDataFrame([(0, "Client-A 현황"), (1, "project_12"), (2, "ghost")], "query_id long, query string")
    hits = {q: [(r["id"], r["score"], r["via"]) for r in graph.ontology_search(asked, ents, als).where(F.col("query_id") == q).orderBy("rank").collect()] for q in range(3)}
    assert hits[0] == [(1, 4, "canonical"), (3, 3, "alias"), (6, 2, "canonical")]
    assert hits[1] == [(4, 4, "canonical"), (5, 2, "canonical")]  # _ is a wildcard
    assert hits[2] == []
    assert len(graph.ontology_search(asked.where("query_id = 1"), ents, als, like_wildcards=False).collect()) == 1


def test_expand(spark, world):
    ents, _, rels = world
    seeds = spark.createDataFrame([(0, 1)], "query_id long, seed long")
    at = lambda d, **k: {(r["src"], r["rel_type"], r["dst"]): r["depth"] for r in graph.graph_expand(seeds, rels, d, **k).collect()}
    assert at(1) == {(1, "USES", 2): 1, (2, "USES", 1): 1, (3, "MANAGES_ACCOUNT", 1): 1}
    assert at(2)[(3, "LEADS", 4)] == 2 and at(3)[(6, "LEADS", 5)] == 3 and at(9) == at(3) and at(0) == at(1)
    assert at(1, direction="out") == {(1, "USES", 2): 1} and at(2, rel_types=["USES"]) == {(1, "USES", 2): 1, (2, "USES", 1): 1}


def test_scan_and_ranking(spark, world):
    ents, _, rels = world
    open_ = graph.relation_scan(rels, ents, ["LEADS"], "target", "status", "in_progress")
    assert [r["dst_name"] for r in open_.collect()] == ["project_12"]
    with pytest.raises(ValueError):
        graph.relation_scan(rels, ents.drop("properties"), ["LEADS"], "target", "status", "x")
    rows = spark.createDataFrame([(i, i, "R", d, "s", "t", "n", "k") for i, d in enumerate([1, 2, 3, 4, 1, 2, 3])], "id long, src long, rel_type string, dst long, src_type string, dst_type string, src_name string, dst_name string")
    assert [(r["entity_id"], r["rank"], r["tied"]) for r in graph.degree_ranking(rows).orderBy("entity_id").collect()] == [(1, 1, True), (2, 1, True), (3, 1, True), (4, 4, False)]
    cards = graph.ranking_candidates(graph.degree_ranking(rows), "USES").collect()
    assert "공동 1위" in cards[0]["text"] and "4위" in cards[-1]["text"]
    assert {r["name"] for r in graph.argmax(rels, ents, "LEADS", "source").collect()} == {"Kim"}


def test_project(spark):
    nodes = spark.createDataFrame([(0, "client_7", "client", "Client-A", {"city": "서울", "size": "big"}), (1, "product_x", "product", "P", None)], "pos int, id string, type string, name string, properties map<string,string>")
    edges = spark.createDataFrame([(0, "client_7", "product_x", "USES")], "pos int, source string, target string, relation string")
    out = kg.project(nodes, edges)
    assert {(r["alias"], r["lang"]) for r in out["aliases"].collect()} == {("client_7", "en"), ("서울", "ko"), ("product_x", "en")}
    assert [(r["source_table"], r["source_pk"]) for r in out["entity_links"].collect()] == [("client", "7")]
    assert out["relations"].first()[:] == (1, 1, "USES", 2)
    with pytest.raises(ValueError):
        kg.project(nodes, spark.createDataFrame([(0, "client_7", "gone", "USES")], edges.schema))


# Fusion and curation


def lists(spark, rows):
    return spark.createDataFrame([(0, i, r, k, s, f"{s}:{k}") for i, r, k, s in rows], "query_id long, list_idx int, rank int, key string, source string, text string")


def test_rrf(spark):
    got = fusion.rrf_merge(lists(spark, [(0, 1, "a", "v"), (0, 2, "a", "v"), (0, 3, "b", "v"), (1, 1, "b", "g")])).orderBy("rank").collect()
    assert [r["key"] for r in got] == ["b", "a"]
    assert got[0]["score"] == pytest.approx(1 / 63 + 1 / 61) and got[1]["score"] == pytest.approx(1 / 61)
    named = fusion.rrf_named(lists(spark, [(0, 1, "hub", "graph"), (0, 2, "hub", "graph"), (0, 3, "two", "graph"), (1, 1, "two", "vector")])).orderBy("rank").collect()
    assert named[0]["key"] == "two" and named[0]["sources"] == ["graph", "vector"] and named[0]["text"] == "graph:two"


def test_bridge(spark):
    hits = spark.createDataFrame([(1,), (2,)], "doc_id long")
    links = spark.createDataFrame([(5, "vector", 1), (9, "vector", 1), (7, "sql", 2)], "entity_id long, source_kind string, document_id long")
    ents = spark.createDataFrame([(5, "client"), (9, "client")], "id long, type string")
    assert {r["doc_id"]: r["canonical_key"] for r in fusion.bridge(hits, links, ents).collect()} == {1: "entity:client#9", 2: "documents#2"}


def test_rank_delta(spark):
    make = lambda rows: spark.createDataFrame(rows, "query_id int, rank int")
    got = {r[0]: r[1] for r in fusion.rank_delta(make([(1, 2), (2, 1), (3, 4), (4, 1)]), make([(1, 1), (2, 2), (4, 1), (5, 3)])).collect()}
    assert got == {1: "up", 2: "down", 3: "lost", 4: "same", 5: "gained"}


def test_curate_skips_and_never_breaks(spark):
    words = lambda n: " ".join(["w"] * n)
    items = spark.createDataFrame([(0, i, "row", words(n)) for i, n in enumerate([60, 50, 30, 20])], "query_id long, idx int, kind string, text string")
    asked = spark.createDataFrame([(0, "nothing shared")], "query_id long, query string")
    got = curate.curate(items, asked, 100).first()
    assert (got["kept"], got["dropped"], got["tokens_used"]) == ([0, 2], [1, 3], 90)
    broken = 0
    for budget in (0, 1, 45, 60, 61, 100, 159, 160, 500):
        c, n = curate.curate(items, asked, budget).first(), curate.naive_truncate(items, budget).first()
        assert c["tokens_used"] <= budget and n["tokens_used"] <= max(budget, 0)
        broken += n["broken_rows"]
    assert broken > 0
    shared = spark.createDataFrame([(0, 0, "aaa bbb"), (0, 1, "ccc target ddd")], "query_id long, idx int, text string")
    assert curate.curate(shared, spark.createDataFrame([(0, "target")], "query_id long, query string"), 3).first()["kept"] == [1]


def test_naive_truncate_against_a_plain_cut(spark):
    """The cut by sums of items is that of the joined text, at any budget; whole texts are neither joined nor shuffled."""
    alphabet = ["w", "Z9", "가", " ", "\n", "_", "é", "!", "\u00a0", "\U0001f600"]
    rng, white = random.Random(4), r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
    texts = {q: ["".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 30]))) for _ in range(rng.choice([1, 4, 7]))] for q in range(12)}
    texts |= {20: ["", ""], 21: ["a b", "", "c"], 22: [" _ ", "a"]}
    kind = lambda i: "chunk" if i % 3 == 2 else "row"
    rows = [(q, i, kind(i), t) for q, ts in texts.items() for i, t in enumerate(ts)]
    items = spark.createDataFrame([*rows, (21, 1, "row", None)], "query_id int, idx int, kind string, text string")
    tokens = lambda t: len(re.findall(rf"[가-힣]|[A-Za-z0-9]+|[^A-Za-z0-9_{white}가-힣]", t))
    for budget in (0, 1, 3, 17, 500):
        cut = curate.naive_truncate(items, budget)
        got = {r[0]: tuple(r)[1:] for r in cut.collect()}
        for q, ts in texts.items():
            whole = "\n".join(ts)
            at = max(n for n in range(len(whole) + 1) if tokens(whole[:n]) <= budget)
            starts = [sum(len(t) + 1 for t in ts[:i]) for i in range(len(ts))]
            kept = sum(at >= s + len(t) for s, t in zip(starts, ts, strict=True))
            broken = sum(s < at < s + len(t) and kind(i) == "row" for i, (s, t) in enumerate(zip(starts, ts, strict=True)))
            assert got[q] == (at, kept, len(ts) - kept - broken, broken, tokens(whole[:at])), (q, budget)
    assert "collect_list" not in cut._jdf.queryExecution().optimizedPlan().toString()


# Routing


def test_router_rungs(spark):
    cases = [("Client-A를 담당하는 직원", "graph"), ("설치 가이드", "semantic"), ("매출 합계", "structured"), ("비슷한 느낌", "semantic"), ("매출과 비슷한 느낌", "hybrid"), ("Product-C1", "hybrid"), ("음", "hybrid"), ("", "hybrid"), (None, "hybrid"), ("user id는 5", "structured"), ("이슈가 가장 많은 제품", "graph"), ("Client-A와 연결된 것", "graph")]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(cases)], "query_id int, query string")
    got = {r["query_id"]: r for r in router.route(df).collect()}
    assert [got[i]["route"] for i in range(len(cases))] == [r for _, r in cases]
    assert got[5]["tools"] == ["sql.query", "vector.search", "ontology.search", "graph.expand"] and got[6]["tools"] == ["sql.query", "vector.search"]
    assert got[10]["graph_plan"]["aggregate"] == "target" and got[11]["graph_plan"]["rel_types"] == []
    runs = {tuple(sorted((r["query_id"], r["route"], r["rationale"]) for r in router.route(df).collect())) for _ in range(3)}
    assert len(runs) == 1
    assert "lane" in router.audit_view(router.route(df)).first()["audit"]


def test_router_filter_and_names(spark):
    df = spark.createDataFrame([(0, "소속된 직원"), (1, "진행 중인 프로젝트를 이끄는 홍길동 직원")], "query_id int, query string")
    got = {r["query_id"]: r for r in router.route(df).collect()}
    assert "person" not in got[0]["entity"] and "person" in got[1]["entity"]
    assert got[1]["graph_plan"]["filter"]["value"] == "in_progress" and got[1]["graph_plan"]["rel_types"] == ["LEADS"]


# Claims and evaluation


def test_claims(spark):
    rows = [(0, "Client-A는 3건입니다. 상태는 in_progress입니다. 예산은 1,200원입니다.", "Client-A count=3 in_progress 1200"), (1, "Client-B입니다.", "Client-A"), (2, "모르겠습니다.", ""), (3, None, None)]
    got = {r["query_id"]: r for r in claims.score_claims(spark.createDataFrame(rows, "query_id int, answer string, context string")).collect()}
    assert got[0]["claim_grounded_rate"] == 1.0 and got[0]["scorable"] == 3
    assert got[1]["ungrounded"] == ["Client-B"] and got[1]["atom_grounded_rate"] == 0.0
    assert got[2]["claim_grounded_rate"] is None and got[3]["scorable"] == 0
    full = claims.completeness(spark.createDataFrame([(0, ["Client-A", "8"], "Client-A 19"), (1, [], "x")], "query_id int, required array<string>, context string"))
    assert {r["query_id"]: r["rate"] for r in full.collect()} == {0: 0.5, 1: None}
    assert one(spark, claims.outside_mentions(F.lit("Client-A와 Client-B, 홍길동 과장"), F.lit("Client-A"))) == ["Client-B", "홍길동"]


@pytest.mark.parametrize(
    ("a", "b", "options", "want"),
    [
        ([{"x": 1}], [{"y": 1}], {}, True),
        ([{"x": 1}], [{"y": 1}], {"columns_sensitive": True}, False),
        ([{"x": None}], [{"x": 0}], {}, False),
        ([{"x": 1, "y": 2}], [{"x": 2, "y": 1}], {}, True),
        ([{"x": 1, "y": 2}], [{"x": 2, "y": 1}], {"tuple_sensitive": True}, False),
        ([{"x": 1}, {"x": 2}], [{"x": 2}, {"x": 1}], {}, True),
        ([{"x": 1}, {"x": 2}], [{"x": 2}, {"x": 1}], {"ordered": True}, False),
        ([{"x": "007"}], [{"x": 7}], {}, True),
        ([{"x": "1e3"}], [{"x": 1000}], {}, False),
        ([{"x": 0.49}], [{"x": 0.51}], {"numeric_tolerance": 1}, False),
        ([{"x": 0.5}], [{"x": 1.49}], {"numeric_tolerance": 1}, True),
        ([{"x": 0.49}], [{"x": 0.51}], {"numeric_tolerance": 1, "true_tolerance": True}, True),
        ([{"x": 1, "z": "e"}], [{"x": 1}], {"subset_columns": True}, True),
        ([{"x": 1}, {"x": 1}], [{"x": 1}], {"subset_columns": True}, False),
        ([{"x": 1}, {"x": 1}], [{"x": 1}], {}, False),
        ([{"x": -0.0}], [{"x": 0}], {}, True),
    ],
)
def test_results_match(a, b, options, want):
    assert results_match(a, b, MatchOptions(**options)) is want


def test_frames_match(spark):
    a = spark.createDataFrame([(1, 0.1), (1, 0.1)], "a int, b double")
    assert evaluate.frames_match(a, a.limit(1), distinct=True) and not evaluate.frames_match(a, a.limit(1))
    assert evaluate.frames_match(a, a.toDF("x", "y").withColumn("y", F.col("y") + 1e-9))


def test_metrics(spark):
    first = spark.createDataFrame([(0, 1), (1, 3), (2, None)], "query_id int, rank int")
    got = evaluate.rank_metrics(first).first()
    assert (got["n"], got["hit_at_1"], got["hit_at_3"], got["mrr"]) == (3, 0.333333, 0.666667, 0.444444)
    lo, hi = evaluate.wilson(F.lit(8), F.lit(10))
    assert (one(spark, lo), one(spark, hi)) == (0.49, 0.943)
    runs = spark.createDataFrame([(r, i, c) for r in range(4) for i, c in enumerate([True, False, r % 2 == 0])], "run int, item int, correct boolean")
    assert evaluate.repeat_summary(runs).first()[:] == (2, 1, 2)
    assert {r["item"]: r["state"] for r in evaluate.stability(runs).collect()} == {0: "stable", 1: "always_wrong", 2: "flaky"}
    names = spark.createDataFrame([(0, ["a", "b"], "a only"), (1, [], "x")], "query_id int, gold array<string>, text string")
    assert {r["query_id"]: r["recall"] for r in evaluate.name_recall(names).collect()} == {0: 0.5, 1: None}
    timed = spark.createDataFrame([(i, 1.0, False, False) for i in range(30)] + [(30, 29.0, True, False), (31, 2.0, False, True)], "item int, seconds double, killed boolean, failed boolean")
    assert {r["state"] for r in evaluate.triage(timed, 30).where("item >= 30").collect()} == {"slow", "broken"}
    with pytest.raises(RuntimeError):
        evaluate.triage(timed.where("item >= 30"), 30).collect()


# Engine


@pytest.fixture(scope="module")
def engine(spark, world):
    ents, als, rels = world
    docs = spark.createDataFrame([(1, "Client-A 설치 가이드 문서"), (2, "unrelated words here")], "doc_id long, text string")
    spark.createDataFrame([(1, 7, "refunded", 10, "2025-01-01"), (2, 8, "paid", 20, "2025-01-02")], "id int, user_id int, status string, amount int, created_at string").createOrReplaceTempView("orders")
    links = spark.createDataFrame([(1, "vector", 1)], "entity_id long, source_kind string, document_id long")
    return Engine(spark, docs, ents, als, rels, links, keyword.build_index(docs), llm=lambda p: "answer", lexicon=ents.select(F.col("canonical_name").alias("name"), "type"))


def test_retrieve(spark, engine):
    r = engine.retrieve("환불된 주문 목록")
    assert r.sql_ok and "status=refunded" in r.context and not r.errors
    g = engine.retrieve("Client-A를 담당하는 직원")
    assert g.decision["route"] == "graph" and "담당 고객사" in g.context
    none = engine.retrieve("Ghost-Z 담당하는 사람")
    assert "찾지 못했습니다" in none.context
    top = engine.graph_lane("가장 많은 프로젝트를 이끄는", {"rel_types": ["LEADS"], "aggregate": "source"}).orderBy("rank").first()
    assert "Kim" in top["text"]


def test_ask_and_audit(spark, engine):
    assert engine.ask("환불된 주문 목록").answer == "answer"
    record = engine.explain_audit("환불된 주문 목록")
    assert "sql:read_only_ok" in record["verdicts"] and record["rule_fingerprint"] != record["pipeline_fingerprint"]
    again = engine.explain_audit("환불된 주문 목록")
    assert again["pipeline_fingerprint"] == record["pipeline_fingerprint"]
    hidden = audit.redact(engine.audit_records([engine.retrieve("환불된 주문 목록")])).first()
    assert all(f["preview"].startswith("[withheld") for f in hidden["fusion"])


def test_degraded(spark, engine):
    def broken(*_):
        raise RuntimeError("lane is down")

    down = Engine(spark, nl2sql=broken, llm=lambda p: "never")
    r = down.ask("매출 합계")
    assert r.failed and "lane is down" in r.answer
    partial = Engine(spark, engine.documents, engine.entities, engine.aliases, engine.relations, nl2sql=broken, llm=broken)
    p = partial.ask("Client-A")
    assert p.context and p.errors and p.answer.startswith("Generation failed")


def test_kg_retrieve(engine):
    rows = engine.kg_retrieve("Client-A 가이드").orderBy("rank").collect()
    assert rows[0]["key"] == "entity:client#1" and rows[0]["sources"] == ["graph", "vector"]


def test_multi_step(spark, world):
    ents, als, rels = world
    fact = spark.createDataFrame([(1, 10), (1, 5), (2, 7)], "pid int, amount int")
    dim = spark.createDataFrame([(1, "project_12"), (2, "projectX12")], "id int, name string")
    plan = [{"name": "who", "kind": "resolve"}, {"name": "what", "kind": "graph", "rel_types": ["LEADS"], "end_types": ["project"]}, {"name": "sum", "kind": "join_aggregate", "fact": fact, "dim": dim, "fk": "pid", "dim_key": "id", "dim_name": "name", "agg": "sum", "column": "amount"}]
    out = multistep.run_plan(spark, plan, "Kim", ents, als, rels)
    assert out.complete and {r["name"]: r["value"] for r in out.steps[2].rows} == {"project_12": 15, "projectX12": 7} and "Kim" in out.context
    gone = multistep.run_plan(spark, plan, "Ghost", ents, als, rels)
    assert not gone.complete and len(gone.steps) == 1
    bad = multistep.run_plan(spark, plan[:2] + [plan[2] | {"agg": "drop"}], "Kim", ents, als, rels)
    assert not bad.complete and "not allowed" in bad.steps[-1].detail


# Sources and sinks


def test_chunks(spark):
    long_ = "## big\n" + "\n\n".join("p" * 500 for _ in range(5))
    text = f"head text\n# One\nbody\n### Two\n\n{long_}\n"
    rows = readers.chunk_markdown(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")).orderBy("chunk_index").collect()
    assert [r["section"] for r in rows] == ["(head)", "One", "Two", "big", "big", "big"]
    assert rows[1]["content"] == "# One\nbody" and all(len(r["content"]) <= 1200 for r in rows)
    assert "\n\n".join(r["content"] for r in rows[3:]) == long_


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").where("a IS NOT NULL").count() == 2
    (tmp_path / "index.json").write_text('[{"filename": "x.md", "title": "X", "type": "t"}]')
    (tmp_path / "x.md").write_text("# X\nbody")
    assert readers.read_markdown(spark, str(tmp_path), str(tmp_path / "index.json")).first()["text"] == "# X\nbody"
    (tmp_path / "bad.json").write_text('[{"filename": "gone.md", "title": "X", "type": "t"}]')
    with pytest.raises(FileNotFoundError):
        readers.read_markdown(spark, str(tmp_path), str(tmp_path / "bad.json"))
    path = f"{tmp_path}/t"
    for n in (1, 2):
        sinks.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    meta = spark.createDataFrame([(1, "body", '{"title": "T", "section": "S"}')], "id int, content string, metadata string")
    assert readers.document_view(meta).first()["title"] == "T - S"


def test_profiles(spark, small):
    assert profile.get_profile("").name == "smoke"
    with pytest.raises(KeyError):
        profile.get_profile("nope")
    tables = profile.register(spark, profile.get_profile("star"), small)
    assert "orders" in profile.describe(tables) and len(tables) == 10


def test_resources_and_prompts(spark, tmp_path):
    from wayfind import surfaces
    from wayfind.engine import answer_prompt
    from wayfind.operators.sql_lane import nl2sql_prompt

    bench = profile.get_profile("bench")
    found = surfaces.resources(spark, bench, str(tmp_path))
    assert len(found) == 6 and all(r.read() and "admin_secrets" not in r.read() for r in found.values())
    assert found["schema://dataset/tables"].read() == "# profile: bench\n\n" + bench.schema_card
    assert json.loads(found["profile://dataset/active"].read())["embed_dim"] == 1024
    told = json.loads(found["audit://schema/v1"].read())
    assert set(told["fields"]) <= {f["name"] for f in told["record"]["fields"]}
    assert "is not there" in found["dataset://company/manifest"].read() and "no such folder" in found["eval://results/index"].read()
    for path, text in {
        "datasets/MANIFEST.md": "# Sources",
        "docs/report.md": "# R\n## 8. Method\nx\n## 9. Evidence manifest\na\n### more\nb\n## 10. End\nc",
        "eval/results/b.json": '{"summary": {"n": 3, "note": "가"}, "rows": []}',
        "eval/results/a.json": "[1, 2]",
        "eval/results/c.json": "{",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    assert found["dataset://company/manifest"].read() == "# Sources"
    assert found["docs://report/evidence"].read() == "## 9. Evidence manifest\na\n### more\nb"
    assert found["eval://results/index"].read().split("\n")[2:] == ["- **a.json**: items=2", '- **b.json**: n=3, note="가"', "- **c.json**: cannot be read as JSON"]

    asked = surfaces.prompts(bench)
    assert asked["grounded-answer"](question="q", context="c") == answer_prompt("q", "c")
    assert asked["nl2sql-with-schema-card"](question="q") == nl2sql_prompt("q", bench.schema_card)
    assert "sql" in asked["explain-routing"](question="q", routing='{"route": "sql"}')
    assert bench.schema_card in asked["review-generated-sql"](question="q", sql="SELECT 1")
    for wrong in ({}, {"question": "q"}, {"question": "q", "context": "c", "more": "m"}):
        with pytest.raises(ValueError):
            asked["grounded-answer"](**wrong)


def test_streaming(spark, small, tmp_path):
    from wayfind.streaming import run_to_table, windowed_counts

    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{small}/events.parquet").write.mode("overwrite").parquet(f"{tmp_path}/in/e")
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    streamed = run_to_table(spark, f"{tmp_path}/in/e", schema, f"{tmp_path}/cp", "streamed")
    batch = windowed_counts(spark.read.parquet(f"{small}/events.parquet"))
    assert sorted(r["n"] for r in streamed.collect()) == sorted(r["n"] for r in batch.collect())


def test_replica(spark, tmp_path):
    """A folder that cannot be read is replaced by its replica; without one it raises."""
    spark.range(3).write.parquet(f"{tmp_path}/copy/things.parquet")
    p = profile.Profile("x", ("things",), "things(id)", replica=f"{tmp_path}/copy")
    assert profile.register(spark, p, f"{tmp_path}/gone")["things"].count() == 3
    with pytest.raises(Exception):  # noqa: B017
        profile.register(spark, profile.Profile("x", ("things",), "things(id)"), f"{tmp_path}/gone")


def test_jdbc(spark):
    url = "jdbc:derby:memory:wayfind;create=true"
    spark.range(100).write.format("jdbc").options(url=url, dbtable="things", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    df = readers.read_jdbc(spark, url, "things", "ID", (0, 50), 4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert df.count() == 100 and df.rdd.getNumPartitions() == 4


def test_curation_audit(spark):
    items = spark.createDataFrame([(0, 0, "alpha beta"), (0, 1, "gamma " * 50)], "query_id long, idx int, text string")
    c = curate.curate(items, spark.createDataFrame([(0, "alpha")], "query_id long, query string"), 10)
    r = curate.curation_audit(c, 10).first()
    assert (r["n_kept"], r["n_dropped"], r["budget"], r["structure_preserved"]) == (1, 1, 10, True) and c.first()["context"] == "alpha beta"
    none = curate.curate(items, spark.createDataFrame([(0, "alpha")], "query_id long, query string"), 1).first()
    assert none["kept"] == [] and none["dropped"] == [0, 1] and none["context"] == ""


def test_first_gold(spark):
    ranked = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 1)], "query_id int, id string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "x"), (2, "y")], "query_id int, id string")
    assert {r["query_id"]: r["rank"] for r in evaluate.first_gold(ranked, gold, "id").collect()} == {1: 2, 2: None}


def test_answer_checks(spark):
    rows = [
        (1, "Kim leads Apollo", "Kim leads it", ["Kim", "Apollo"], False),
        (2, "Kim leads Apollo", "Lee leads it", ["Lee"], False),
        (3, "", "알 수 없습니다", [], True),
        (4, "x", "it is 5", [], True),
    ]
    answers = spark.createDataFrame(rows, "query_id int, context string, answer string, gold array<string>, absent boolean")
    checks = evaluate.answer_checks(answers, spark.createDataFrame([("Kim",), ("Lee",)], "name string"))
    assert {r["query_id"]: (r["evidence"], r["grounded"], r["abstained"]) for r in checks.collect()} == {1: (1.0, True, None), 2: (0.0, False, None), 3: (None, None, True), 4: (None, None, False)}
    assert tuple(evaluate.answer_rates(checks).first()) == (1, 2, 1, 2, 1, 2)


def test_fault_rates(spark, engine):
    """Lanes broken on purpose: the others carry the question, and the record names the fault."""
    import dataclasses

    def broken(*_):
        raise RuntimeError("down")

    def lane(**changes):
        r = dataclasses.replace(engine, **changes).retrieve("매출 합계와 관련된 내용")
        return bool(r.context), bool(r.errors)

    rates = evaluate.fault_rates({"sql": lambda: lane(nl2sql=broken), "extra": lambda: lane(extra_lanes={"other": broken})})
    assert rates["no_crash"] == rates["visible"] == 1 and rates["passed"] == (rates["partial"] >= 0.8)
    crash = evaluate.fault_rates({"a": broken, "b": lambda: (True, True)})
    assert (crash["no_crash"], crash["partial"], crash["visible"], crash["passed"]) == (0.5, 0.5, 1.0, False)


def test_lexicon(spark):
    ents = spark.createDataFrame([(1, "client", "Acme"), (2, "product", "Bolt")], "id long, type string, canonical_name string")
    names = spark.createDataFrame([(2, "Acme"), (2, "Bolty"), (1, "x")], "entity_id long, alias string")
    full = kg.lexicon(ents, names)
    assert sorted((r["name"], r["type"]) for r in full.collect()) == [("Acme", "client"), ("Acme", "product"), ("Bolt", "product"), ("Bolty", "product")]
    asked = spark.createDataFrame([(0, "Acme Bolty")], "query_id long, query string")
    assert router.lexicon_hits(asked, full).first()["types"] == ["product", "client"]  # the canonical Acme holds
    for bad in (None, names.withColumnRenamed("alias", "other")):
        assert sorted(r["name"] for r in kg.lexicon(ents, bad).collect()) == ["Acme", "Bolt"]


def test_white_space_is_any(spark):
    """A no-break or ideographic space is white space to the router and the claims."""
    texts = ["가장 많은 이슈가 접수된 제품", "가장\u00a0많은\u3000이슈가 접수된 제품"]
    df = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    assert len({r["route"] for r in router.route(df).collect()}) == 1
    row = spark.createDataFrame([("One.\u3000Two 12\u00a0ms",)], "t string").select(claims.sentences(F.col("t")).alias("s"), claims.atoms(F.col("t")).alias("a")).first()
    assert row["s"] == ["One.", "Two 12\u00a0ms"] and row["a"] == ["12\u00a0ms"]


def test_prompts():
    from wayfind.engine import answer_prompt

    asked = answer_prompt("누구?", " ", "Korean")
    assert "(empty)" in asked and "Korean" in asked and "Korean" not in answer_prompt("q", "c", None).replace("q", "")
    card = "orders(id, amount)\nusers(id)"
    assert "amount" in sql_lane.nl2sql_prompt("q", card) and "amount" not in sql_lane.nl2sql_prompt("q", card, naive=True)
    model = sql_lane.model_nl2sql(lambda prompt: "Sure:\n```sql\nSELECT 1 AS a;\n```", card)
    assert model("q") == "SELECT 1 AS a" and sql_lane.model_nl2sql(lambda _: "no", card)("q") is None


def test_embedder_of_another_length(spark):
    docs = spark.createDataFrame([(1, "a", [1.0, 0.0])], "doc_id long, text string, embedding array<double>")
    with pytest.raises(ValueError):
        Engine(spark, documents=docs, embedder=lambda _: [1.0], vector_dim=2).vector_search("a")
    assert Engine(spark, documents=docs, embedder=lambda _: [1.0, 0.0], vector_dim=2).vector_search("a").count() == 1


def test_match_terms_against_nested_loop(spark):
    """Blocking on rare runs loses no match, with wildcards and short terms."""
    names = ["Customer#1", "customer_17", "Cust omer", "AB", "abc", "xabcx", "BUILDING", "build", "c%d", "customerX7"]
    ents = spark.createDataFrame([(i, "t", n) for i, n in enumerate(names)], "id long, type string, canonical_name string")
    als = spark.createDataFrame([(i, f"alias_{n}") for i, n in enumerate(names)], "entity_id long, alias string")
    terms = spark.createDataFrame([(q, t) for q, t in enumerate(["customer_7", "ab", "abc", "build", "a", "s_a", "none here", "_", "customer"])], "query_id int, term string")
    import re

    for wild in (True, False):
        want = set()
        for q, t in [(r["query_id"], r["term"]) for r in terms.collect()]:
            p = "".join("." if wild and c == "_" else ".*" if wild and c == "%" else re.escape(c) for c in t.lower())
            want |= {(q, i) for i, n in enumerate(names) for x in (n, f"alias_{n}") if re.search(p, x.lower())}
        assert {(r["query_id"], r["id"]) for r in graph.match_terms(terms, ents, als, wild).collect()} == want
