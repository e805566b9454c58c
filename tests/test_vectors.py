"""Vector search by blocks of queries and slices of scores, against all products at once."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfind import plans
from wayfind.operators import vector


@pytest.mark.parametrize("numbers", [10**6, 60])
def test_slices_give_what_all_products_give(spark, monkeypatch, numbers):
    """However little a task may hold, the rows are the same, ties and vectors without length included; batches are bounded."""
    monkeypatch.setattr(vector, "MOST_QUERY_NUMBERS", numbers)
    monkeypatch.setattr(vector, "MOST_SCORES", 30)
    monkeypatch.setattr(vector, "BATCH_ROWS", 7)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    v = np.random.default_rng(3).integers(-2, 3, (90, 4)).astype(float)
    v[5] = 0
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)] + [(200, None)], "vec_id long, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "embedding")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vector.cosine_topk_many(df, asked, 5, places=9).collect()}
    length = np.linalg.norm(v, axis=1, keepdims=True)
    unit = v / np.where(length == 0, 1, length)
    want = {}
    for q in range(0, 90, 3):
        score = (unit @ unit[q]).round(9)
        for k, i in enumerate(np.lexsort((np.arange(90), -score))[:5]):
            want[q, k + 1] = (i, score[i])
    assert got == want
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 7
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_are_embedded_once(spark):
    """No filter on the vectors takes a second evaluation with it, and the vectors are what they were, texts without terms left out."""
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "the of"), (4, "beta 고객은 gamma")], "doc_id int, text string")
    asked = docs.where("doc_id <> 2").selectExpr("doc_id AS query_id", "text AS query")
    sparse, best = vector.hash_vectors(docs, 64), vector.hash_topk(docs, asked, 2, 64)
    for df in (sparse, best):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    weights = {}
    for r in sparse.collect():
        weights.setdefault(r["doc_id"], []).append(r["weight"])
    assert {k: len(v) for k, v in weights.items()} == {1: 2, 4: 3}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in weights.values())
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in best.orderBy("query_id", "rank").collect()] == [(1, 1, 1), (1, 4, 2), (4, 4, 1), (4, 1, 2)]


@pytest.mark.parametrize("name", ["vec_cosine_topk_many", "vec_recall_mrr", "vec_type_precision"])
def test_scores_equal_to_six_places_go_by_id(spark, tmp_path, name):
    """The SQL ranks rounded scores; of ten that round to the same the smaller ids are found, though larger ids are a little nearer."""
    rows = [(i, [1.0, (10 - i) * 1e-5], int(i > 4)) for i in range(10)] + [(i, [float(i % 7 - 3), 1.0], i % 2) for i in range(100, 130)]
    spark.createDataFrame([(0, [1.0, 0.0], 1), *rows[1:]], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in plans.QUERIES[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(plans.ORACLE_SQL[name]).fetchall())


@pytest.mark.parametrize("most", [100, 64_000_000])
def test_hashed_search_is_exact_whatever_the_lengths(spark, monkeypatch, most):
    """Products are held three, two or one in a number, by the lengths of both sides; ranks and scores are those of plain code."""
    monkeypatch.setattr(vector, "MOST_ASKED_COUNTS", most, raising=False)
    for name, size in (("CHUNK", 40), ("PART", 8), ("SLICE", 4)):
        monkeypatch.setattr(vector, name, size, raising=False)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(9000)]
    text = lambda n: " ".join(rng.choice(words, n))
    texts = [text(n) for n in (1, 2, 3, 5, 9, 40, 60, 200, 900, 9000, 30_000) for _ in range(9)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:30] + ["", None, "the of"])]
    asks = [(i, t) for i, t in enumerate([text(n) for n in (1, 2, 30, 200, 3000, 9000)] + ["", texts[5]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(asks, "query_id long, query string")
    of = lambda df, key, col: {r[0]: np.array(r[1]) for r in df.select(key, vector.hash_embedding(F.col(col), 16)).collect() if r[1] is not None}
    d, q = of(docs, "doc_id", "text"), of(asked, "query_id", "query")
    want = {(i, rank + 1): (doc, score) for i, v in q.items() for rank, (score, doc) in enumerate(sorted(((round(float(v @ w), 9), j) for j, w in d.items()), key=lambda x: (-x[0], x[1]))[:7])}
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in vector.hash_topk(docs, asked, 7, dim=16).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_a_pair_costs_less_than_its_numbers(spark):
    """One product of numbers holds three scalar products."""
    counts = np.ones((9, 16), np.int8)
    part = vector._Part(counts, vector._lengths(counts), 0)
    held = part.products(counts.astype(np.float32), 4.0)
    assert part.factors[3].shape == (16, 3) and (held[:, :, :3] == 16 + 128).all()
