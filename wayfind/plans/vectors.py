"""Vector queries on the embeddings table, and hashed-term vectors of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions import vectors as V
from wayfind.operators import evaluate, vector
from wayfind.plans.documents import terms_sql
from wayfind.plans.registry import query, table

_COS = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / nullif(sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 0)"


@query(f"""
WITH s AS (SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.embedding IS NOT NULL)
SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 10""")
def vec_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 7").first()["embedding"]
    return vector.cosine_topk(vectors, asked, 10).withColumn("score", F.round("score", 6))


_MANY = f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 6) AS score, e.label AS label, q.label AS gold FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)"""


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all vectors, ranked by scores of six places as the SQL is."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.cosine_topk_many(vectors, queries, 6, places=6)


@query(_MANY + "SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 6")
def vec_cosine_topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _many(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(_MANY + """, f AS (SELECT query_id, min(CASE WHEN label = gold AND vec_id <> query_id THEN rank END) AS rank FROM r WHERE rank <= 6 GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 2 THEN 1 ELSE 0 END), 6) AS hit_at_2, round(avg(CASE WHEN rank <= 6 THEN 1 ELSE 0 END), 6) AS hit_at_6, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM f""")
def vec_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = _many(spark, sf_dir).join(labels, "vec_id").join(labels.toDF("query_id", "gold"), "query_id")
    gold = F.when((F.col("label") == F.col("gold")) & (F.col("vec_id") != F.col("query_id")), F.col("rank"))
    return evaluate.rank_metrics(found.groupBy("query_id").agg(F.min(gold).alias("rank")), (2, 6))


@query(_MANY + "SELECT query_id, round(avg(CASE WHEN label = gold THEN 1 ELSE 0 END), 6) AS precision FROM r WHERE rank <= 6 GROUP BY 1")
def vec_type_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    found = _many(spark, sf_dir).join(labels, "vec_id").join(labels.toDF("query_id", "gold"), "query_id")
    return found.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("gold")).cast("int")), 6).alias("precision"))


@query("""
WITH h AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:16] AS v FROM embeddings)
SELECT vec_id, CAST(unnest(range(len(v))) AS INTEGER) AS place, round(unnest(v) / sqrt(list_dot_product(v, v)), 6) AS x FROM h""")
def vec_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(V.truncate(F.col("embedding"), 16)).alias("place", "x"))
    return cut.select("vec_id", "place", F.round("x", 6).alias("x"))


_FNV = "list_reduce(list_concat([CAST(2166136261 AS BIGINT)], list_transform(string_split({}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def fnv_sql(text: str) -> str:
    return _FNV.format(text)


_HASHED = f"""
WITH v AS (SELECT DISTINCT unnest({terms_sql('text')}) AS term FROM documents),
k AS (SELECT term, CAST({_FNV.format('term')} % 256 AS INTEGER) AS bucket, CASE WHEN {_FNV.format("term || '#'")} % 2 = 1 THEN 1.0 ELSE -1.0 END AS sign FROM v),
d AS (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents),
s AS (SELECT doc_id, bucket, CAST(sum(sign) AS DOUBLE) AS w FROM d JOIN k USING (term) GROUP BY ALL HAVING sum(sign) <> 0),
n AS (SELECT doc_id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM s)"""


@query(_HASHED + "SELECT doc_id, bucket, round(weight, 6) AS weight FROM n")
def vec_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.hash_vectors(table(spark, sf_dir, "documents"), 256).withColumn("weight", F.round("weight", 6))


@query(_HASHED + """, q AS (SELECT * FROM n WHERE doc_id % 100 = 0), i AS (SELECT DISTINCT doc_id FROM n), qi AS (SELECT DISTINCT doc_id FROM q), p AS (SELECT q.doc_id AS query_id, n.doc_id, sum(q.weight * n.weight) AS score FROM q JOIN n USING (bucket) GROUP BY ALL),
c AS (SELECT qi.doc_id AS query_id, i.doc_id, coalesce(score, 0) AS score FROM qi CROSS JOIN i LEFT JOIN p ON p.query_id = qi.doc_id AND p.doc_id = i.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM c)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def vec_hash_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return vector.hash_topk(docs, asked, 3, 256).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, round(coalesce(" + _COS.replace("q.embedding", "[0.0 for x in e.embedding]") + ", 0), 6) AS score FROM embeddings e")
def vec_zero_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.cosine(F.col("embedding"), zero), 6).alias("score"))
