"""Evaluation, audit and rendering queries, and the graph lane's gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.engine import Engine
from wayfind.operators import audit, claims, evaluate, execution_match, fusion, graph, keyword, sql_lane, vector
from wayfind.plans.documents import terms_sql
from wayfind.plans.registry import query, table
from wayfind.plans.vectors import fnv_sql
from wayfind.sources import kg


@query("SELECT p_partkey, '[S] p_partkey=' || p_partkey || ' | p_name=' || p_name || ' | p_size=' || coalesce(CAST(nullif(p_size, 7) AS VARCHAR), 'null') AS text FROM part")
def sql_render_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.nullif("p_size", F.lit(7)).alias("p_size"))
    text = sql_lane.render_rows(part, "S")
    return text.select(F.regexp_extract("text", r"p_partkey=(\d+)", 1).cast("long").alias("p_partkey"), "text")


@query("SELECT conv_id, turn, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')) AS n FROM conversations")
def txt_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(claims.sentences(F.col("text"))).cast("long").alias("n"))


@query("""
WITH a AS (SELECT conv_id, turn, text FROM conversations), b AS (SELECT conv_id, turn + 1 AS turn, string_split(text, ' ') AS req FROM conversations),
j AS (SELECT a.conv_id, a.turn, text, list_filter(list_distinct(req), lambda w: regexp_matches(w, '^[A-Za-z]{4,}$')) AS req FROM a JOIN b USING (conv_id, turn))
SELECT conv_id, turn, round(len(list_filter(req, lambda w: contains(text, w) OR contains(regexp_replace(text, '[,\\s]', '', 'g'), w))) / nullif(len(req), 0), 3) AS rate FROM j""")
def claims_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the words of one turn the next one holds."""
    turns = table(spark, sf_dir, "conversations")
    words = F.filter(F.array_distinct(F.split("text", " ")), lambda w: w.rlike("^[A-Za-z]{4,}$"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), words.alias("required"))
    rows = turns.select("conv_id", "turn", F.col("text").alias("context")).join(before, ["conv_id", "turn"]).withColumn("query_id", F.struct("conv_id", "turn"))
    return claims.completeness(rows).select("query_id.conv_id", "query_id.turn", "rate")


@query("""
WITH g AS (SELECT n_regionkey AS query_id, list(n_name) AS gold, string_agg(CASE WHEN n_nationkey % 3 <> 0 THEN n_name END, ' ') AS text FROM nation GROUP BY 1)
SELECT query_id, round(len(list_filter(gold, lambda x: contains(text, x))) / len(gold), 6) AS recall FROM g""")
def ev_name_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    seen = F.concat_ws(" ", F.collect_list(F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name"))))
    return evaluate.name_recall(nation.groupBy(F.col("n_regionkey").alias("query_id")).agg(F.collect_list("n_name").alias("gold"), seen.alias("text")))


_RUNS = "WITH r AS (SELECT CAST(doc_id % 5 AS INTEGER) AS run, CAST(doc_id // 5 AS BIGINT) AS item, quality = 1 AS correct FROM labels)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).cast("int").alias("run"), F.expr("doc_id div 5").alias("item"), (F.col("quality") == 1).alias("correct"))


@query(_RUNS + ", c AS (SELECT run, sum(CAST(correct AS INTEGER)) AS c FROM r GROUP BY 1) SELECT CAST(list_sort(list(c))[len(list(c)) // 2 + 1] AS BIGINT) AS median, CAST(min(c) AS BIGINT) AS least, CAST(max(c) AS BIGINT) AS most FROM c")
def ev_repeat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.repeat_summary(_runs(spark, sf_dir))


@query(_RUNS + "SELECT item, CASE WHEN count(*) FILTER (NOT correct) = count(*) THEN 'always_wrong' WHEN count(*) FILTER (NOT correct) > 0 THEN 'flaky' ELSE 'stable' END AS state FROM r GROUP BY 1")
def ev_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.stability(_runs(spark, sf_dir))


@query("SELECT 'set' AS kind, true AS same UNION ALL SELECT 'multiset', false UNION ALL SELECT 'renamed', true")
def ev_set_vs_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result with repeated rows against its distinct rows, and against itself under other names."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    pairs = [("set", evaluate.frames_match(rows, rows.distinct(), distinct=True)), ("multiset", evaluate.frames_match(rows, rows.distinct())), ("renamed", evaluate.frames_match(rows, rows.toDF("a", "b")))]
    return spark.createDataFrame(pairs, "kind string, same boolean")


@query(f"""
WITH qs(query_id, query) AS (VALUES (0, 'the thing that is heard'), (1, 'license 2 Product-C1')),
al AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', query_id, query FROM qs),
tm AS (SELECT kind, id, unnest({terms_sql('text')}) AS term FROM al),
k AS (SELECT term, CAST({fnv_sql('term')} % 768 AS INTEGER) AS bucket, CASE WHEN {fnv_sql("term || '#'")} % 2 = 1 THEN 1.0 ELSE -1.0 END AS sign FROM (SELECT DISTINCT term FROM tm)),
s AS (SELECT kind, id, bucket, CAST(sum(sign) AS DOUBLE) AS w FROM tm JOIN k USING (term) GROUP BY ALL HAVING sum(sign) <> 0),
n AS (SELECT kind, id, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY kind, id)) AS weight FROM s),
c AS (SELECT q.id AS query_id, d.id AS doc_id, sum(q.weight * d.weight) AS score FROM n q JOIN n d ON q.kind = 'q' AND d.kind = 'd' AND q.bucket = d.bucket GROUP BY ALL),
dense AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM c QUALIFY rank <= 5),
p(query_id, prefix) AS (VALUES (0, 'the'), (0, 'thing'), (0, 'that'), (0, 'is'), (0, 'heard'), (0, 'thething'), (0, 'thingthat'), (0, 'thatis'), (0, 'isheard'), (1, 'license'), (1, 'product'), (1, '제품'), (1, 'c1'), (1, 'license2'), (1, '2product'), (1, 'productc1')),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS ws FROM documents),
t AS (SELECT DISTINCT doc_id, unnest(list_concat(list_concat(list_concat(list_filter(ws, lambda x: length(x) >= 2), CASE WHEN list_contains(ws, 'product') THEN ['제품'] ELSE [] END),
  flatten(list_transform(list_filter(ws, lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]')), lambda x: list_filter(regexp_extract_all(x, '([a-z]+|[0-9]+)', 1), lambda y: length(y) >= 2)))),
  list_filter(list_transform(range(1, len(ws)), lambda i: ws[i] || ws[i + 1]), lambda x: length(x) BETWEEN 2 AND 24))) AS token FROM w),
h AS (SELECT query_id, doc_id, count(DISTINCT token) AS score FROM t JOIN p ON starts_with(token, prefix) GROUP BY ALL),
words AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= 5),
f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM dense UNION ALL SELECT * FROM words) GROUP BY ALL),
fused AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM fused WHERE query_id = 1 UNION ALL SELECT query_id, doc_id, rank FROM dense WHERE query_id = 0""")
def kw_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and keyword lists of two questions, fused where the question names an identifier or dense found nothing."""
    docs = table(spark, sf_dir, "documents")
    asked = spark.createDataFrame([(0, "the thing that is heard"), (1, "license 2 Product-C1")], "query_id long, query string")
    dense = vector.hash_topk(docs, asked, 5)
    words = keyword.keyword_search(keyword.build_index(docs), asked)
    lists = dense.select("query_id", F.lit(0).alias("list_idx"), "rank", F.col("doc_id").alias("key")).unionByName(words.select("query_id", F.lit(1).alias("list_idx"), "rank", F.col("doc_id").alias("key")))
    fused = fusion.rrf_merge(lists).select("query_id", F.col("key").alias("doc_id"), "rank")
    return keyword.gated(dense.select("query_id", "doc_id", "rank"), fused, asked)


@query("""
SELECT doc_id AS query_id, sha256('{"query":"q' || doc_id || '","route":"' || lang || '","tools":["t"]}') AS rule_fingerprint, CAST(least(length(text), 120) AS INTEGER) AS n_preview,
 '[withheld: ' || least(length(text), 120) || ' characters, sha256:' || substr(sha256(substr(text, 1, 120)), 1, 12) || ']' AS preview FROM documents""")
def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a document: its rule fingerprint, and its preview withheld for publication."""
    docs = table(spark, sf_dir, "documents")
    runs = docs.select(
        F.col("doc_id").alias("query_id"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query"), F.col("lang").alias("route"), F.array(F.lit("t")).alias("tools"),
        F.lit(None).cast("string").alias("sql"), F.lit(None).cast("boolean").alias("sql_ok"), F.array().cast("array<string>").alias("errors"),
        F.array(F.struct(F.concat(F.lit("documents#"), F.col("doc_id").cast("string")).alias("key"), F.lit(1 / 61).alias("score"), F.array(F.lit("vector")).alias("sources"), "text")).alias("fused"),
        F.array(F.lit(0)).alias("kept"), F.array().cast("array<int>").alias("dropped"), F.lit(1).alias("tokens_used"), F.lit(256).alias("budget"),
    )
    made = audit.audit_records(runs)
    shown = made.select("query_id", F.length(F.col("fusion")[0]["preview"]).alias("n_preview"))
    hidden = audit.redact(made).select("query_id", "rule_fingerprint", F.col("fusion")[0]["preview"].alias("preview"))
    return hidden.join(shown, "query_id")


@query("""
WITH q(query_id, term) AS (VALUES (1, 'customer_7'), (2, 'Ghost-Z')), n AS (SELECT c_name AS name FROM customer UNION SELECT 'customer_' || c_custkey FROM customer UNION SELECT c_mktsegment FROM customer
 UNION SELECT s_name FROM supplier UNION SELECT 'supplier_' || s_suppkey FROM supplier UNION SELECT p_name FROM part UNION SELECT 'part_' || p_partkey FROM part UNION SELECT p_brand FROM part UNION SELECT p_type FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region)
SELECT CAST(query_id AS INTEGER) AS query_id, CASE WHEN EXISTS (SELECT 1 FROM n WHERE lower(name) LIKE '%' || lower(term) || '%') THEN 'resolved' ELSE 'unresolved' END AS state FROM q""")
def kg_absent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question that names nothing in the graph is told so by the graph lane instead of being given edges."""
    engine = Engine(spark, entities=kg.entities(spark, sf_dir), aliases=kg.aliases(spark, sf_dir), relations=kg.relations(spark, sf_dir))
    lanes = [engine.graph_lane(q, depth=1).select(F.lit(i).alias("query_id"), "key") for i, q in ((1, "customer_7 담당"), (2, "Ghost-Z 담당"))]
    return lanes[0].union(lanes[1]).groupBy("query_id").agg(F.when(F.max(F.startswith("key", F.lit("unresolved#"))), "unresolved").otherwise("resolved").alias("state"))


@query("""
WITH g AS (SELECT n_regionkey AS query_id, list_distinct(list(n_name)) AS gold, coalesce(string_agg(n_name, ' ') FILTER (n_nationkey % 5 <> 0), '') AS context,
  CASE WHEN n_regionkey = 0 THEN 'not found' ELSE coalesce(string_agg(n_name, ' ') FILTER (n_nationkey % 4 = 0), '') END AS answer, n_regionkey = 0 AS absent FROM nation GROUP BY n_regionkey),
c AS (SELECT *, list_filter((SELECT list(DISTINCT n_name) FROM nation), lambda x: contains(answer, x)) AS said FROM g)
SELECT query_id, round(len(list_filter(gold, lambda x: contains(context, x))) / len(gold), 6) AS evidence, CASE WHEN len(said) > 0 THEN len(list_filter(said, lambda x: NOT contains(context, x))) = 0 END AS grounded,
 CASE WHEN absent THEN regexp_matches(answer, 'not found') END AS abstained FROM c""")
def ev_answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of some names of a region over a context of others: evidence, grounding, abstention."""
    nation = table(spark, sf_dir, "nation")
    some = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("n_nationkey", "n_name")))), lambda x: x["n_name"]), " ")
    rows = nation.groupBy(F.col("n_regionkey").alias("query_id")).agg(F.collect_list("n_name").alias("gold"), some(F.col("n_nationkey") % 5 != 0).alias("context"), some(F.col("n_nationkey") % 4 == 0).alias("answer"))
    rows = rows.withColumns({"answer": F.when(F.col("query_id") == 0, "not found").otherwise(F.col("answer")), "absent": F.col("query_id") == 0})
    return evaluate.answer_checks(rows, nation.select(F.col("n_name").alias("name")))


@query("""
SELECT 'entity:nation#' || (n_nationkey + 100) AS id, n_name AS canonical_name, 'nation_' || n_nationkey AS alias, CAST(n_nationkey AS VARCHAR) AS source_pk FROM nation""")
def src_kg_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of nations and regions projected into graph tables."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    empty = F.create_map().cast("map<string,string>")
    nodes = nation.select((F.col("n_nationkey") + 99).alias("pos"), F.concat(F.lit("nation_"), "n_nationkey").alias("id"), F.lit("nation").alias("type"), F.col("n_name").alias("name"), empty.alias("properties"))
    nodes = nodes.unionByName(region.select((F.col("r_regionkey")).alias("pos"), F.concat(F.lit("region_"), "r_regionkey").alias("id"), F.lit("region").alias("type"), F.col("r_name").alias("name"), empty.alias("properties")))
    edges = nation.select(F.col("n_nationkey").alias("pos"), F.concat(F.lit("nation_"), "n_nationkey").alias("source"), F.concat(F.lit("region_"), "n_regionkey").alias("target"), F.lit("IN_REGION").alias("relation"))
    made = kg.project(nodes, edges)
    ents = made["entities"].where("type = 'nation'")
    out = ents.join(made["aliases"].select(F.col("entity_id").alias("id"), "alias"), "id").join(made["entity_links"].select(F.col("entity_id").alias("id"), "source_pk"), "id")
    return out.select(graph.entity_key(F.col("type"), F.col("id")).alias("id"), "canonical_name", "alias", "source_pk")


@query("SELECT doc_id, lang || chr(10) || text AS text FROM documents")
def vec_embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", vector.embed_text(F.col("lang"), F.col("text")).alias("text"))


_BAGS = "(NOT EXISTS ({a} EXCEPT ALL {b}) AND NOT EXISTS ({b} EXCEPT ALL {a}))"
_ORDERS = "SELECT list_sort([CAST(o_orderkey AS DOUBLE), o_custkey, {}]) AS r FROM orders"
_SEQUENCE = "(SELECT row_number() OVER (ORDER BY o_totalprice {}, o_orderkey) AS i, o_orderkey AS k FROM orders)"
_COPIES = {
    "turned": _BAGS.format(a=_ORDERS.format("o_totalprice"), b=_ORDERS.format("o_totalprice")),
    "repeated": _BAGS.format(a=_ORDERS.format("o_totalprice"), b="(" + _ORDERS.format("o_totalprice") + " UNION ALL " + _ORDERS.format("o_totalprice") + " WHERE o_orderkey % 100 = 1)"),
    "changed": _BAGS.format(a=_ORDERS.format("o_totalprice"), b=_ORDERS.format("o_totalprice + CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END")),
    "close": _BAGS.format(a=_ORDERS.format("floor(o_totalprice + 0.5)"), b=_ORDERS.format("floor(o_totalprice + 0.0001 + 0.5)")),
    "wider": _BAGS.format(a=_ORDERS.format("o_totalprice"), b=_ORDERS.format("o_totalprice")),
    "in order": f"NOT EXISTS (SELECT 1 FROM {_SEQUENCE.format('DESC')} a FULL JOIN {_SEQUENCE.format('DESC')} b USING (i) WHERE a.k IS DISTINCT FROM b.k)",
    "other order": f"NOT EXISTS (SELECT 1 FROM {_SEQUENCE.format('DESC')} a FULL JOIN {_SEQUENCE.format('ASC')} b USING (i) WHERE a.k IS DISTINCT FROM b.k)",
}


@query(" UNION ALL ".join(f"SELECT '{kind}' AS kind, {test} AS same" for kind, test in _COPIES.items()))
def ev_execution_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders against copies that are turned, repeated in part, changed, moved a little, wider, and in other orders."""
    orders = table(spark, sf_dir, "orders")
    gold = orders.select("o_orderkey", "o_custkey", "o_totalprice")
    match, options = execution_match.frames_results_match, evaluate.MatchOptions
    moved = lambda by: gold.withColumn("o_totalprice", F.col("o_totalprice") + by)
    down, up = [F.desc("o_totalprice"), F.col("o_orderkey")], [F.col("o_totalprice"), F.col("o_orderkey")]
    found = {
        "turned": match(gold.select(F.col("o_totalprice").alias("x"), "o_custkey", F.col("o_orderkey").cast("string")), gold),
        "repeated": match(gold.unionByName(gold.where("o_orderkey % 100 = 1")), gold),
        "changed": match(moved(F.when(F.col("o_custkey") % 7 == 0, 1).otherwise(0)), gold),
        "close": match(moved(0.0001), gold, options(numeric_tolerance=1.0)),
        "wider": match(orders.select("o_totalprice", "o_orderstatus", "o_orderkey", "o_custkey"), gold, options(subset_columns=True)),
        "in order": match(gold, gold, options(ordered=True), down, down),
        "other order": match(gold, gold, options(ordered=True), down, up),
    }
    return spark.createDataFrame(list(found.items()), "kind string, same boolean")
