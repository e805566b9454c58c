"""The SQL lane on the star schema: filters, joins, aggregates, order, sets and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators import graph
from wayfind.operators.places import places
from wayfind.plans.registry import query, sql_query, table
from wayfind.sources import kg

MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

FLAGSHIP = f"""
SELECT n_name, count(*) AS n_orders, {MONEY.format("o_totalprice")} AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY total DESC, n_name LIMIT 10"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by nation, through the guard."""
    from wayfind.plans.registry import QUERIES

    return QUERIES["sql_join3_group_topk"](spark, sf_dir)


sql_query("sql_join3_group_topk", FLAGSHIP)
sql_query("sql_count", "SELECT count(*) AS n FROM lineitem")
sql_query("sql_count_filter", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
sql_query("sql_count_distinct", "SELECT count(DISTINCT o_custkey) AS n_customers, count(DISTINCT o_orderpriority) AS n_priorities FROM orders")
sql_query("sql_min_max_avg", "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean FROM orders")
sql_query("sql_projection_arithmetic", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 2) AS worth FROM lineitem")
sql_query("sql_in_list", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderpriority")
sql_query("sql_between_dates", "SELECT count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00'", None)
sql_query("sql_half_open_range", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-04-01' GROUP BY o_orderstatus")
sql_query("sql_is_null", "SELECT count(*) AS n_left FROM labels RIGHT JOIN documents ON labels.doc_id = documents.doc_id WHERE labels.doc_id IS NULL")
sql_query("sql_is_not_null", "SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
sql_query("sql_scalar_subquery", "SELECT count(*) AS n FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
sql_query("sql_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%' || 'a' || '%' AND lower(p_brand) LIKE 'brand%'")
sql_query("sql_json_path", "SELECT get_json_object(props, '$.k') AS k, count(*) AS n FROM events GROUP BY get_json_object(props, '$.k')", "SELECT props->>'$.k' AS k, count(*) AS n FROM events GROUP BY 1")
sql_query("sql_impossible", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'none such'")
sql_query("sql_case_extract_round", "SELECT extract(YEAR FROM o_orderdate) AS y, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_f, CAST(round(avg(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1 ELSE 0 END), 6) AS DOUBLE) AS share_p FROM orders GROUP BY extract(YEAR FROM o_orderdate)", "SELECT CAST(extract(YEAR FROM o_orderdate) AS INTEGER) AS y, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_f, round(avg(CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1 ELSE 0 END), 6) AS share_p FROM orders GROUP BY 1")
sql_query("sql_cast", "SELECT o_orderkey::string AS k, (o_totalprice::decimal(18,2) * 2)::double AS twice FROM orders", "SELECT o_orderkey::VARCHAR AS k, (o_totalprice::DECIMAL(18,2) * 2)::DOUBLE AS twice FROM orders")
sql_query("sql_join2_group", f"SELECT c_mktsegment, count(*) AS n, {MONEY.format('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
sql_query("sql_join4_group", f"SELECT r_name, p_brand, {MONEY.format('l_extendedprice')} AS worth FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY r_name, p_brand")
sql_query("sql_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-02-01')")
sql_query("sql_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
sql_query("sql_full_join", "SELECT count(*) AS n, count(a.k) AS n_a, count(b.k) AS n_b FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) a FULL OUTER JOIN (SELECT p_partkey AS k FROM part WHERE p_size > 20) b ON a.k = b.k")
sql_query("sql_sum_expression", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql_query("sql_argmax", "SELECT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1")
sql_query("sql_order_by_hidden_aggregate", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY max(c_acctbal) DESC, c_mktsegment LIMIT 3")
sql_query("sql_topk_tiebreak", "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 25")
sql_query("sql_topk_values", "SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 10")
sql_query("sql_union_all_cte", "WITH a AS (SELECT n_name AS name, 'nation' AS kind FROM nation), b AS (SELECT r_name AS name, 'region' AS kind FROM region) SELECT kind, count(*) AS n, min(name) AS first_name FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u GROUP BY kind")
sql_query("sql_set_operations", "SELECT 'except' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) x UNION ALL SELECT 'intersect' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) y")
sql_query("sql_string_agg", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
sql_query("sql_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql_query("sql_having_rollup", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING count(*) > 10")
sql_query("sql_window_share", "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS place FROM customer")


@query("SELECT t AS table_name, n FROM (SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents)")
def src_load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg.load_report({t: table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "documents")})


@query("""
WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT k AS entity_id, n AS count, CAST(rank() OVER (ORDER BY n DESC) AS INTEGER) AS rank, count(*) OVER (PARTITION BY n) > 1 AS tied FROM c""")
def win_competition_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks 1 2 2 4 with a tie mark, without one window over all rows: ranks come from the distinct counts."""
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.lit("").alias("src_name"), F.lit("").alias("src_type"))
    return graph.degree_ranking(edges, "source").select("entity_id", "count", "rank", "tied")


@query("""
SELECT c_name AS name, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_regionkey = 1) GROUP BY c_name""")
def multi_step_join_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan's last step: an allowed aggregate of fact rows for the names that the steps before found."""
    from wayfind.operators.multistep import end_points, join_aggregate

    ents, rels = kg.entities(spark, sf_dir), kg.relations(spark, sf_dir, ("IN_REGION", "IN_NATION"))
    region = spark.createDataFrame([(0, kg.OFFSETS["region"] + 1)], "query_id long, seed long")
    nations = end_points(region, rels, ents, ["IN_REGION"], 1, ["nation"])
    customers = end_points(nations.select("query_id", F.col("id").alias("seed")), rels, ents, ["IN_NATION"], 1, ["customer"])
    orders = table(spark, sf_dir, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    out = join_aggregate(orders, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "c_name", customers, "sum")
    return out.withColumn("value", F.col("value").cast("double"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: the streaming windows run over the event table as a batch."""
    from wayfind.streaming import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).select(F.to_date("window_start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT documents.doc_id AS doc_id, quality, row_number() OVER (ORDER BY quality ASC NULLS LAST, documents.doc_id) AS place_last, row_number() OVER (ORDER BY quality DESC NULLS FIRST, documents.doc_id) AS place_first FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id")
def sql_null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls last and nulls first over all documents, placed by ranges instead of in one task."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    last = places(rows, [F.col("quality").asc_nulls_last(), F.col("doc_id")], name="place_last")
    return places(last, [F.col("quality").desc_nulls_first(), F.col("doc_id")], name="place_first")
