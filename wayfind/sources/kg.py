"""Knowledge graphs: projected from node and edge lists, or derived from the foreign keys of relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.sources.sinks import bounded

#: Entity id offsets of the derived graph; ranges stay apart up to these many rows.
OFFSETS = {"region": 1, "nation": 100, "supplier": 1_000_000_000, "customer": 2_000_000_000, "part": 3_000_000_000}
NAME_COLUMNS = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name"), "supplier": ("s_suppkey", "s_name"), "customer": ("c_custkey", "c_name"), "part": ("p_partkey", "p_name")}
ATTRIBUTES = {"customer": ["c_mktsegment"], "part": ["p_brand", "p_type"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, canonical_name, ext_id."""
    parts = []
    for kind, (key, name) in NAME_COLUMNS.items():
        parts.append(table(spark, sf_dir, kind).select((F.col(key).cast("long") + OFFSETS[kind]).alias("id"), F.lit(kind).alias("type"), F.col(name).alias("canonical_name"), F.concat(F.lit(f"{kind}_"), F.col(key)).alias("ext_id")))
    return reduce(DataFrame.unionByName, parts)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, alias, lang: the external id and the text attributes."""
    parts = []
    for kind, (key, _) in NAME_COLUMNS.items():
        df = table(spark, sf_dir, kind)
        values = F.array(F.concat(F.lit(f"{kind}_"), F.col(key)), *[F.col(a) for a in ATTRIBUTES.get(kind, [])])
        parts.append(df.select((F.col(key).cast("long") + OFFSETS[kind]).alias("entity_id"), F.explode(F.array_distinct(values)).alias("alias")))
    out = reduce(DataFrame.unionByName, parts).where(F.length("alias") >= 2)
    return out.withColumn("lang", F.when(F.col("alias").rlike("[가-힣]"), "ko").otherwise("en"))


def relations(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("IN_REGION", "IN_NATION", "SUPPLIES", "ORDERED"), distinct: bool = True) -> DataFrame:
    """src, rel_type, dst, distinct (unless a caller does without). An edge is identified by these three, and ordered by them where an order is needed."""
    t = lambda name: table(spark, sf_dir, name)
    at = lambda kind, column: (F.col(column).cast("long") + OFFSETS[kind])
    made = {
        "IN_REGION": lambda: [t("nation").select(at("nation", "n_nationkey").alias("src"), at("region", "n_regionkey").alias("dst"))],
        "IN_NATION": lambda: [t("customer").select(at("customer", "c_custkey").alias("src"), at("nation", "c_nationkey").alias("dst")), t("supplier").select(at("supplier", "s_suppkey").alias("src"), at("nation", "s_nationkey").alias("dst"))],
        "SUPPLIES": lambda: [t("lineitem").select(at("supplier", "l_suppkey").alias("src"), at("part", "l_partkey").alias("dst"))],
        "ORDERED": lambda: [t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(at("customer", "o_custkey").alias("src"), at("part", "l_partkey").alias("dst"))],
    }
    parts = [(p.distinct() if distinct and kind in ("SUPPLIES", "ORDERED") else p).select("src", F.lit(kind).alias("rel_type"), "dst") for kind in kinds for p in made[kind]()]
    return reduce(DataFrame.unionByName, parts)


def relations_at(spark: SparkSession, sf_dir: str, seeds: DataFrame) -> DataFrame:
    """seed, src, rel_type, dst, depth (1): the edges of relations() at each of `seeds` (seed, distinct), for seeds that are few beside the graph.

    Orders and line items meet only where a seed's are on one side, so neither table is joined or made distinct as a whole.
    """
    seeds = bounded(seeds.select("seed").where("seed IS NOT NULL"), "near")
    t = lambda name: table(spark, sf_dir, name)
    at = lambda kind, column: F.col(column).cast("long") + OFFSETS[kind]
    near = lambda df, end: df.join(seeds, F.col("seed") == F.col(end))
    few = relations(spark, sf_dir, ("IN_REGION", "IN_NATION", "SUPPLIES"), distinct=False)
    orders = t("orders").where("o_orderkey IS NOT NULL").select(F.col("o_orderkey").alias("key"), at("customer", "o_custkey").alias("src"))
    items = t("lineitem").where("l_orderkey IS NOT NULL").select(F.col("l_orderkey").alias("key"), at("part", "l_partkey").alias("dst"))
    ordered = [bounded(near(orders, "src"), "orders-near").join(items, "key"), orders.join(bounded(near(items, "dst"), "items-near"), "key")]
    ends = [near(few, "src"), near(few, "dst"), *[df.withColumn("rel_type", F.lit("ORDERED")) for df in ordered]]
    edges = reduce(DataFrame.unionByName, [df.select("seed", "src", "rel_type", "dst") for df in ends])
    return edges.where("src IS NOT NULL AND dst IS NOT NULL").distinct().withColumn("depth", F.lit(1))


def project(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """Tables of a property graph from nodes (pos, id, type, name, properties map) and edges (pos, source, target, relation).

    Ids are positions plus one; aliases are the node id and every property value of two characters or more except
    `size`; links take the number at the end of the node id. An edge with an unknown end raises.
    """
    ents = nodes.select((F.col("pos") + 1).cast("long").alias("id"), "type", F.col("name").alias("canonical_name"), F.col("id").alias("ext_id"), "properties")
    values = F.transform(F.filter(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>"))), lambda e: (e["key"] != "size") & (F.length(e["value"]) >= 2)), lambda e: e["value"])
    names = ents.select(F.col("id").alias("entity_id"), F.explode(F.array_distinct(F.concat(F.array("ext_id"), values))).alias("alias"))
    names = names.withColumn("lang", F.when(F.col("alias").rlike("[가-힣]"), "ko").otherwise("en"))
    links = ents.withColumn("source_pk", F.regexp_extract("ext_id", r"_(\d+)$", 1)).where("source_pk <> ''")
    links = links.select(F.col("id").alias("entity_id"), F.lit("sql").alias("source_kind"), F.col("type").alias("source_table"), "source_pk")
    ends = ents.select(F.col("ext_id").alias("e"), F.col("id").alias("i"))
    joined = edges.join(ends.toDF("source", "src"), "source", "left").join(ends.toDF("target", "dst"), "target", "left")
    bad = joined.where("src IS NULL OR dst IS NULL").select("source", "target").limit(3).collect()
    if bad:
        raise ValueError(f"edges without a node: {[tuple(r) for r in bad]}")
    rels = joined.select((F.col("pos") + 1).cast("long").alias("id"), "src", F.col("relation").alias("rel_type"), "dst")
    return {"entities": ents, "aliases": names, "relations": rels, "entity_links": links}


def type_pairs(edges: DataFrame, ents: DataFrame) -> DataFrame:
    """from_type, to_type, relation: for each pair of types, either way, the relation of the first edge: that of the least
    id, or where edges have none, the first by relation, source and destination."""
    kinds = ents.select("id", "type")
    # The first edge of two types is the first of those between a type and its other end, so after the types of the sources are
    # known one edge is left for each type, relation and destination, and only those are joined again.
    first, order = ("id", F.struct("id")) if "id" in edges.columns else ("src", F.struct("rel_type", "src", "dst"))
    sources = edges.join(kinds.toDF("src", "a"), "src").groupBy("a", "rel_type", "dst").agg(F.min(F.struct(first))[first].alias(first))
    typed = sources.join(kinds.toDF("dst", "b"), "dst").select(order.alias("edge"), "rel_type", "a", "b")
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("a").alias("from_type"), F.col("b").alias("to_type")), F.struct(F.lit(1).alias("way"), F.col("b").alias("from_type"), F.col("a").alias("to_type"))))
    both = typed.select("edge", "rel_type", ways.alias("w")).select("edge", "rel_type", "w.*")
    return both.groupBy("from_type", "to_type").agg(F.min_by("rel_type", F.struct("edge", "way")).alias("relation"))


def lexicon(ents: DataFrame, names: DataFrame | None) -> DataFrame:
    """name, type, pos: what the router knows by name, canonical names before aliases, each by entity id. Aliases that are
    missing or cannot be read are left out; names alone still serve."""
    own = ents.select(F.col("canonical_name").alias("name"), "type", F.struct(F.lit(0).alias("a"), F.col("id").alias("b")).alias("pos"))
    try:
        other = names.select(F.col("entity_id").alias("id"), "alias").join(ents.select("id", "type"), "id")
        other = other.select(F.col("alias").alias("name"), "type", F.struct(F.lit(1).alias("a"), F.col("id").alias("b")).alias("pos"))
        other.schema  # noqa: B018 - columns are looked up now
    except (AttributeError, PySparkException):
        return own.where(F.length(F.btrim("name")) >= 2)
    return own.unionByName(other).where(F.length(F.btrim("name")) >= 2)


def load_report(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n for each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])
