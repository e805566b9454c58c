"""Reciprocal rank fusion over ranked lists of many questions: query_id, list_idx, rank (from 1), key, and what comes along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def _ordered_sum(parts: Column) -> Column:
    """Sum in list order, so that equal inputs give equal bits."""
    return F.aggregate(F.array_sort(parts), F.lit(0.0), lambda s, x: s + x["inc"])


def rrf_merge(ranked: DataFrame, k: int = K) -> DataFrame:
    """query_id, key, score, sources, rank. A list credits a key once, at its best place; places keep their gaps."""
    once = ranked.groupBy("query_id", "list_idx", "key").agg(F.min("rank").alias("rank"))
    parts = F.collect_list(F.struct("list_idx", (1.0 / (k + F.col("rank"))).alias("inc")))
    merged = once.groupBy("query_id", "key").agg(_ordered_sum(parts).alias("score"), F.array_sort(F.collect_set("list_idx")).alias("sources"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return merged.withColumn("rank", F.row_number().over(w))


def named_scores(ranked: DataFrame, k: int = K) -> DataFrame:
    """query_id, key, score, sources, text: as rrf_merge over lists with a source name and text, without places. Sources are
    distinct names in order; the text is that of the first list and place where the key was seen."""
    once = ranked.groupBy("query_id", "list_idx", "key").agg(F.min("rank").alias("rank"), F.min_by(F.struct("source", "text"), "rank").alias("x"))
    parts = F.collect_list(F.struct("list_idx", (1.0 / (k + F.col("rank"))).alias("inc")))
    return once.groupBy("query_id", "key").agg(
        _ordered_sum(parts).alias("score"),
        F.array_sort(F.collect_set("x.source")).alias("sources"),
        F.min_by("x.text", F.struct("list_idx", "rank")).alias("text"),
    )


def rrf_named(ranked: DataFrame, k: int = K) -> DataFrame:
    """named_scores with places: more sources win ties."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.size("sources")), "key")
    return named_scores(ranked, k).withColumn("rank", F.row_number().over(w))


def ranked_list(items: DataFrame, list_idx: int, order: list[Column], key: Column, source: str, text: Column) -> DataFrame:
    """A list for fusion, ranked in each question by the given order."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return items.select("query_id", F.lit(list_idx).alias("list_idx"), F.row_number().over(w).alias("rank"), key.alias("key"), F.lit(source).alias("source"), text.alias("text"))


def bridge(hits: DataFrame, links: DataFrame, entities: DataFrame, kind: str = "vector") -> DataFrame:
    """hits (doc_id) with the canonical key of the entity that a link names, else documents#id. Of several links the last
    in (entity_id) order holds."""
    own = links.where(F.col("source_kind") == kind).groupBy("document_id").agg(F.max("entity_id").alias("id"))
    known = own.join(entities.select("id", "type"), "id").select(F.col("document_id").alias("doc_id"), F.concat(F.lit("entity:"), "type", F.lit("#"), F.col("id").cast("string")).alias("e"))
    return hits.join(known, "doc_id", "left").withColumn("canonical_key", F.coalesce("e", F.concat(F.lit("documents#"), F.col("doc_id").cast("string")))).drop("e")


def rank_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, change: gained, lost, up, down or same, of the gold rank (null: not found) between two settings."""
    joined = before.select("query_id", F.col("rank").alias("a")).join(after.select("query_id", F.col("rank").alias("b")), "query_id", "full")
    change = F.when(F.col("a").isNull() & F.col("b").isNotNull(), "gained").when(F.col("a").isNotNull() & F.col("b").isNull(), "lost").when(F.col("b") < F.col("a"), "up").when(F.col("b") > F.col("a"), "down").otherwise("same")
    return joined.select("query_id", change.alias("change"))


def agreement(fused: DataFrame) -> DataFrame:
    """query_id, fused, agreed: the keys of each question, and those that more than one source found."""
    return fused.groupBy("query_id").agg(F.count("*").alias("fused"), F.sum((F.size("sources") > 1).cast("int")).cast("long").alias("agreed"))
