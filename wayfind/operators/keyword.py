"""Keyword search over an inverted index of normalised tokens."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import text as T

IDENTIFIER = "[A-Za-z]+[-_ ]?[A-Za-z]?[0-9]+|[A-Za-z]+-[A-Z][A-Za-z0-9]*"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nfkc: bool = True) -> DataFrame:
    """id, token: the distinct normalised tokens of each document."""
    return docs.select(F.col(id_col), F.explode(T.normalize_tokens(F.col(text_col), nfkc)).alias("token"))


def has_index(index: DataFrame | None) -> bool:
    """A missing index switches the lane off; it is not a failure."""
    return index is not None and {"token"} <= set(index.columns)


def keyword_search(index: DataFrame, queries: DataFrame, k: float = 5, id_col: str = "doc_id", nfkc: bool = True) -> DataFrame:
    """query_id, id, score, rank; queries: query_id, query. score: distinct document tokens that begin with a query token.

    Index and query meet on the first two characters, which every token has, so the prefix test runs inside an equi-join.
    """
    k = min(50, max(1, math.floor(k)))
    asked = queries.select("query_id", F.explode(T.normalize_tokens(F.col("query"), nfkc)).alias("prefix")).withColumn("head", F.substring("prefix", 1, 2))
    hits = index.withColumn("head", F.substring("token", 1, 2)).join(asked, "head").where(F.startswith("token", F.col("prefix")))
    scored = hits.select("query_id", id_col, "token").distinct().groupBy("query_id", id_col).agg(F.count("*").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gated(dense: DataFrame, fused: DataFrame, queries: DataFrame) -> DataFrame:
    """Fused ranks for questions with an identifier or without a dense hit, dense ranks for the others."""
    found = dense.select("query_id").distinct().withColumn("dense", F.lit(True))
    gate = queries.join(found, "query_id", "left").select("query_id", (F.col("query").rlike(IDENTIFIER) | F.col("dense").isNull()).alias("open"))
    keep = lambda df, want: df.join(gate.where(F.col("open") == want).select("query_id"), "query_id", "left_semi")
    return keep(fused, True).unionByName(keep(dense, False))
