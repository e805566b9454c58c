"""Contexts under a token budget: whole rows or nothing, and the cutting baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.functions import text as T
from wayfind.sources.sinks import bounded, keep

#: Rows of cut items that go to all tasks, at most: tens of megabytes.
MOST_CUTS = 250_000


def curate(items: DataFrame, queries: DataFrame, budget: int = 256) -> DataFrame:
    """query_id, kept and dropped (array<int> of idx, in order), tokens_used, context.

    items: query_id, idx, text. Items are taken by shared content terms, then idx; one that does not fit is passed over and
    later ones may still fit. The fold runs over the items of one question.
    """
    asked = queries.select("query_id", T.content_terms(F.col("query")).alias("qt"))
    own = items.select("query_id", F.col("idx").cast("int").alias("idx"), T.content_terms(F.col("text")).alias("terms"), T.est_tokens(F.col("text")).alias("cost"))
    rated = own.join(asked, "query_id").select("query_id", "idx", "cost", F.size(F.array_intersect("terms", "qt")).alias("rel"))
    rows = rated.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("rel")).alias("r"), "idx", "cost"))).alias("rows"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    fold = F.aggregate(
        "rows",
        start,
        lambda s, x: F.when(s["used"] + x["cost"] <= budget, F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["kept"], F.array(x["idx"])).alias("kept"))).otherwise(s),
    )
    out = rows.withColumn("fold", fold).select(
        "query_id",
        F.array_sort("fold.kept").alias("kept"),
        F.array_sort(F.array_except(F.transform("rows", lambda x: x["idx"]), F.col("fold.kept"))).alias("dropped"),
        F.col("fold.used").alias("tokens_used"),
    )
    # Texts come in only now, and only those that are kept.
    chosen = out.select("query_id", F.explode("kept").alias("idx")).join(items.select("query_id", F.col("idx").cast("int").alias("idx"), "text"), ["query_id", "idx"])
    texts = chosen.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("context"))
    return out.join(texts, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


def curation_audit(curated: DataFrame, budget: int) -> DataFrame:
    return curated.select("query_id", F.size("kept").alias("n_kept"), F.size("dropped").alias("n_dropped"), "tokens_used", F.lit(budget).alias("budget"), F.lit(True).alias("structure_preserved"))


def naive_truncate(items: DataFrame, budget: int = 256) -> DataFrame:
    """query_id, cut, n_kept, n_dropped, broken_rows, tokens_used: all items joined by line feeds and cut where the estimate
    reaches the budget. items: query_id, idx, kind, text; null texts take no place.

    A line feed ends a token, so the estimate of the whole is the sum of those of its items. Each item is counted once where
    it is; running sums over the counts tell which item the cut falls into, and only that text is looked at again. Whole texts are never
    joined or, while the cut items are at most MOST_CUTS, shuffled. Items are read twice. Those of one place are ordered by kind, length and a hash.
    """
    key, budget = ["query_id", "idx", "kind", "n", "hash"], max(0, budget)
    upto = Window.partitionBy("query_id").orderBy(*key[1:]).rowsBetween(Window.unboundedPreceding, 0)
    own = items.where("text IS NOT NULL")
    rows = own.select(*key[:3], F.length("text").alias("n"), F.xxhash64("text").alias("hash"), T.est_tokens(F.col("text")).cast("long").alias("cost"))
    rows = rows.withColumn("used", F.sum("cost").over(upto)).withColumn("end", F.sum(F.col("n").cast("long") + 1).over(upto) - 1)
    past = F.col("used") > budget
    sums = rows.groupBy("query_id").agg(
        F.count("*").alias("items"),
        F.count_if(~past).alias("n_kept"),
        F.max("end").alias("length"),
        F.max("used").alias("tokens"),
        F.min(F.when(past, F.struct("end", *key[1:], (F.lit(budget) - F.col("used") + F.col("cost")).alias("left")))).alias("last"),
    )
    found = keep(sums, "sums")
    whole = found.where("last IS NULL").select("query_id", F.col("length").alias("cut"), "n_kept", F.lit(0).alias("n_dropped"), F.lit(0).alias("broken_rows"), F.col("tokens").alias("tokens_used"))
    asked = bounded(found.where("last IS NOT NULL").withColumnsRenamed({"query_id": "q"}), "cuts", MOST_CUTS)
    place = F.col("query_id").eqNullSafe(F.col("q")) & F.col("idx").eqNullSafe(F.col("last.idx")) & F.col("kind").eqNullSafe(F.col("last.kind"))
    near = items.select("query_id", "idx", "kind", "text").join(asked, place).where((F.length("text") == F.col("last.n")) & (F.xxhash64("text") == F.col("last.hash")))
    near = near.withColumn("inside", T.est_cut(F.col("text"), F.col("last.left").cast("int")))
    near = near.withColumn("broken_rows", F.when((F.col("inside") > 0) & (F.col("kind") == "row"), 1).otherwise(0))
    cut = near.select("query_id", (F.col("last.end") - F.col("last.n") + F.col("inside")).alias("cut"), "n_kept", (F.col("items") - F.col("n_kept") - F.col("broken_rows")).alias("n_dropped"), "broken_rows", F.lit(budget).alias("tokens_used"))
    out = whole.unionByName(cut.distinct())  # an item may be there twice
    return out.select("query_id", *[F.col(c).cast("int").alias(c) for c in out.columns[1:]])
