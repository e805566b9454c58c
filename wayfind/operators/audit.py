"""Audit records: what was decided and used, with fingerprints of the rule part and of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the JSON of the columns."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def audit_records(runs: DataFrame) -> DataFrame:
    """One record a question.

    runs: query_id, query, route, tools, sql, sql_ok, errors (array), fused (array of struct<key, score, sources, text>, in
    order), kept, dropped (arrays), tokens_used, budget. Verdicts are there only for what took place; ten fused items at
    most, scores to six places, previews of 120 characters. rule_fingerprint covers what rules alone decide.
    """
    fusion = F.transform(F.slice("fused", 1, 10), lambda f: F.struct(f["key"].alias("key"), F.round(f["score"], 6).alias("score"), f["sources"].alias("sources"), F.substring(f["text"], 1, 120).alias("preview")))
    verdicts = F.array_compact(
        F.array(
            F.concat(F.lit("route:"), F.col("route")),
            F.when(F.col("sql").isNotNull(), F.when(F.col("sql_ok"), "sql:read_only_ok").otherwise("sql:refused_or_failed")),
            F.when(F.size("errors") > 0, F.concat(F.lit("lanes_failed:"), F.array_join("errors", ";"))),
            F.when(F.size("fused") > 0, "fusion:rrf"),
            F.when(F.size("kept") + F.size("dropped") > 0, "curation:rows_whole"),
        )
    )
    out = runs.withColumn("fusion", fusion).withColumn("verdicts", verdicts)
    return out.select(
        "query_id", "query", "route", "tools", "verdicts", "fusion", F.size("kept").alias("n_kept"), F.size("dropped").alias("n_dropped"), "tokens_used", "budget", "errors",
        fingerprint(F.col("query"), F.col("route"), F.col("tools")).alias("rule_fingerprint"),
        fingerprint(F.col("query"), F.col("route"), F.col("tools"), F.col("fusion"), F.col("kept")).alias("pipeline_fingerprint"),
    )


def redact(records: DataFrame) -> DataFrame:
    """Previews replaced by their length and the head of their SHA-256, for publication."""
    hidden = lambda f: F.concat(F.lit("[withheld: "), F.length(f["preview"]).cast("string"), F.lit(" characters, sha256:"), F.substring(F.sha2(f["preview"], 256), 1, 12), F.lit("]"))
    return records.withColumn("fusion", F.transform("fusion", lambda f: F.struct(f["key"].alias("key"), f["score"].alias("score"), f["sources"].alias("sources"), hidden(f).alias("preview"))))
