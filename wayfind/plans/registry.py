"""The registry of queries: each is a function of (spark, sf_dir), most with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfind.operators.sql_lane import guard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(sql: str | None = None) -> Callable:
    """Register a function under its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_query(name: str, statement: str, oracle: str | None = None) -> None:
    """Register a statement that goes through the guard; the oracle is the same text unless the dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = [t for t in TABLES if t in statement]
        for t in used:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(guard(spark, statement, used))

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or statement
