"""Scratch tables, text UDFs and null-safe joins that the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"

_own_folder: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where spark.checkpoint.dir is unset, a temporary one, if all runs on this machine, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="wayfind-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, whichever executor is lost.

    It is compressed and columnar, and joins on it get plain exchanges, which adaptive execution can split.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of texts, at most: each is held several times over in a worker and in the JVM.
BATCH_ROWS = 2000


def bound_batches() -> None:
    """Lower the session's rows a batch to BATCH_ROWS; a setting that is lower already stays."""
    name, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", SparkSession.getActiveSession()
    if spark and not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_udf(make: Callable[[], Callable[[list], object]], schema: str) -> Callable[[Column], Column]:
    """A column function over whole texts in Arrow batches.

    make() runs once a task and gives a function from a list of texts (or None) to a list, or to a dict of lists
    for a struct. Marked non-deterministic so that no optimiser rule evaluates it twice. Bounds the session's batches.
    """
    struct = schema.lstrip().startswith("struct")
    bound_batches()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make()
        for texts in batches:
            yield pd.Series(f(texts.tolist()))

    def run_struct(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = make()
        for texts in batches:
            yield pd.DataFrame(f(texts.tolist()))

    # The evaluation type is read from the hints, which must be real types, not strings.
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    run_struct.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run_struct if struct else run, schema).asNondeterministic()


def split_rows(docs: DataFrame, key: Column, keys: DataFrame, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose key may be among keys (one long column, key), and those whose key certainly is not.

    A bit filter of a fixed size is broadcast, 2^bits / 64 rows at most (4 MB for 24 bits), whatever the number of keys. So
    only rows that may be concerned need to be moved to be joined. docs is read once for each part.
    """
    place = (1 << bits) - 1
    at = lambda c: F.shiftright(c.bitwiseAND(place), 6).cast("int")
    bit = lambda c: c.bitwiseAND(63).cast("int")
    words = keys.groupBy(at(F.col("key")).alias("__filter_at")).agg(F.expr("bit_or(shiftleft(1L, CAST(key & 63 AS INT)))").alias("__filter_word"))
    marked = docs.withColumn("__filter_key", key).withColumn("__filter_at", at(F.col("__filter_key"))).join(F.broadcast(materialise(words, "row-filter")), "__filter_at", "left")
    may = F.coalesce(F.getbit(F.col("__filter_word"), bit(F.col("__filter_key"))), F.lit(0)) == 1
    return marked.where(may).select(*docs.columns), marked.where(~may).select(*docs.columns)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
