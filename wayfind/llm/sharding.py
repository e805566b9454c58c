"""Shards along a Hilbert curve over metadata, so that a shard (and a file) spans a small box in every dimension.

Language, source and size are quantised to 5 bits each. Names get their place among the distinct names in order, weighted
by rows, so neighbouring names share cells; sizes get their power of two. Rows are range-partitioned by curve index
and, within a cell, by checksum, size and id, which splits a cell that holds a third of all rows; global ranks come from
one count a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm._common import materialise, same

CELL_BITS = 5
LOCAL = 33  # monotonically_increasing_id() keeps the partition above this many bits


def hilbert_index(axes: list[np.ndarray], bits: int = CELL_BITS) -> np.ndarray:
    """Position of integer points on the Hilbert curve (Skilling's transform: undo the rotations, then read Gray code)."""
    x = [a.astype(np.int64).copy() for a in axes]
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for k in range(len(x)):
            inverted = x[k] & q > 0
            swap = np.where(inverted, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            x[k] ^= np.where(k == 0, 0, swap)
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] >> level & 1 == 1, turn ^ ((1 << level) - 1), turn)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for a in x:
            out = out << 1 | (a ^ turn) >> level & 1
    return out


def hilbert(*axes: Column) -> Column:
    def f(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(hilbert_index([c.to_numpy() for c in columns]))

    f.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(f, "long").asNondeterministic()(*axes)


def running(df: DataFrame, order: list[Column], weight: str, name: str) -> tuple[DataFrame, int]:
    """df with `name`: the sum of `weight` over the rows before, in the given order; and the whole sum.

    One sort by range; the driver sees one number a partition.
    """
    ordered = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name)
    pid = F.shiftright("__at", LOCAL)
    sums = dict(ordered.groupBy(pid.alias("p")).agg(F.sum(weight)).collect())
    before, total = {}, 0
    for p in sorted(sums):
        before[p] = total
        total += sums[p]
    if not before:
        return ordered.withColumn(name, F.lit(0).cast("long")).drop("__at"), 0
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), pid)
    if weight == "one":
        return ordered.withColumn(name, start + F.col("__at").bitwiseAND(F.lit((1 << LOCAL) - 1))).drop("__at"), total
    # Files of one partition are read in pieces, so the sum inside a partition is taken over its rows by place.
    from pyspark.sql import Window

    inside = Window.partitionBy(pid).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return ordered.withColumn(name, start + F.coalesce(F.sum(weight).over(inside), F.lit(0))).drop("__at"), total


def name_cells(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value of a text column and its cell: its place in order, by rows before it."""
    kinds = df.groupBy(F.col(column).alias(f"v_{column}")).agg(F.count("*").alias("n"))
    placed, total = running(kinds, [F.col(f"v_{column}").asc_nulls_first()], "n", f"names_{column}")
    cell = F.least(F.lit((1 << CELL_BITS) - 1), F.floor(F.col(f"names_{column}") * (1 << CELL_BITS) / max(total, 1)))
    return materialise(placed.select(f"v_{column}", cell.cast("int").alias(f"c_{column}")), f"cells_{column}")


def hilbert_shards(docs: DataFrame, shards: int = 16, law: str = "rows") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and curve_index, the place on the curve.

    law "rows": shard sizes differ by one row at most. law "bytes": a row goes to the shard where its first byte lies, so
    shards differ by less than the largest row. size is the UTF-8 length plus 1 (null: 1), text_crc32 that of a null
    text 0. slot counts from 0 in each shard along the curve; grown_shard is null under both laws. Null names come first
    in their dimension. Equal texts of one language and source lie in one cell and take neighbouring slots there, by
    checksum, then size, then id (null first); a law comes before a group, so a group may go on in the next shard. Empty
    tables give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    narrow = materialise(narrow.withColumn("one", F.lit(1).cast("long")), "metadata")
    cells = narrow
    for column in ("lang", "source"):
        names = name_cells(narrow, column)
        cells = cells.join(names, same(cells[column], names[f"v_{column}"])).drop(f"v_{column}")
    power = F.least(F.lit((1 << CELL_BITS) - 1), F.length(F.bin("size")) - 1)
    cells = cells.select("doc_id", "size", "text_crc32", "one", hilbert(F.col("c_lang"), F.col("c_source"), power).alias("curve_index"))
    order = [F.col("curve_index"), F.col("text_crc32"), F.col("size"), F.col("doc_id").asc_nulls_first()]
    if law == "rows":
        ranked, total = running(cells, order, "one", "rank")
        shard = F.expr(f"rank * {shards} div {max(total, 1)}")
        first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
        out = ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - first)
    elif law == "bytes":
        summed, total = running(cells, order, "size", "before")
        summed = summed.withColumn("shard", F.expr(f"before * {shards} div {max(total, 1)}").cast("int"))
        ranked, _ = running(summed, [F.col("shard"), F.col("before")], "one", "rank")
        firsts = materialise(ranked.groupBy(F.col("shard").alias("s")).agg(F.min("rank").alias("first")), "firsts")
        out = ranked.join(F.broadcast(firsts), F.col("shard") == F.col("s")).withColumn("slot", F.col("rank") - F.col("first"))  # a row a shard
    else:
        raise ValueError(f"no such law: {law}")
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")
