"""Places in a total order and exact selection, without one task that holds all rows.

Rows are dealt by ranges of the order and sorted within them; a row's place is its place in its part plus the sizes of
the parts before it, of which there are as many numbers as parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.sources.sinks import keep


def places(df: DataFrame, order: list[Column], keys: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """df with a column of places from 1 (long), in each group of keys or over all rows.

    A group of any size is spread over as many parts as it needs. Rows that tie in the whole order get places of their own,
    in no stated order: end the order with an id. Empty tables give none. Null keys are a group of their own.
    """
    spark = df.sparkSession
    by = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    # Numbers are given as the sorted parts are written, so that they are the same whenever they are read.
    sorted_rows = keep(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "places")
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in sorted_rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a part
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before))
        before += n
    starts = spark.createDataFrame(rows, "__part long, __before long")
    placed = sorted_rows.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + within + 1)
    placed = placed.drop("__at", "__part", "__before")
    if not keys:
        return placed
    group = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    first = placed.groupBy(*group).agg(F.min(name).alias("__first"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return placed.join(first, same).withColumn(name, F.col(name) - F.col("__first") + 1).select(*df.columns, name)


def upper_median_by(rows: DataFrame, value: str, keys: tuple[str, ...] = (), cuts: int = 32, most: int = 4096) -> DataFrame:
    """keys, n, median, least, most: the middle of each group's values, the upper of two, and the ends. Nulls don't count; a group
    of nulls alone, like an empty table, gives no row.

    Values are counted first, one row a distinct value. Where a group has more than `most` of them, they are counted between
    cut points, and only the interval that holds the middle is looked at again, until few enough are left to be sorted. So no
    task holds a whole group, whatever its size, and the result is exact.
    """
    group = F.struct(*[F.col(k).alias(k) for k in keys]) if keys else F.struct(F.lit(0).alias("__all"))
    counted = keep(rows.where(F.col(value).isNotNull()).groupBy(group.alias("__g"), F.col(value).alias("__v")).agg(F.count("*").alias("__n")), "counted")
    sizes = keep(counted.groupBy("__g").agg(F.sum("__n").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most")), "sizes")
    left = counted.join(sizes.select("__g", F.expr("n div 2").alias("__want")), "__g")
    found = None
    while True:
        left = keep(left, "selection")
        widths = left.groupBy("__g").agg(F.count("*").alias("__d"), F.percentile_approx("__v", [i / cuts for i in range(1, cuts)], 10_000).alias("__cuts"))
        widths = keep(widths, "cuts")
        few = left.join(widths.where(F.col("__d") <= most).select("__g"), "__g", "left_semi")
        upto = few.withColumn("__upto", F.sum("__n").over(Window.partitionBy("__g").orderBy("__v")))
        done = upto.where(F.col("__upto") > F.col("__want")).groupBy("__g").agg(F.min("__v").alias("median"))
        found = done if found is None else found.unionByName(done)
        wide = widths.where(F.col("__d") > most)
        if wide.isEmpty():
            break
        cut = left.join(wide.select("__g", "__cuts"), "__g").withColumn("__i", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
        between = cut.groupBy("__g", "__i").agg(F.sum("__n").alias("__m"), F.first("__want").alias("__want"))  # at most `cuts` rows a group
        between = between.withColumn("__upto", F.sum("__m").over(Window.partitionBy("__g").orderBy("__i")))
        holds = between.where((F.col("__upto") > F.col("__want")) & (F.col("__upto") - F.col("__m") <= F.col("__want")))
        left = cut.drop("__want").join(holds.select("__g", "__i", (F.col("__want") - F.col("__upto") + F.col("__m")).alias("__want")), ["__g", "__i"]).drop("__i")
    out = sizes.join(found, "__g")
    return out.select(*[F.col("__g")[k].alias(k) for k in keys], "n", "median", "least", "most")
