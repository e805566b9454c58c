"""Do two results of any size agree? The rules of evaluate.results_match on DataFrames, compared where they are.

Each row becomes its canonical values; rows are counted with a sign, equal ones together, and the results agree if no
count is left. Only a truth value reaches the driver.
"""

from __future__ import annotations

from itertools import islice, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.operators.evaluate import NUMERIC, MatchOptions
from wayfind.operators.places import places
from wayfind.sources.sinks import keep

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def canonical(value: Column, kind: str, tolerance: float = 0.0) -> Column:
    """One value as text: null, a number whatever its type (in buckets of the tolerance), or a text as it is."""
    text = value.cast("string")
    number = value.cast("double") if kind.startswith(NUMBERS) else F.when(F.trim(text).rlike(f"^{NUMERIC.pattern}$"), F.trim(text).cast("double"))
    number = F.when(F.isnan(number) | number.isin(float("inf"), float("-inf")), None).otherwise(number)
    if tolerance > 0:
        number = F.floor(number / tolerance + 0.5).cast("double") * tolerance
    return F.when(value.isNull(), "∅").when(number.isNotNull(), F.concat(F.lit("n:"), (number + 0.0).cast("string"))).otherwise(F.concat(F.lit("s:"), text))


def _values(df: DataFrame, o: MatchOptions, columns: list[str] | None = None) -> list[Column]:
    kinds = dict(df.dtypes)
    return [canonical(F.col(f"`{c}`"), kinds[c], o.numeric_tolerance) for c in columns or df.columns]


def _row(df: DataFrame, o: MatchOptions, columns: list[str] | None = None) -> Column:
    values = _values(df, o, columns)
    if o.columns_sensitive:
        values = [F.concat(F.lit(f"{c}="), v) for c, v in zip(columns or df.columns, values, strict=True)]
    row = F.array(*values)
    return row if o.tuple_sensitive else F.sort_array(row)


def _same_bag(a: DataFrame, b: DataFrame) -> bool:
    """a, b: one column, row. Equal as multisets?"""
    signed = a.select("row", F.lit(1).alias("sign")).unionByName(b.select("row", F.lit(-1).alias("sign")))
    return signed.groupBy("row").agg(F.sum("sign").alias("left")).where(F.col("left") != 0).isEmpty()


def _same_sequence(a: DataFrame, b: DataFrame) -> bool:
    """a, b: row, place."""
    return a.join(b.withColumnRenamed("row", "other"), "place", "full").where(~F.col("row").eqNullSafe(F.col("other"))).isEmpty()


def frames_results_match(got: DataFrame, gold: DataFrame, o: MatchOptions = MatchOptions(), got_order: list[Column] | None = None, gold_order: list[Column] | None = None, most_maps: int = 24) -> bool:
    """As results_match: equal as multisets of rows, or as sequences in the given orders (ordered).

    subset_columns: got may have further columns. One choice of its columns must give all gold rows, which is stricter than
    a choice of its own for each row; columns that hold the same values as a gold column come into question, and if more than
    most_maps choices would have to be tried, that is an error, not a no. true_tolerance is not there: its matches depend
    on pairs, not on rows; use results_match on small results.
    """
    if o.true_tolerance:
        raise ValueError("true_tolerance compares pairs of rows: use results_match")
    if o.ordered and (got_order is None or gold_order is None):
        raise ValueError("ordered results need their orders")
    if len(got.columns) < len(gold.columns) or (len(got.columns) > len(gold.columns) and not o.subset_columns):
        return False
    if o.ordered:
        got, gold = places(got, got_order, name="__place"), places(gold, gold_order, name="__place")

    def compare(columns: list[str] | None, options: MatchOptions) -> bool:
        names = [c for c in gold.columns if c != "__place"]
        mine = columns or [c for c in got.columns if c != "__place"]
        rows = lambda df, cs: df.select(_row(df, options, cs).alias("row"), *([F.col("__place").alias("place")] if o.ordered else []))
        return (_same_sequence if o.ordered else _same_bag)(rows(got, mine), rows(gold, names))

    if not o.subset_columns:
        return compare(None, o)
    # Columns of equal bags of values have equal sums of hashes; the comparison of rows decides.
    prints = lambda df: df.agg(*[F.struct(F.count(F.lit(1)), F.sum(F.xxhash64(v).cast("decimal(38,0)"))).alias(f"c{i}") for i, v in enumerate(_values(df, o, [c for c in df.columns if c != "__place"]))]).first()
    got, gold = (keep(got, "got"), keep(gold, "gold")) if not o.ordered else (got, gold)
    own, want = prints(got), prints(gold)
    names = [c for c in got.columns if c != "__place"]
    fits = [[names[j] for j in range(len(own)) if own[j] == w] for w in want]
    maps = list(islice((m for m in product(*fits) if len(set(m)) == len(m)), most_maps + 1))
    plain = MatchOptions(tuple_sensitive=True, numeric_tolerance=o.numeric_tolerance)
    if any(compare(list(m), plain) for m in maps[:most_maps]):
        return True
    if len(maps) > most_maps:
        raise ValueError(f"more than {most_maps} choices of columns are possible")
    return False
