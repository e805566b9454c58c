"""Execution match on DataFrames gives what the plain form gives, and the plain form does not depend on the order of rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from wayfind.operators.evaluate import MatchOptions, results_match
from wayfind.operators.execution_match import frames_results_match

GOLD = [(1, "a", 2.0), (1, "a", 2.0), (2, None, -0.0), (3, " 4 ", 1.25), (4, "true", None)]
COPIES = {
    "same": GOLD,
    "turned": [(c, a, b) for a, b, c in GOLD],
    "shuffled": GOLD[::-1],
    "short": GOLD[1:],
    "repeated": GOLD + GOLD[:1],
    "other": GOLD[:-1] + [(4, "True", None)],
    "moved": [(a, b, None if c is None else c + 0.01) for a, b, c in GOLD],
}


@pytest.mark.parametrize("options", [{}, {"tuple_sensitive": True}, {"numeric_tolerance": 0.5}, {"subset_columns": True}])
def test_as_the_plain_form(spark, options):
    frame = lambda rows: spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], "x string, y string, z string")
    plain = lambda rows: [dict(zip("xyz", (None if v is None else str(v) for v in r), strict=True)) for r in rows]
    for name, rows in COPIES.items():
        want = results_match(plain(rows), plain(GOLD), MatchOptions(**options))
        assert frames_results_match(frame(rows), frame(GOLD), MatchOptions(**options)) is want, name


def test_types_names_orders_and_wider_rows(spark):
    a = spark.createDataFrame([(1, 2.0), (3, 4.0)], "k long, v double")
    b = a.select(F.col("v").cast("decimal(10,2)").alias("w"), F.col("k").cast("string").alias("k"))
    assert frames_results_match(b, a) and not frames_results_match(b, a, MatchOptions(columns_sensitive=True))
    down = [F.desc("k")]
    assert frames_results_match(a, a, MatchOptions(ordered=True), [F.col("k")], [F.col("k")]) and not frames_results_match(a, a, MatchOptions(ordered=True), [F.col("k")], down)
    wide = a.select(F.lit("more").alias("m"), F.col("v").alias("k"), F.col("k").alias("v2"), F.col("v").alias("again"))
    assert frames_results_match(wide, a, MatchOptions(subset_columns=True)) and not frames_results_match(wide, a)
    assert not frames_results_match(wide.withColumn("v2", F.lit(1)), a, MatchOptions(subset_columns=True))
    assert frames_results_match(a.limit(0), a.limit(0)) and not frames_results_match(a.limit(0), a)
    with pytest.raises(ValueError):
        frames_results_match(a, a, MatchOptions(true_tolerance=True))


def test_pairs_do_not_depend_on_the_order_of_rows():
    """The first gold row fits both; only one choice leaves a partner for the second."""
    got, gold = [{"a": 1, "b": 2}, {"a": 1, "b": 3}, {"a": 3, "b": 4}], [{"x": 1}, {"x": 2}, {"x": 3}]
    for p, g in itertools.product(itertools.permutations(got), itertools.permutations(gold)):
        assert results_match(list(p), list(g), MatchOptions(subset_columns=True))
    assert not results_match(got, [{"x": 2}, {"x": 2}, {"x": 3}], MatchOptions(subset_columns=True))
    close = MatchOptions(true_tolerance=True, numeric_tolerance=1.0)
    assert results_match([{"a": 1.0}, {"a": 0.0}], [{"a": 0.5}, {"a": 2.0}], close) and results_match([{"a": 0.0}, {"a": 1.0}], [{"a": 0.5}, {"a": 2.0}], close)
