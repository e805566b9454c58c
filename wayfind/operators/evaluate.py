"""Evaluation: execution match, ranking metrics, intervals, routing and grounding rates."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.operators.graph import grams
from wayfind.operators.places import upper_median_by

NUMERIC = re.compile(r"-?\d+(\.\d+)?")


@dataclass(frozen=True)
class MatchOptions:
    ordered: bool = False
    columns_sensitive: bool = False
    tuple_sensitive: bool = False
    numeric_tolerance: float = 0.0
    true_tolerance: bool = False
    subset_columns: bool = False


def token(value: object, tolerance: float = 0.0) -> str:
    """One value in canonical form: null, a number (in buckets of the tolerance), or a text as it is."""
    if value is None:
        return "∅"
    text = "true" if value is True else "false" if value is False else str(value)
    if NUMERIC.fullmatch(text.strip()):
        n = float(text)
        if tolerance > 0:
            n = math.floor(n / tolerance + 0.5) * tolerance
        return f"n:{n + 0.0:.15g}"
    return f"s:{text}"


def _row(row: dict, o: MatchOptions) -> tuple[str, ...]:
    parts = [f"{k}={token(v, o.numeric_tolerance)}" if o.columns_sensitive else token(v, o.numeric_tolerance) for k, v in row.items()]
    return tuple(parts if o.tuple_sensitive else sorted(parts))


def _holds(got: dict, gold: dict, o: MatchOptions) -> bool:
    return not Counter(token(v, o.numeric_tolerance) for v in gold.values()) - Counter(token(v, o.numeric_tolerance) for v in got.values())


def _close(a: dict, b: dict, tolerance: float) -> bool:
    if len(a) != len(b):
        return False
    for x, y in zip(a.values(), b.values(), strict=True):
        tx, ty = token(x), token(y)
        if tx != ty and not (tx[:2] == ty[:2] == "n:" and abs(float(tx[2:]) - float(ty[2:])) <= tolerance):
            return False
    return True


def _all_paired(fits: list[list[int]]) -> bool:
    """Can each row have a partner of its own? fits: for each, those that it may have. Pairs are changed along a chain where
    that frees one, so the order of rows doesn't matter."""
    taken: dict[int, int] = {}
    for start in range(len(fits)):
        came: dict[int, int] = {}  # partner: the row that asked for it
        rows, free = [start], None
        while rows and free is None:
            row = rows.pop()
            for p in fits[row]:
                if p not in came:
                    came[p] = row
                    if p not in taken:
                        free = p
                        break
                    rows.append(taken[p])
        if free is None:
            return False
        while free is not None:
            row = came[free]
            before = next((p for p, r in taken.items() if r == row), None)
            taken[free] = row
            free = before
            if free is not None:
                del taken[free]
    return True


def results_match(got: list[dict], gold: list[dict], o: MatchOptions = MatchOptions()) -> bool:
    """Do two results agree: as multisets of rows, whatever the column names and order, unless the options say otherwise?

    true_tolerance compares columns in order and numbers within the tolerance, where the default puts numbers in buckets.
    subset_columns: rows may have columns beyond the gold ones.
    """
    if o.true_tolerance or o.subset_columns:
        if len(got) != len(gold):
            return False
        fits = (lambda p, g: _close(p, g, o.numeric_tolerance)) if o.true_tolerance else (lambda p, g: _holds(p, g, o))
        if o.ordered:
            return all(fits(p, g) for p, g in zip(got, gold, strict=True))
        return _all_paired([[i for i, p in enumerate(got) if fits(p, g)] for g in gold])
    a, b = [_row(r, o) for r in got], [_row(r, o) for r in gold]
    return a == b if o.ordered else Counter(a) == Counter(b)


def frames_match(a: DataFrame, b: DataFrame, distinct: bool = False, places: int = 6) -> bool:
    """Set or multiset equality of two DataFrames by column position, doubles rounded. Stays distributed."""

    def plain(df: DataFrame) -> DataFrame:
        return df.select(*[(F.round(F.col(f"`{c}`"), places) if t in ("double", "float") else F.col(f"`{c}`")).cast("string").alias(f"c{i}") for i, (c, t) in enumerate(df.dtypes)])

    if len(a.columns) != len(b.columns):
        return False
    a, b = plain(a), plain(b)
    one, two = (a.subtract(b), b.subtract(a)) if distinct else (a.exceptAll(b), b.exceptAll(a))
    return one.isEmpty() and two.isEmpty()


def first_gold(ranked: DataFrame, gold: DataFrame, id_col: str) -> DataFrame:
    """query_id, rank: the best place of a gold item, null if none was found. gold: query_id, id_col."""
    hit = ranked.join(gold, ["query_id", id_col]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return gold.select("query_id").distinct().join(hit, "query_id", "left")


def rank_metrics(first: DataFrame, cuts: Iterable[int] = (1, 3, 5)) -> DataFrame:
    """n, hit_at_k for each cut, mrr (0 where the gold is absent), all rounded to six places."""
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6)
    return first.agg(F.count("*").alias("n"), *[rate(F.col("rank") <= k).alias(f"hit_at_{k}") for k in cuts], F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high end of the Wilson interval, three places; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits / n
    middle = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    under = 1 + z * z / n
    return F.round(F.greatest(F.lit(0.0), (middle - half) / under), 3), F.round(F.least(F.lit(1.0), (middle + half) / under), 3)


def accuracy_by(rows: DataFrame, key: str, correct: str = "correct") -> DataFrame:
    return rows.groupBy(key).agg(F.sum(F.col(correct).cast("int")).cast("long").alias("n_correct"), F.count("*").alias("n"))


def confusion(rows: DataFrame, expected: str = "expected", got: str = "got") -> DataFrame:
    return rows.where(F.col(expected) != F.col(got)).groupBy(expected, got).agg(F.count("*").alias("n"))


def repeat_summary(runs: DataFrame) -> DataFrame:
    """runs: run, correct counts by run. Median (upper), least and largest; no row without runs."""
    per = runs.groupBy("run").agg(F.sum(F.col("correct").cast("int")).alias("c"))
    return upper_median_by(per, "c").select("median", "least", "most")


def stability(runs: DataFrame) -> DataFrame:
    """item, state: always_wrong, flaky or stable over the runs."""
    per = runs.groupBy("item").agg(F.count("*").alias("n"), F.sum((~F.col("correct")).cast("int")).alias("wrong"))
    return per.select("item", F.when(F.col("wrong") == F.col("n"), "always_wrong").when(F.col("wrong") > 0, "flaky").otherwise("stable").alias("state"))


def route_eval(routed: DataFrame, expected: DataFrame) -> DataFrame:
    """n, strict, coverage, fan_out, true_miss. expected: query_id, expected (a lane)."""
    tool = F.create_map(*[F.lit(x) for kv in {"structured": "sql.query", "semantic": "vector.search", "graph": "graph.expand"}.items() for x in kv])
    rows = routed.join(expected, "query_id").withColumn("strict", F.col("route") == F.col("expected"))
    reached = F.col("strict") | ((F.col("expected") == "hybrid") & F.array_contains("tools", "sql.query") & F.array_contains("tools", "vector.search")) | F.coalesce(F.array_contains("tools", F.try_element_at(tool, F.col("expected"))), F.lit(False))
    rows = rows.withColumn("reached", reached)
    rate = lambda c: F.round(F.avg(c.cast("int")), 3)
    return rows.agg(F.count("*").alias("n"), rate(F.col("strict")).alias("strict"), rate(F.col("reached")).alias("coverage"), F.sum((F.col("reached") & ~F.col("strict")).cast("int")).cast("long").alias("fan_out"), F.sum((~F.col("reached")).cast("int")).cast("long").alias("true_miss"))


def name_recall(rows: DataFrame) -> DataFrame:
    """rows: query_id, gold (array of names), text. query_id, recall: the share of names in the text, null without gold."""
    hit = F.size(F.filter("gold", lambda g: F.contains(F.col("text"), g)))
    return rows.select("query_id", F.round(hit / F.nullif(F.size("gold"), F.lit(0)), 6).alias("recall"))


def triage(rows: DataFrame, budget: float, most_slow: float = 0.05) -> DataFrame:
    """rows: item, seconds, killed, failed. item, state: slow (killed near the budget), broken or fine; raises if too many are slow."""
    out = rows.withColumn("state", F.when(F.col("killed") & (F.col("seconds") >= 0.9 * budget), "slow").when(F.col("failed") | F.col("killed"), "broken").otherwise("fine"))
    share = out.agg(F.avg((F.col("state") == "slow").cast("int"))).first()[0] or 0
    if share > most_slow:
        raise RuntimeError(f"{share:.0%} of the gold statements ran out of time")
    return out.select("item", "state")


#: How an answer says that nothing was found.
NOT_FOUND = "알 수 없|찾지 못|없습니다|정보가 없|not found|cannot be determined|does not hold"


def answer_checks(answers: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, evidence, grounded, abstained for each answer.

    answers, one row a query_id: query_id, context, answer, gold (array of texts that the context should hold), absent (is there nothing to
    find?). names: name, what an answer may mention. evidence: the share of gold in the context, null without gold.
    grounded: does the context hold every name that the answer mentions, null without any? abstained: for absent ones, does
    the answer say so? Else null.
    """
    rows = answers.withColumn("gold", F.array_distinct(F.coalesce("gold", F.array().cast("array<string>"))))
    hit = F.size(F.filter("gold", lambda g: F.contains(F.col("context"), g)))
    # Names and answers meet on the first three characters of the name, so no answer is tried with every name.
    known = names.where(F.col("name").isNotNull()).select("name").distinct().withColumn("head", F.substring("name", 1, 3))
    runs = rows.select("query_id", F.explode(F.concat(*[grams(F.col("answer"), n) for n in range(4)])).alias("head"))
    said = runs.join(known, "head").select("query_id", "name").join(rows.select("query_id", "answer", "context"), "query_id").where(F.contains("answer", F.col("name")))
    grounded = said.groupBy("query_id").agg(F.min(F.contains("context", F.col("name"))).alias("grounded"))
    return rows.join(grounded, "query_id", "left").select(
        "query_id",
        F.round(hit / F.nullif(F.size("gold"), F.lit(0)), 6).alias("evidence"),
        "grounded",
        F.when(F.col("absent"), F.col("answer").rlike(NOT_FOUND)).alias("abstained"),
    )


def answer_rates(checks: DataFrame) -> DataFrame:
    """evidence_ok of evidence_scored (all gold in the context), grounded_ok of grounded_scored, abstained of absent."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("long")
    return checks.agg(
        n(F.col("evidence") == 1).alias("evidence_ok"), F.count("evidence").alias("evidence_scored"), n(F.col("grounded")).alias("grounded_ok"), F.count("grounded").alias("grounded_scored"),
        n(F.col("abstained")).alias("abstained"), F.count("abstained").alias("absent"),
    )


def fault_rates(scenarios: dict[str, Callable[[], tuple[bool, bool]]]) -> dict:
    """Rates over scenarios in which something is broken on purpose. Each gives (is there still a result?, is the fault told?);
    one that raises has crashed, which is told but no result. passed: none crashes, 80 % give a result, all faults are told."""
    seen = {}
    for name, run in scenarios.items():
        try:
            partial, visible = run()
            seen[name] = (False, bool(partial), bool(visible))
        except Exception:
            seen[name] = (True, False, True)
    n = max(1, len(seen))
    rates = {k: sum(f(x) for x in seen.values()) / n for k, f in {"no_crash": lambda x: not x[0], "partial": lambda x: x[1], "visible": lambda x: x[2]}.items()}
    return rates | {"passed": rates["no_crash"] == 1 and rates["partial"] >= 0.8 and rates["visible"] == 1, "scenarios": seen}
