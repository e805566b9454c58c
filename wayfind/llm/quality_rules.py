"""Quality rules whose thresholds come from the data: mergeable quantile sketches per language and source.

A sketch counts the values of a ratio in buckets of a fixed relative width, so sketches merge by adding counts: every task
adds up its own rows first, a source that holds a third of all rows costs one row a bucket and task, and the result does not
depend on the order of merging. Languages are merged from their sources and the table from its languages. From each sketch
come an outer quantile and the median, and from these a fence; a group's fence is drawn towards its language's, and that
towards the table's, the more the fewer rows stand behind it. No threshold is fixed beforehand.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm._common import SPACES, materialise, same, text_udf

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Signal: its expression, the percentile that a fence starts from, and whether there is a lower fence as well.
SIGNALS = {
    "symbols": ("n_symbols / n_words", 90, False),
    "repeats": ("n_repeat_words / n_words", 99, False),
    "dup_lines": ("n_dup_lines / n_lines", 99, False),
    "word_length": ("word_chars / n_words", 90, True),
}
EMPTY = -(1 << 30)  # the bucket of zero


def repeated_words(ids: np.ndarray, width: int = 8) -> int:
    """Words inside windows of `width` words that occur at least twice. Windows are compared exactly, by doubling."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    rank, have = ids.astype(np.int64), 1
    while have < width:
        step = min(have, width - have)
        rank = np.unique(rank[:-step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1].astype(np.int64)
        have += step
    twice = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + width, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def text_counts(text: str | None, width: int = 8) -> tuple[int, ...]:
    """COUNTS of one text; null and empty texts have none."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode().split()
    lines = text.split("\n")
    seen, dup_lines = set(), 0
    for line in lines:
        if line in seen:
            dup_lines += 1
        elif line.strip(SPACES):
            seen.add(line)
    repeats = 0
    if len(words) > width and len(known := dict.fromkeys(words)) < len(words):
        for k, w in enumerate(known):
            known[w] = k
        repeats = repeated_words(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), width)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup_lines, repeats, len(lines)


def quality_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column __counts."""

    def make():
        def f(texts: list) -> dict:
            rows = [text_counts(t) for t in texts]
            return {c: [r[k] for r in rows] for k, c in enumerate(COUNTS)}

        return f

    return docs.withColumn("__counts", text_udf(make, f"struct<{', '.join(f'{c}: long' for c in COUNTS)}>")(F.col(text_col)))


def sketches(rows: DataFrame, accuracy: float) -> DataFrame:
    """rows: lang, source, s_<signal>. lang, source, signal, bucket, n: one sketch a language, source and signal."""
    width = math.log((1 + accuracy) / (1 - accuracy))
    values = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.col(f"s_{k}").alias("v")) for k in SIGNALS])).alias("x"))
    bucket = F.when(F.col("x.v") > 0, F.ceil(F.log("x.v") / width).cast("int")).otherwise(EMPTY)
    return values.groupBy("lang", "source", F.col("x.signal").alias("signal"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fences(merged: DataFrame, keys: list[str], spread: float, accuracy: float) -> DataFrame:
    """merged: keys, signal, bucket, n. keys, signal, n, hi, lo: the fences that each sketch gives."""
    gamma = (1 + accuracy) / (1 - accuracy)
    of = Window.partitionBy(*keys, "signal")
    upto = merged.withColumns({"upto": F.sum("n").over(of.orderBy("bucket")), "whole": F.sum("n").over(of)})
    percent = F.element_at(F.create_map(*[F.lit(x) for k, (_, p, _) in SIGNALS.items() for x in (k, p)]), F.col("signal"))
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= p * F.col("whole"), F.col("bucket")))
    quantiles = upto.groupBy(*keys, "signal").agg(F.max("whole").alias("n"), at(percent).alias("high"), at(F.lit(50)).alias("middle"), at(100 - percent).alias("low"))
    end = lambda b, below=0: F.when(F.col(b) == EMPTY, 0.0).otherwise(F.pow(F.lit(gamma), (F.col(b) - below).cast("double")))
    hi = end("high") + spread * (end("high") - end("middle"))  # upper ends of buckets, so that the quantile itself passes; below, lower ends
    lo = end("low", 1) - spread * (end("middle", 1) - end("low", 1))
    return quantiles.select(*keys, "signal", "n", hi.alias("hi"), lo.alias("lo"))


def _towards(n: Column, own: Column, wider: Column, weight: int) -> Column:
    return (n * own + weight * wider) / (n + weight)


def thresholds(rows: DataFrame, spread: float, weight: int, accuracy: float) -> DataFrame:
    """lang, source, hi_<signal>, lo_<signal> of each language and source of rows."""
    groups = materialise(sketches(rows, accuracy), "quality-sketches")
    langs = groups.groupBy("lang", "signal", "bucket").agg(F.sum("n").alias("n"))
    table = langs.groupBy("signal", "bucket").agg(F.sum("n").alias("n"))
    whole = materialise(fences(table, [], spread, accuracy), "quality-table").select("signal", F.col("hi").alias("t_hi"), F.col("lo").alias("t_lo"))  # a row a signal
    by_lang = fences(langs, ["lang"], spread, accuracy).join(F.broadcast(whole), "signal")
    by_lang = by_lang.select(F.col("lang").alias("l_lang"), F.col("signal").alias("l_signal"), *[_towards(F.col("n"), F.col(x), F.col(f"t_{x}"), weight).alias(f"l_{x}") for x in ("hi", "lo")])
    by_lang = materialise(by_lang, "quality-languages")
    own = fences(groups, ["lang", "source"], spread, accuracy).join(by_lang, same(F.col("lang"), F.col("l_lang")) & (F.col("signal") == F.col("l_signal")))
    own = own.select("lang", "source", "signal", *[_towards(F.col("n"), F.col(x), F.col(f"l_{x}"), weight).alias(x) for x in ("hi", "lo")])
    of = lambda k, x: F.max(F.when(F.col("signal") == k, F.col(x))).alias(f"{x}_{k}")
    return materialise(own.groupBy("lang", "source").agg(*[of(k, x) for k in SIGNALS for x in ("hi", "lo")]), "quality-thresholds")


def quality_rules(docs: DataFrame, min_words: int = 20, repeat_percent: int = 30, spread: float = 3.0, weight: int = 20, accuracy: float = 0.002) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept for each row of docs.

    base_failed: fewer than min_words words, or more than repeat_percent of them in repeated windows. Others are kept while
    each signal is at most q + spread * (q - median) of its language and source, q being the signal's percentile (and
    word_length at least the mirror image below). Quantiles are over documents that did not fail, within `accuracy` of the
    value; a fence counts with the number of its rows against `weight` rows of the wider group. Where nearly all
    documents of a group have none of something, the fence is none. Null lang and null source are groups like any other;
    null and empty texts have no lines. Repeated rows come back each. Empty tables give no rows.
    """
    narrow = quality_counts(docs.select("doc_id", "lang", "source", "text")).select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "__counts.*")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    rows = narrow.withColumns({"base_failed": base} | {f"s_{k}": F.expr(f"CASE WHEN n_words > 0 THEN {e} END") for k, (e, _, _) in SIGNALS.items()})
    rows = materialise(rows, "quality-counts")
    limits = thresholds(rows.where(~F.col("base_failed")), spread, weight, accuracy).withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    out = rows.join(limits, same(F.col("lang"), F.col("g_lang")) & same(F.col("source"), F.col("g_source")), "left")
    fits = F.lit(True)
    for k, (_, _, both) in SIGNALS.items():
        fits &= F.col(f"s_{k}") <= F.col(f"hi_{k}")
        if both:
            fits &= F.col(f"s_{k}") >= F.col(f"lo_{k}")
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(fits, F.lit(False))).alias("kept"))


def _oracle_sql(spread: float = 3.0, weight: int = 20, accuracy: float = 0.002) -> str:
    """The same rules in SQL, with the same sketches."""
    gamma = (1 + accuracy) / (1 - accuracy)
    ratio = {k: e.replace("n_words", "CAST(n_words AS DOUBLE)").replace("n_lines", "CAST(n_lines AS DOUBLE)") for k, (e, _, _) in SIGNALS.items()}
    percent = "CASE signal " + " ".join(f"WHEN '{k}' THEN {p}" for k, (_, p, _) in SIGNALS.items()) + " END"
    at = lambda p: f"min(CASE WHEN upto * 100 >= ({p}) * whole THEN bucket END)"
    end = lambda b, below=0: f"(CASE WHEN {b} = {EMPTY} THEN 0.0 ELSE pow({gamma!r}::DOUBLE, ({b} - {below})::DOUBLE) END)"

    def level(name: str, source: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""{name}_u AS (SELECT *, sum(n) OVER (PARTITION BY {by}signal ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}signal) AS whole FROM {source}),
{name}_q AS (SELECT {by}signal, max(whole) AS n, {at(percent)} AS h, {at('50')} AS m, {at(f'100 - ({percent})')} AS l FROM {name}_u GROUP BY {by}signal),
{name}_f AS (SELECT {by}signal, CAST(n AS DOUBLE) AS n, {end('h')} + {spread} * ({end('h')} - {end('m')}) AS hi, {end('l', 1)} - {spread} * ({end('m', 1)} - {end('l', 1)}) AS lo FROM {name}_q)"""

    shrunk = lambda a, b, x: f"({a}.n * {a}.{x} + {weight} * {b}.{x}) / ({a}.n + {weight})"
    fits = []
    for k, (_, _, both) in SIGNALS.items():
        fits.append(f"s_{k} <= hi_{k}")
        if both:
            fits.append(f"s_{k} >= lo_{k}")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
win AS (SELECT r, pos, string_agg(word, ' ') OVER k AS win, count(*) OVER k AS n FROM w WINDOW k AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT r, pos, n = 8 AND count(*) OVER (PARTITION BY r, win, n) > 1 AS twice FROM win),
cover AS (SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM twice),
rep AS (SELECT r, count(*) FILTER (inside) AS n FROM cover GROUP BY 1),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, sum(c - 1) AS n FROM (SELECT r, line, count(*) AS c FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY 1),
f AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {', '.join(f'CASE WHEN n_words > 0 THEN {e} END AS s_{k}' for k, e in ratio.items())} FROM f),
v AS ({' UNION ALL '.join(f"SELECT lang, source, '{k}' AS signal, s_{k} AS v FROM s WHERE NOT base_failed" for k in SIGNALS)}),
gs AS (SELECT lang, source, signal, CASE WHEN v > 0 THEN CAST(ceil(ln(CASE WHEN v > 0 THEN v ELSE 1 END) / {math.log(gamma)!r}::DOUBLE) AS INTEGER) ELSE {EMPTY} END AS bucket, count(*) AS n FROM v GROUP BY ALL),
ls AS (SELECT lang, signal, bucket, sum(n) AS n FROM gs GROUP BY ALL),
ts AS (SELECT signal, bucket, sum(n) AS n FROM ls GROUP BY ALL),
{level('t', 'ts', '')},
{level('l', 'ls', 'lang')},
{level('g', 'gs', 'lang, source')},
lf AS (SELECT l_f.lang, l_f.signal, {shrunk('l_f', 't_f', 'hi')} AS hi, {shrunk('l_f', 't_f', 'lo')} AS lo FROM l_f JOIN t_f USING (signal)),
gf AS (SELECT g_f.lang, g_f.source, g_f.signal, {shrunk('g_f', 'lf', 'hi')} AS hi, {shrunk('g_f', 'lf', 'lo')} AS lo FROM g_f JOIN lf ON g_f.signal = lf.signal AND g_f.lang IS NOT DISTINCT FROM lf.lang),
lim AS (SELECT lang, source, {', '.join(f"max({x}) FILTER (signal = '{k}') AS {x}_{k}" for k in SIGNALS for x in ('hi', 'lo'))} FROM gf GROUP BY ALL)
SELECT s.doc_id AS doc_id, {', '.join(COUNTS)}, base_failed, NOT base_failed AND coalesce({' AND '.join(fits)}, false) AS kept
FROM s LEFT JOIN lim ON s.lang IS NOT DISTINCT FROM lim.lang AND s.source IS NOT DISTINCT FROM lim.source"""


ORACLE_SQL = _oracle_sql()
