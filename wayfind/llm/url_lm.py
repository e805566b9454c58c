"""URL filter: ratio of two smoothed variable-order character models.

Rules judge what they fit; what they judged teaches two models, of accepted and of rejected URLs, over all rows. Counts of
bytes after contexts of up to five bytes are exact and stand in written tables, which grow with the corpus; each order is
interpolated with the next shorter one, with a weight by how often its context was seen (Witten-Bell). The verdict on other
URLs is the length-normalised log-likelihood difference, put through a logistic fit on a held-out tenth. `places` and
`Model` score with hashed tables of a fixed size, for a few URLs in memory; judge_urls does not use them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm._common import materialise, text_udf
from wayfind.llm.quality_nbsvm import logistic_fit

ORDER, BITS = 5, 16
SPAN = 1 << BITS
VERDICTS, SCALE = ("allow", "block"), 1_000_000_000

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// up to / ? # or the end, A-Z in lower case; path from there up to ? # or the end."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. Of equal length: the first."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def places(url: str) -> np.ndarray:
    """For each byte after the start mark and each order 0..ORDER, the place of context plus byte: (n, ORDER + 1); the same
    without the byte, the place of the context, beside it: shape (2, n, ORDER + 1). Orders have tables of their own."""
    data = np.frombuffer(b"\x01" * ORDER + url.encode() + b"\x02", np.uint8).astype(np.uint64)
    n = len(data) - ORDER
    out = np.empty((2, n, ORDER + 1), np.int64)
    context = np.full(n, 0xCBF29CE484222325, np.uint64)
    for k in range(ORDER + 1):
        if k:
            context = (context ^ data[ORDER - k : ORDER - k + n]) * np.uint64(0x100000001B3)
        whole = (context ^ (data[ORDER:] + np.uint64(256))) * np.uint64(0x9E3779B97F4A7C15)
        out[0, :, k] = (whole >> np.uint64(64 - BITS)).astype(np.int64) + k * SPAN
        out[1, :, k] = (context * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64) + k * SPAN
    return out


class Model:
    """Log-probability of a URL, from hashed counts: grams and contexts (sum and distinct followers)."""

    def __init__(self, grams: np.ndarray, contexts: np.ndarray, kinds: np.ndarray):
        self.grams, self.contexts, self.kinds = grams, contexts, kinds

    def mean_log(self, at: np.ndarray) -> float:
        gram, context = at
        p = np.full(len(gram), 1 / 256)
        for k in range(ORDER + 1):
            seen, kinds = self.contexts[context[:, k]], np.maximum(self.kinds[context[:, k]], 1)
            p = (np.minimum(self.grams[gram[:, k]], seen) + kinds * p) / (seen + kinds)
        return float(np.log(p).mean())


def packed_grams(url: str) -> np.ndarray:
    """For each byte after the start mark: the ORDER bytes before it and the byte, packed into one number."""
    data = np.frombuffer(b"\x01" * ORDER + url.encode() + b"\x02", np.uint8).astype(np.int64)
    n = len(data) - ORDER
    out = np.zeros(n, np.int64)
    for k in range(ORDER + 1):
        out = out << 8 | data[k : k + n]
    return out


def exploded(urls: DataFrame) -> DataFrame:
    """urls, a row for each byte, with the packed gram in place of the URL."""
    grams = text_udf(lambda: lambda texts: [packed_grams(t or "") for t in texts], "array<long>")
    return urls.withColumn("gram", F.explode(grams(F.col("url")))).drop("url")


def gram_scores(urls: DataFrame) -> DataFrame:
    """gram, score: log-probability after rejected URLs less that after accepted ones, in units of 1 / SCALE, for each gram of urls.

    urls: url (distinct), verdict (null: not counted), n (rows). Counts are exact. Grams of a lower order are the ends of
    longer ones, so each table is made from the one above; a key of one order meets at most 256 of the next. Tables that
    grow with the corpus are merged at every size, as their files look smaller than they are.
    """
    counts = {v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(f"n_{v}") for v in VERDICTS}
    table = materialise(exploded(urls).groupBy(F.col("gram").alias("key")).agg(*counts.values()), f"url-counts-{ORDER}")
    tables = [table]
    for k in range(ORDER, 0, -1):
        table = table.groupBy(F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("key")).agg(*[F.sum(f"n_{v}").alias(f"n_{v}") for v in VERDICTS])
        table = materialise(table, f"url-counts-{k - 1}")
        tables.insert(0, table)
    shorter = None
    for k, table in enumerate(tables):
        of_context = Window.partitionBy(F.shiftright("key", 8))
        for v in VERDICTS:
            n = F.col(f"n_{v}")
            table = table.withColumns({f"seen_{v}": F.sum(n).over(of_context), f"kinds_{v}": F.greatest(F.sum((n > 0).cast("long")).over(of_context), F.lit(1))})
        if shorter is None:
            table = table.withColumns({f"q_{v}": F.lit(1 / 256) for v in VERDICTS})
        else:
            table = table.withColumn("end", F.col("key").bitwiseAND((1 << 8 * k) - 1)).join(shorter.select(F.col("key").alias("end"), *[F.col(f"p_{v}").alias(f"q_{v}") for v in VERDICTS]).hint("merge"), "end")
        p = [((F.col(f"n_{v}") + F.col(f"kinds_{v}") * F.col(f"q_{v}")) / (F.col(f"seen_{v}") + F.col(f"kinds_{v}"))).alias(f"p_{v}") for v in VERDICTS]
        shorter = materialise(table.select("key", *p), f"url-model-{k}")
    score = F.round((F.log("p_block") - F.log("p_allow")) * SCALE).cast("long")  # whole numbers, so sums don't depend on order
    return materialise(shorter.select(F.col("key").alias("gram"), score.alias("score")), "url-scores")


def url_probabilities(urls: DataFrame) -> DataFrame | None:
    """url, p_block: the probability that it is to be rejected; None if one side has no rows.

    urls: url (distinct), verdict (null where no rule fits), n (rows). URLs that hash to the held-out tenth calibrate (through
    the numbers of rows of rounded differences), the others are counted.
    """
    tenth = F.pmod(F.xxhash64("url"), F.lit(10)) == 0
    urls = materialise(urls.withColumns({"held": tenth, "id": F.monotonically_increasing_id()}), "urls")
    if urls.where(~F.col("held")).agg(F.count_distinct("verdict")).first()[0] < len(VERDICTS):
        return None
    scores = gram_scores(urls.select("url", F.when(~F.col("held"), F.col("verdict")).alias("verdict"), "n"))
    means = exploded(urls.select("id", "url")).join(scores.hint("merge"), "gram").groupBy("id").agg((F.sum("score") / F.count("*") / SCALE).alias("m"))
    margins = materialise(urls.join(means.hint("merge"), "id").drop("id"), "url-margins")
    known = margins.where(F.col("held") & F.col("verdict").isNotNull())
    seen = known.groupBy("verdict", F.round("m", 2).alias("m")).agg(F.sum("n").alias("n")).collect()  # differences of log means lie within +-10
    if {r["verdict"] for r in seen} == set(VERDICTS):
        y = np.array([1 if r["verdict"] == "block" else -1 for r in seen])
        a, c = logistic_fit(np.array([r["m"] for r in seen]), y, weight=np.array([r["n"] for r in seen], float))
    else:
        a, c = 1.0, 0.0
    x = F.least(F.greatest(F.col("m") * a + c, F.lit(-30.0)), F.lit(30.0))
    return margins.select("url", (1 / (1 + F.exp(-x))).alias("p_block"))


def judge_urls(pages: DataFrame, rules: tuple = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for each row of pages.

    A null URL, or one without ://, has an empty host and path and no rule; the model judges its (empty) text. Where the
    rules accept nothing or reject nothing, there is no model: p_block is null and the verdict is allow. Repeated rows
    come back each. Empty tables give no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    judged = url_probabilities(rows.groupBy("url").agg(F.first("hit.verdict").alias("verdict"), F.count("*").alias("n")))
    out = rows.join(judged.hint("merge"), "url") if judged else rows.withColumn("p_block", F.lit(None).cast("double"))
    verdict = F.coalesce("hit.verdict", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "p_block")
