"""Quality classifier: naive Bayes support vectors.

Indicators of byte trigrams (hashed to 2^18) and of patterns of equal neighbouring words are scaled by their class
log-count ratios and brought to unit length; a linear hinge-loss model is fitted by dual coordinate descent. Margins become
probabilities by a logistic fit on cross-validated margins. The fit sees a bounded sample of labelled rows; scoring
streams over all texts with one table of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.llm._common import materialise, text_udf

BITS = 18
SIZE = (1 << BITS) + 8


def indicators(text: str | None) -> np.ndarray:
    """The distinct features of a text. Null and empty texts have those of a lone separator."""
    raw = (text or "").encode()
    data = np.frombuffer(b" " + raw + b"  ", np.uint8).astype(np.uint32)
    code = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    slot = (code * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)
    words = raw.split()
    if len(words) > 3:
        ids = np.fromiter(map(hash, words), np.int64, len(words))
        equal = (ids[1:] == ids[:-1]).astype(np.int64)
        slot = np.concatenate((slot, (1 << BITS) + (equal[:-2] << 2 | equal[1:-1] << 1 | equal[2:])))
    last = np.empty(SIZE, np.int32) if len(slot) > 20_000 else None
    if last is None:
        return np.unique(slot)
    last[slot] = np.arange(len(slot), dtype=np.int32)  # one place wins in each slot
    return slot[last[slot] == np.arange(len(slot), dtype=np.int32)]


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.ones((2, SIZE))
    for x, label in zip(rows, y, strict=True):
        counts[int(label > 0), x] += 1
    shares = counts / counts.sum(1, keepdims=True)
    return np.log(shares[1] / shares[0])


def scaled(rows: list[np.ndarray], ratio: np.ndarray) -> list[np.ndarray]:
    return [ratio[x] / max(float(np.sqrt(ratio[x] @ ratio[x])), 1e-9) for x in rows]


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = 1.0, passes: int = 15, seed: int = 0) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + cost * sum max(0, 1 - y (w.x + b)) over the dual box, one variable at a time; b is a constant feature."""
    w, b, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            if step := (new - alpha[i]) * y[i]:
                w[x] += step * v
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def logistic_fit(margins: np.ndarray, y: np.ndarray, steps: int = 50, weight: np.ndarray | None = None) -> tuple[float, float]:
    """a, c of 1 / (1 + exp(-(a m + c))) by Newton's method, with Platt's targets. weight: how often each margin occurs."""
    weight = np.ones(len(y)) if weight is None else weight
    n1, n0 = weight[y > 0].sum(), weight[y <= 0].sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack((margins, np.ones(len(margins))), 1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (weight * (target - p)) - 1e-4 * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return max(float(beta[0]), 0.1), float(beta[1])


def fit(rows: list[np.ndarray], labels: list[int], folds: int = 3) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """ratio, weight (of ratio-scaled features), b, and the logistic a, c. With one class only: its share, whatever the text."""
    y = np.where(np.asarray(labels, int) > 0, 1, -1)
    if len(y) == 0 or abs(int(y.sum())) == len(y):
        share = (0.5 + (y > 0).sum()) / (1 + len(y))
        return np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0, float(np.log(share / (1 - share)))

    def part(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        own = [rows[i] for i in chosen]
        ratio = log_count_ratio(own, y[chosen])
        return ratio, *dual_coordinate_descent(own, scaled(own, ratio), y[chosen])

    margins, fold = np.zeros(len(y)), np.zeros(len(y), int)
    for sign in (1, -1):  # each class dealt over the folds
        of = np.flatnonzero(y == sign)
        fold[of] = np.arange(len(of)) % folds
    for k in range(folds):
        rest = np.flatnonzero(fold != k)
        if abs(int(y[rest].sum())) == len(rest):
            continue
        ratio, w, b = part(rest)
        for i in np.flatnonzero(fold == k):
            margins[i] = w[rows[i]] @ scaled([rows[i]], ratio)[0] + b
    ratio, w, b = part(np.arange(len(y)))
    return ratio, w, b, *logistic_fit(margins, y)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo folds, is fold. A null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % folds == fold


def quality_model(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = 4000, most_features: int = 40_000_000) -> Callable[[Column], Column]:
    """A text to its probability of label 1. Learns from labelled rows outside the held-out fifth, in the order of the hash
    of doc_id: a bounded sample of whole texts, at most `most` rows with `most_features` features among them (160 MB)."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = spark.createDataFrame(chosen.collect() or [], chosen.schema)  # at most `most` small rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    packed = text_udf(lambda: lambda batch: [indicators(t).astype("<i4").tobytes() for t in batch], "binary")
    rows = texts.select("quality", "doc_id", packed(F.col("text")).alias("x"))
    rows = rows.withColumns({"h": F.xxhash64("doc_id"), "hx": F.xxhash64("x"), "size": F.expr("octet_length(x) div 4"), "at": F.monotonically_increasing_id()})
    rows = materialise(rows, "quality-sample")
    first = rows.select("h", "hx", "at", "size").orderBy("h", "hx", "at").limit(most)  # numbers only; features move once they are chosen
    upto = first.withColumn("upto", F.sum("size").over(Window.orderBy("h", "hx", "at"))).where(F.col("upto") <= most_features)
    taken = upto.agg(F.max(F.struct("h", "hx", "at")).alias("last")).first()["last"]
    got = rows.where(F.struct("h", "hx", "at") <= F.struct(*[F.lit(x).cast("long") for x in taken])).orderBy("h", "hx", "at").select("quality", "x").collect() if taken else []
    ratio, w, b, a, c = fit([np.frombuffer(r["x"], "<i4").astype(np.int64) for r in got], [r["quality"] for r in got])
    shared = spark.sparkContext.broadcast(((ratio * w).astype(np.float32), (ratio * ratio).astype(np.float32), b, a, c))

    def make():
        weight, square, b, a, c = shared.value

        def f(batch: list) -> list:
            out = []
            for t in batch:
                x = indicators(t)
                m = float(weight[x].sum(dtype=np.float64)) / max(float(np.sqrt(square[x].sum(dtype=np.float64))), 1e-9) + b
                out.append(float(1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))))
            return out

        return f

    return text_udf(make, "double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs. Null and empty texts are scored by what they have: nothing.
    Unlabelled rows and rows of repeated labels (the larger label holds) are fine; without labels the score is 0.5."""
    score = quality_model(docs.sparkSession, docs, labels, most)
    out = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 4000) -> DataFrame:
    """docs without the rows that the classifier rejects; columns as they were."""
    return docs.where(quality_model(docs.sparkSession, docs, labels, most)(docs["text"]) >= threshold)
