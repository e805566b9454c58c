"""Language ID by multilingual mixtures.

Each language is a distribution over letter trigrams, counted over all training rows into tables of a fixed size. A
document is a mixture of them: expectation-maximisation estimates its proportions, and languages leave one by one, the
least first, while a likelihood penalised by the number of languages grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm._common import text_udf
from wayfind.llm.quality_nbsvm import held_out

BITS = 15
SLOTS = 1 << BITS


def letter_table() -> np.ndarray:
    """Code point to its lower-case letter, or 32, for the basic plane. What lies beyond is a letter as it is."""
    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def trigrams(text: str | None, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the distinct letter trigrams (words between single spaces) and how often each occurs; none without a letter."""
    if not text:
        return np.empty(0, np.int64), np.empty(0)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letters = np.where(points < (1 << 16), table[np.minimum(points, 0xFFFF)], points)
    wide = points >= (1 << 16)
    if wide.any():
        letters = np.where(wide & ~np.array([chr(p).isalpha() for p in points]), 32, letters)
    letters = np.concatenate(([32], letters, [32])).astype(np.uint32)
    letters = letters[np.concatenate(([True], (letters[1:] != 32) | (letters[:-1] != 32)))]
    if len(letters) < 3:
        return np.empty(0, np.int64), np.empty(0)
    code = (letters[:-2] * np.uint32(0x9E3779B1) ^ letters[1:-1] * np.uint32(0x85EBCA77)) * np.uint32(5) + letters[2:] * np.uint32(0xC2B2AE3D)
    slots = ((code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)).astype(np.int64)
    return np.unique(slots, return_counts=True)


def count_trigrams(docs: DataFrame) -> DataFrame:
    """docs: text, lang. Returns lang, slot, n over all rows; each task adds up its own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, tables = letter_table(), {}
        for rows in batches:
            for text, lang in zip(rows["text"], rows["lang"], strict=True):
                slots, n = trigrams(text, table)
                tables.setdefault(lang, np.zeros(SLOTS, np.int64))[slots] += n.astype(np.int64)
        for lang, counts in tables.items():
            slots = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "slot": slots.astype(np.int32), "n": counts[slots]})

    return docs.mapInPandas(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def mixture(starts: np.ndarray, weight: np.ndarray, p: np.ndarray, rounds: int = 6, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document in a batch, and the languages chosen for it (boolean).

    p: (trigrams of all documents, languages), documents at `starts`. Each step runs EM over the languages still in, scores
    log-likelihood - penalty * languages * log(trigrams + 1), and takes out the least, down to one.
    """
    docs, langs = len(starts), p.shape[1]
    of = np.repeat(np.arange(docs), np.diff(np.append(starts, len(p))))
    total = np.add.reduceat(weight, starts)
    share = np.full((docs, langs), 1 / langs, np.float32)
    best, best_score, chosen = share.copy(), np.full(docs, -np.inf), np.ones((docs, langs), bool)
    inside = np.ones((docs, langs), bool)
    for _ in range(langs):
        alone = inside.sum(1).max() == 1
        for _ in range(1 if alone else rounds):
            part = p * share[of]
            share = np.add.reduceat(part * (weight / part.sum(1))[:, None], starts, axis=0) / total[:, None]
        z = np.einsum("ij,ij->i", p, share[of])
        score = np.add.reduceat(weight * np.log(z), starts) - penalty * inside.sum(1) * np.log(total + 1)
        better = score > best_score
        best[better], best_score[better], chosen[better] = share[better], score[better], inside[better]
        if alone:
            break
        # All that hold next to nothing leave at once, and the least of the others; the largest stays.
        left = np.where(inside, share, np.inf)
        out = inside & (share < 0.02)
        out[np.arange(docs), left.argmin(1)] = True
        out[np.arange(docs), share.argmax(1)] = False
        inside &= ~out
        share = np.where(inside, share, 0)
        share = (share / share.sum(1, keepdims=True)).astype(np.float32)
    return best, chosen


def language_model(docs: DataFrame) -> Callable[[Column], Column]:
    """Text to struct<lang string, score double, langs string>. docs: the training rows (text, lang)."""
    counts = count_trigrams(docs.select("text", F.col("lang").cast("string"))).collect()  # at most 2^15 rows a language
    names = sorted({r["lang"] for r in counts})
    table = np.full((SLOTS, max(1, len(names))), 0.5, np.float64)
    column = {lang: k for k, lang in enumerate(names)}
    for lang, slot, n in counts:
        table[slot, column[lang]] += n
    shared = docs.sparkSession.sparkContext.broadcast((names, (table / table.sum(0)).astype(np.float32)))

    def make():
        (names, p), letters = shared.value, letter_table()

        def f(texts: list) -> dict:
            out: dict = {"lang": ["und"] * len(texts), "score": [0.0] * len(texts), "langs": [""] * len(texts)}
            at, slots, weights, size = [], [], [], 0

            def flush() -> None:
                if not at or not names:
                    return
                lengths = [len(s) for s in slots]
                starts = np.concatenate(([0], np.cumsum(lengths[:-1]))).astype(np.int64)
                share, chosen = mixture(starts, np.concatenate(weights).astype(np.float32), p[np.concatenate(slots)])
                for i, s, c in zip(at, share, np.where(chosen, share, -1), strict=True):
                    k = int(np.argmax(c))
                    out["lang"][i], out["score"][i] = names[k], min(1.0, max(0.0, float(s[k])))
                    out["langs"][i] = ",".join(names[j] for j in np.argsort(-c, kind="stable") if c[j] > 0)

            for i, t in enumerate(texts):
                s, n = trigrams(t, letters)
                if len(s):
                    at.append(i), slots.append(s), weights.append(n)
                    size += len(s)
                if size > 100_000:
                    flush()
                    at, slots, weights, size = [], [], [], 0
            flush()
            return out

        return f

    return text_udf(make, "struct<lang: string, score: double, langs: string>")


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the share of lang_pred), langs (all chosen, largest share first) for each row.

    Learns from text and non-null lang of rows outside the held-out quarter. Null texts and texts without a letter are
    `und` with score 0, and so is every text where nothing was learned. Repeated rows come back each; empty tables give
    no rows.
    """
    out = held_out(F.col("doc_id"), 4, 2)
    model = language_model(docs.where(F.col("lang").isNotNull() & ~out))
    rows = docs.select("doc_id", out.alias("held_out"), model(F.col("text")).alias("m"))
    return rows.select("doc_id", "held_out", F.col("m.lang").alias("lang_pred"), F.col("m.score").alias("score"), F.col("m.langs").alias("langs"))
