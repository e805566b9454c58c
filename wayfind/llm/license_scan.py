"""License scan: a trained paragraph classifier, confirmed by templates.

Word unigrams and bigrams of a paragraph are hashed to 2^16 features of a multinomial logistic regression over licence
families and "none". It learns from notices generated from the templates below (with years, holders and lead-ins varied)
and from a bounded sample of the corpus' own paragraphs as "none". A held-out part of both sets the confidence from which a
prediction counts; below it the paragraph is unknown. A prediction is confirmed if the paragraph holds nearly all words of
one of the family's templates in order, all its version numbers and qualifiers, and no other qualifier between them; only
confirmed ones are reported as the licence, the others as `unknown`. A paragraph is a line; where a line looks like a
licence and is not confirmed, the lines around it are read with it, so a notice may be wrapped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm._common import materialise, text_udf
from wayfind.llm._text import WordCache, numbers

BITS = 16
SIZE = 1 << BITS

_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License"
_CC = "This work is licensed under a Creative Commons {} # International License"

#: Licence families and notices that name them; # stands for any number.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU General Public License, version 2", _GNU.format("General Public License", "2"), "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License, version 3", _GNU.format("General Public License", "3"), "SPDX-License-Identifier: GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", _GNU.format("Lesser General Public License", "2.1"), "SPDX-License-Identifier: LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", _GNU.format("Lesser General Public License", "3"), "SPDX-License-Identifier: LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", _GNU.format("Affero General Public License", "3"), "SPDX-License-Identifier: AGPL-3.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "ISC": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "CC-BY": ["Licensed under CC BY #", "CC BY #", _CC.format("Attribution")],
    "CC-BY-NC": ["Licensed under CC BY-NC #", "CC BY-NC #", _CC.format("Attribution-NonCommercial")],
    "CC-BY-SA": ["Licensed under CC BY-SA #", "CC BY-SA #", _CC.format("Attribution-ShareAlike")],
    "CC-BY-ND": ["Licensed under CC BY-ND #", "CC BY-ND #", _CC.format("Attribution-NoDerivatives")],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA #", "CC BY-NC-SA #", _CC.format("Attribution-NonCommercial-ShareAlike")],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND #", "CC BY-NC-ND #", _CC.format("Attribution-NonCommercial-NoDerivatives")],
    "CC0": ["This work is dedicated to the public domain under CC0 #", "Creative Commons Zero # Universal public domain dedication", "SPDX-License-Identifier: CC0"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "Proprietary": ["All rights reserved.", "This document is confidential and proprietary; no part may be reproduced without permission"],
}
FAMILIES = ["none", *TEMPLATES]

#: Words that make another licence of the same sentence, so a match must have its own and no others.
QUALIFIERS = set("lesser library affero noncommercial sharealike noderivatives noderivs nc sa nd zero cc0 gpl lgpl agpl clause not".split())
NUMBER = re.compile(r"\d+(\.\d+)*")
GAP = 8  # words that may stand between two words of a template


def words_of(text: str) -> list[str]:
    """Words in lower case; version numbers are whole and without a last .0 (v2.0, 2.0 and 2 are one)."""
    found = re.findall(r"\bv?\d+(?:\.\d+)*(?![^\W_])|[^\W_]+|#", text.lower())
    return [re.sub(r"(\.0)+$", "", w.lstrip("v")) if NUMBER.fullmatch(w.lstrip("v")) else w for w in found]


def needs(word: str) -> bool:
    """May the word not be missing?"""
    return word == "#" or word in QUALIFIERS or NUMBER.fullmatch(word) is not None


def word_number(word: bytes) -> int:
    """Hash of the letters and digits of a word in lower case; 0 without any."""
    low = "".join(re.findall(r"[^\W_]+", word.decode("utf-8", "replace").lower()))
    return xxhash.xxh64_intdigest(low.encode(), 3) | 1 if low else 0


def features(text: str, cache: WordCache) -> np.ndarray:
    """Hashed unigrams and bigrams of a paragraph; hyphens separate words."""
    ids = numbers(text.replace("-", " ").encode().split(), cache)
    ids = ids[ids > 0]
    pairs = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ ids[1:]
    return (np.concatenate((ids, pairs)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)


def notices(seed: int = 0, times: int = 40) -> Iterator[tuple[str, str]]:
    """(family, paragraph): the templates alone and among other words."""
    random = np.random.default_rng(seed)
    lead = ["", "Copyright (c) {y} {h}.", "(c) {y} {h}", "Copyright {y} {h}", "{h}, {y}.", "The text of this page:", "Note.", "Published {y}."]
    tail = ["", "See the file for details.", "{h}", "All changes are listed below.", "{y}", "Contact {h} with questions."]
    holders = ["the authors", "Acme Corp", "J. Doe", "Example Foundation", "the contributors"]
    numbers_of = lambda text: text.replace("#", str(random.choice(["4.0", "4.0", "4.0", "3.0", "2.0", "1.0"])))
    for family, texts in TEMPLATES.items():
        for text in texts:
            yield family, numbers_of(text)
            for _ in range(times):
                parts = [str(random.choice(lead)), numbers_of(text), str(random.choice(tail))]
                yield family, " ".join(parts).format(y=random.integers(1990, 2030), h=random.choice(holders)).strip()
    others = ["The license of the driver was checked.", "Version 2.0 of the schedule was released.", "A public library under the bridge.", "General terms of use apply.", "He has the right to reserve a table.", "Licensed premises", "This work is done under the supervision of the office."]
    for text in others:
        for _ in range(times):
            yield "none", f"{random.choice(lead)} {text} {random.choice(tail)}".format(y=random.integers(1990, 2030), h=random.choice(holders)).strip()


def train(rows: list[tuple[str, str]], passes: int = 12, rate: float = 0.5, decay: float = 1e-5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (SIZE, families) and bias, by stochastic gradients on unit-length counts."""
    cache, random = WordCache(word_number), np.random.default_rng(seed)
    data = [(features(t, cache), FAMILIES.index(f)) for f, t in rows]
    weight, bias = np.zeros((SIZE, len(FAMILIES))), np.zeros(len(FAMILIES))
    for step in range(passes):
        for i in random.permutation(len(data)):
            x, label = data[i]
            norm = np.sqrt(max(len(x), 1))
            logits = weight[x].sum(0) / norm + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            eta = rate / (1 + step)
            np.subtract.at(weight, x, eta * (p / norm + decay * weight[x]))
            bias -= eta * p
    return weight, bias


def calibrate(weight: np.ndarray, bias: np.ndarray, rows: list[tuple[str, str]], risk: float = 0.001) -> float:
    """The least confidence at which at most that share of held-out "none" paragraphs gets a family; 0.5 at least."""
    cache = WordCache(word_number)
    tops = []
    for family, text in rows:
        if family == "none":
            p, k = confidence(weight, bias, features(text, cache))
            tops.append(p if k else 0.0)
    if not tops:
        return 0.5
    return min(0.9, max(0.5, float(np.quantile(tops, 1 - risk))))


def confidence(weight: np.ndarray, bias: np.ndarray, x: np.ndarray) -> tuple[float, int]:
    logits = weight[x].sum(0) / np.sqrt(max(len(x), 1)) + bias
    p = np.exp(logits - logits.max())
    p /= p.sum()
    return float(p.max()), int(p.argmax())


def _follow(wanted: list[str], words: list[str], at: int, misses: int) -> int:
    """How many of the wanted words stand in order from words[at] on, each within GAP of the one before; 0 if it can't be a match."""
    found = 0
    for w in wanted:
        here = words[at : at + 1] if not found else words[at : at + GAP + 1]
        k = next((k for k, x in enumerate(here) if x == w or w == "#" and NUMBER.fullmatch(x)), None)
        if k is None:
            misses -= 1
            if misses < 0 or needs(w):
                return 0
            continue
        if any(x in QUALIFIERS for x in here[:k]):
            return 0
        found, at = found + 1, at + k + 1
    return found


def template_match(family: str, words: list[str], share: float = 0.9) -> float:
    """The largest share of a template's words found in order in the paragraph, from any start; below `share` it counts as 0."""
    best = 0.0
    for text in TEMPLATES[family]:
        wanted = words_of(text)
        misses = int(len(wanted) * (1 - share) + 1e-9)
        heads = set(wanted[: misses + 1])  # a match begins with one of these
        for at, w in enumerate(words):
            if w in heads:
                best = max(best, _follow(wanted, words, at, misses) / len(wanted))
    return best if best >= share else 0.0


LONGEST = max(len(words_of(t)) for texts in TEMPLATES.values() for t in texts)
MARKS = r"(?i)licen[sc]|copyright|spdx|rights reserved|creative commons|public domain|\bCC\b"


def sample_paragraphs(docs: DataFrame, sample_rows: int, most: int, most_chars: int) -> list[str]:
    """Whole lines without a word of MARKS of the sample_rows documents of the least text hash; `most` lines in the order of
    their hash, with most_chars characters among them. What is sorted is narrow; lines move once they are chosen."""
    hashed = docs.select("text", F.xxhash64("text").alias("h")).where(F.length("text") > 0)
    least = hashed.groupBy("h").agg(F.count("*")).select("h").orderBy("h").limit(sample_rows).collect()
    if not least:
        return []
    own = hashed.where(F.col("h").isin([r["h"] for r in least])).select("h", F.explode(F.split("text", "\n", -1)).alias("line"))
    lines = own.where((F.trim("line") != "") & ~F.col("line").rlike(MARKS)).withColumn("k", F.xxhash64("line")).groupBy("k").agg(F.min("line").alias("line"))
    lines = materialise(lines, "license-lines")
    upto = lines.select("k", F.length("line").alias("n")).orderBy("k").limit(most).withColumn("upto", F.sum("n").over(Window.orderBy("k")))
    last = upto.where(F.col("upto") <= most_chars).agg(F.max("k")).first()[0]
    return [r["line"] for r in lines.where(F.col("k") <= last).orderBy("k").collect()] if last is not None else []


FOUND = "array<struct<paragraph int, family string, predicted string, confidence double, template_share double>>"


def license_scanner(docs: DataFrame, sample_rows: int = 200, sample_lines: int = 2000, sample_chars: int = 20_000_000) -> Callable[[Column], Column]:
    """Text to array<struct<paragraph, family, predicted, confidence, template_share>> of paragraphs that look like a licence.

    "None" is learned from lines of at most sample_rows documents: sample_paragraphs says which.
    """
    rows = [*notices(), *[("none", p) for p in sample_paragraphs(docs, sample_rows, sample_lines, sample_chars)]]
    held = [r for k, r in enumerate(rows) if k % 5 == 0]
    weight, bias = train([r for k, r in enumerate(rows) if k % 5])
    least = calibrate(weight, bias, held)
    shared = docs.sparkSession.sparkContext.broadcast((weight.astype(np.float32), bias.astype(np.float32), least))

    def make():
        (weight, bias, least), cache = shared.value, WordCache(word_number)
        # A paragraph's families can only win with a word or pair that speaks for them more than for "none".
        gain = (weight[:, 1:] - weight[:, :1]).max(1)
        start = float((bias[1:] - bias[0]).max())

        def judge(x: np.ndarray, words: list[str]) -> tuple[str, float, float]:
            """The likeliest of the first three families that a template confirms, else the likeliest; probability; share."""
            logits = weight[x].sum(0) / np.sqrt(max(len(x), 1)) + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            first = [int(k) for k in np.argsort(-p, kind="stable")[:4] if k][:3]
            for k in first:
                if share := template_match(FAMILIES[k], words):
                    return FAMILIES[k], float(1 - p[0]), share
            return FAMILIES[first[0]], float(1 - p[0]), 0.0

        def around(words: list[list[str]], k: int) -> tuple[int, int]:
            """The lines read with line k: its neighbours up to blank ones, as far as a template could reach."""
            ends = []
            for step in (-1, 1):
                at, have = k, 0
                while 0 <= at + step < len(words) and words[at + step] and have < 2 * LONGEST:
                    at += step
                    have += len(words[at])
                ends.append(at)
            return ends[0], ends[1]

        def scan(text: str | None) -> list[dict] | None:
            lines, looks, found = (text or "").split("\n"), {}, []
            for k, line in enumerate(lines):
                x = features(line, cache)
                if not len(x) or start + float(gain[x].sum()) / np.sqrt(len(x)) <= 0:
                    continue  # a bound: "none" wins
                if confidence(weight, bias, x)[1] == 0:
                    continue
                family, p, share = judge(x, words_of(line))
                if p >= least and share:
                    found.append({"paragraph": k, "family": family, "predicted": family, "confidence": p, "template_share": share})
                else:
                    looks[k] = family, p, share
            if looks:
                words, sure = [words_of(line) for line in lines], {r["paragraph"] for r in found}
                read = -1
                for k, (family, p, share) in looks.items():
                    if k <= read:
                        continue  # part of a wrapped notice that was found
                    lo, hi = around(words, k)
                    lo = max([lo, *[j + 1 for j in sure if j < k]])
                    hi = min([hi, *[j - 1 for j in sure if j > k]])
                    if hi > lo:
                        whole = " ".join(lines[lo : hi + 1])
                        wrapped, q, part = judge(features(whole, cache), words_of(whole))
                        if part and max(p, q) >= least:
                            found.append({"paragraph": k, "family": wrapped, "predicted": wrapped, "confidence": max(p, q), "template_share": part})
                            read = hi
                            continue
                    if p >= least or share:
                        found.append({"paragraph": k, "family": "unknown", "predicted": family, "confidence": p, "template_share": share})
            return found or None

        return lambda texts: [scan(t) for t in texts]

    return text_udf(make, FOUND)


def scan_licenses(docs: DataFrame, sample_rows: int = 200, sample_lines: int = 2000, sample_chars: int = 20_000_000) -> DataFrame:
    """doc_id, families (distinct confirmed families in order, comma-joined; empty without any), n_paragraphs (confirmed),
    n_unknown (paragraphs that look like a licence and could not be confirmed), confidence (largest confirmed, else null).

    One row per row of docs. Paragraphs are lines, or wrapped lines read as one; null and empty texts have none. Confidence is
    the probability of a licence. Empty tables give no rows.
    """
    found = docs.select("doc_id", license_scanner(docs, sample_rows, sample_lines, sample_chars)(F.col("text")).alias("m"))
    found = found.select("doc_id", F.coalesce("m", F.expr("array()").cast(FOUND)).alias("m"))
    sure = F.filter("m", lambda x: x["family"] != "unknown")
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size(sure).cast("long").alias("n_paragraphs"),
        (F.size("m") - F.size(sure)).cast("long").alias("n_unknown"),
        F.array_max(F.transform(sure, lambda x: x["confidence"])).alias("confidence"),
    )
