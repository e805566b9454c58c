"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayfind.llm import spelling
from wayfind.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, word string, n long, key long, form string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and edits(v, w) == 1] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def order(rows):
    return sorted(map(str, map(tuple, rows)))


def invented(seed, docs=60, long=300):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(120)]
    out = []
    for d in range(docs):
        words = []
        for _ in range(long):
            w = stems[min(int(rng.expovariate(0.05)), 119)]
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abéÿ×") + w[k:], w[:k] + "B" + w[k + 1 :]])
            words.append(w)
        out.append((d, rng.choice([" ", "-", "Ā", "1"]).join(words)))
    return out


@pytest.mark.parametrize(("seed", "crowded"), [(1, 4096), (2, 5), (3, 2)])
def test_op12_against_brute_force(spark, seed, crowded):
    rows = invented(seed)
    found = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), crowded=crowded)
    want = plain(rows)
    assert order(found.collect()) == order(want)
    assert any(r[1] and r[2] != r[1] for r in want)  # chains of forms


def test_op12_odd_rows(spark):
    rows = [(None, None), (1, None), (2, ""), (3, "12 34"), (None, "nullid nullid"), (4, "repeated words"), (4, "repeated words"), (4, "Repeated WORDS ÀÉÿ×÷"), (5, "àéÿ×÷ ÀÉÿ×÷ ÀÉÿ×÷"), (6, "banana bananas bananan " * 3), (7, "aaaaa aaaaaa aaaaaaa " * 4), (8, ("x" * 100_000 + " ") * 4), (9, "naïve naive naıve " * 5), (10, "éÉéÉé🙂éÉéÉé " * 3)]
    docs = spark.createDataFrame([(*r, "w", 1, 2, "f") for r in rows], SCHEMA)
    assert order(spelling.spelling_variants(docs).collect()) == order(plain(rows))


def test_op12_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    made = QUERIES["op12_spelling_variants"](spark, small)
    assert dict(made.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    found = {r["word"]: tuple(r) for r in made.collect()}
    some = dict(sorted(found.items())[::40])
    counts = {w: r[3] for w, r in found.items()}
    for w, r in some.items():
        near = [v for v in counts if v != w and abs(len(v) - len(w)) <= 1 and edits(v, w) == 1]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        best = best if best and counts[best] >= 2 * counts[w] else None
        assert (r[1], r[4], r[5]) == (best, len(near), counts.get(best))
        assert r[2] == (found[best][2] if best else w)
    assert len(some) > 20 and sum(n for n in counts.values()) == sum(r[3] for r in found.values())
    assert {w: r[3] for w, r in found.items()} == {r[0]: r[3] for r in count_only(rows)}


def count_only(rows):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return [(w, None, None, n) for w, n in counts.items() if len(w) >= 5 and n >= 3]


def test_op12_near():
    rng = random.Random(0)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(2))
        assert spelling.near(a, b) == (edits(a, b) == 1)


@pytest.mark.parametrize("seed", range(4))
def test_op12_merge_loses_nothing(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 8))) for _ in range(150)})
    rng.shuffle(words)
    want = {frozenset((a, b)) for a in words for b in words if edits(a, b) == 1}
    found = [frozenset((words[i], words[j])) for i, j in spelling.near_pairs(words)]
    assert len(found) == len(set(found)) and set(found) == want
    side = [rng.randrange(2) for _ in words]
    across = {frozenset((words[i], words[j])) for i, j in spelling.near_pairs(words, side)}
    assert across == {p for p in want if len({side[words.index(w)] for w in p}) == 2}


def test_op12_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_op12_counts_are_flushed(spark):
    docs = spark.createDataFrame([(k, "alpha bravo charlie delta") for k in range(200)], "doc_id long, text string")
    few = spelling.count_words(docs, "doc_id", "text", 5, 3, 97, most=2)
    assert order(few.collect()) == order(spelling.count_words(docs, "doc_id", "text", 5, 3, 97).collect())
    assert few.agg(F.sum("n")).first()[0] > 700
