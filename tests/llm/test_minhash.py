"""Near-duplicates by fast similarity sketches against the full sets of shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfind.llm import minhash
from wayfind.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, n long, id long, key string, r int, lead long"


def plain(rows, words=4, percent=80):
    """rows: (doc_id, text). All pairs of sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min((x for x in (d, least.get(find(k))) if x is not None), default=None)
    return [(d, len(sets[k]), least[find(k)] if sets[k] else d, (least[find(k)] if sets[k] else d) == d) for k, (d, _) in enumerate(rows)]


def order(rows):
    return sorted(map(str, map(tuple, rows)))


def varied(seed, families=6, members=30, long=60):
    """Families at every distance: each member changes some words of its family's text, so many links are near 0.8."""
    rng, rows = random.Random(seed), []
    for _ in range(families):
        base = [f"w{rng.randrange(500)}" for _ in range(long)]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(long)] = f"v{rng.randrange(10**6)}"
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize(("seed", "most_rows"), [(1, 1024), (2, 4), (3, 1)])
def test_op13_against_brute_force(spark, seed, most_rows):
    rows = varied(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs, most_rows=most_rows, most_elements=1 << 20 if most_rows > 4 else 200)
    want = plain(rows)
    assert order(found.collect()) == order(want)
    assert 5 < len({r[2] for r in want}) < len(rows)


def test_op13_odd_rows(spark):
    base = " ".join(f"word{k}" for k in range(40))
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two three"), (7, "one two three "), (8, "one two"), (9, base), (9, base), (10, base.upper() + " x")]
    rows += [(None, base + " y"), (None, "alone in its set of words"), (11, "漢字 é " * 500), (12, "漢字 É " * 500), (13, "a b c d e f g h " * 20_000), (14, "a b c d e f g h " * 3)]
    docs = spark.createDataFrame([(*r, 1, 2, "k", 3, 4) for r in rows], SCHEMA)
    found = order(minhash.near_duplicates(docs).collect())
    want = [(d, n, c, True if d is None and c is None else k) for d, n, c, k in plain(rows)]
    assert found == order(want)


def test_op13_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = QUERIES["op13_minhash_near_dedup"](spark, small)
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert order(found.collect()) == order(plain([(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_op13_chain(spark):
    """Neighbours link, the ends of the chain don't: one group all the same."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[10 * k : 10 * k + 120])) for k in range(25)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in found.collect()} == {0}
    assert order(found.collect()) == order(plain(rows))


def test_op13_copies_cost_no_pairs(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    found = minhash.near_duplicates(docs)
    assert found.where("component_id = 0").count() == 20_000 and found.where("kept").count() == 1


def test_op13_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 7, 100, 5000])
def test_op13_sketch(n):
    x = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    whole = minhash.sketch(x)
    assert (whole < np.iinfo(np.uint64).max).all()  # every bin is filled
    assert (minhash.sketch(x, 1) == whole).all() and (minhash.sketch(x[::-1].copy(), 10**6) == whole).all()
    # A sketch of a union is the least of both: what makes coordinates agree as often as sets do.
    half = x[: n // 2 + 1]
    assert (np.minimum(minhash.sketch(half), whole) == whole).all() or n < 100


def test_op13_sketch_estimates():
    rng, found = np.random.default_rng(1), []
    for _ in range(200):
        a, b, c = (rng.integers(0, 2**63, m, dtype=np.uint64) for m in (160, 20, 20))
        found.append((minhash.sketch(np.concatenate([a, b])) == minhash.sketch(np.concatenate([a, c]))).mean())
    assert abs(np.mean(found) - 0.8) < 0.01
    assert np.std(found) <= (0.8 * 0.2 / minhash.BINS) ** 0.5  # at least as concentrated as independent permutations


def test_op13_group_links():
    rng = random.Random(3)
    sets = [np.unique(np.array([rng.randrange(12) for _ in range(9)], np.uint64)) for _ in range(60)]
    ids, groups = [10 * k for k in range(60)], [rng.choice([0, 0, 0, k]) for k in range(60)]
    root = {g: g for g in groups}

    def find(g):
        while root[g] != g:
            g = root[g]
        return g

    for a, b in minhash.group_links(ids, groups, sets, 80):
        root[find(groups[a // 10])] = find(groups[b // 10])
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert find(groups[i]) == find(groups[j])
