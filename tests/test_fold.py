"""Which texts leave the JVM to be folded, and the first edge of two types."""

import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from wayfind.functions import text as T
from wayfind.sources import kg


def test_only_texts_that_may_change_are_sent(spark):
    stable = [c for c in map(chr, range(0xD800)) if re.match(f"[{T.STABLE}]", c)]
    assert unicodedata.normalize("NFKC", "".join(stable)) == "".join(stable)
    assert all(unicodedata.combining(c) == 0 and unicodedata.normalize("NFKC", "a" + c) == "a" + c and unicodedata.normalize("NFKC", "가" + c) == "가" + c for c in stable)
    texts = ["Plain", "Größe É 가나", "ﬁn", "é", "Ａ１", "x²", "a b", "", None, "각", "😀 ½"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["f"] for r in df.select("i", T.fold(F.col("t")).alias("f")).collect()}
    assert got == {i: t if t is None else unicodedata.normalize("NFKC", t).lower() for i, t in enumerate(texts)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_type_pairs_join_few_edges_again(spark):
    random = np.random.default_rng(5)
    kinds = {k: "abc"[k % 3] for k in range(30)}
    edges = [("RS"[int(r)], int(s), int(d)) for r, s, d in zip(random.integers(0, 2, 200), random.integers(0, 30, 200), random.integers(0, 30, 200))]
    ents = spark.createDataFrame(list(kinds.items()), "id long, type string")
    want = {}
    for r, s, d in sorted(edges):
        for pair in ((kinds[s], kinds[d]), (kinds[d], kinds[s])):
            want.setdefault(pair, r)
    out = kg.type_pairs(spark.createDataFrame(edges * 2, "rel_type string, src long, dst long"), ents)
    assert {(r["from_type"], r["to_type"]): r["relation"] for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
