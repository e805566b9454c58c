"""The pipeline's stages against plain versions on their own inputs, and run() as their composition."""

from collections import Counter

import corpus_pipeline
from test_operators import LONG, lines_expected, wide_expected

from wayfind.llm import simhash_wide

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, small).cache()
        if name != "best_fit_packing":
            assert out.columns == COLUMNS
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            assert len(after) == out.count()
        if name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
            assert all(i in after for i in before if labels.get(i) == 1)
            assert len(after) < len(before)
        elif name == "line_dedup":
            want = lines_expected(list(before.items()))
            assert {r["doc_id"]: r["n_chars"] for r in out.collect()} == {i: len(t) for i, t in after.items()}
            import hashlib

            assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in after.items()} == {w[0]: w[3] for w in want}
        elif name == "simhash_near_dedup":
            ids = sorted(before)
            roots = wide_expected([before[i] for i in ids], simhash_wide.most_bits(0.8))
            assert set(after) == {ids[k] for k in roots.values()}
        elif name == "benchmark_decontamination":
            items = [b" ".join(r["text"].lower().encode().split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            leaks = {i for i, t in before.items() if any(x in b" ".join(t.lower().encode().split()) for x in items)}
            assert not leaks & set(after) and set(before) - leaks == set(after)
        else:
            total = Counter()
            for r in out.collect():
                total[r["doc_id"]] += r["n_tokens"]
            assert dict(total) == {i: len((t or "").encode().split()) for i, t in before.items()}
        kept[name] = out.count()
        docs = out
    assert corpus_pipeline.run(spark, small).count() == kept["best_fit_packing"]


def test_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (2, LONG, None, "s", 1, "x"), (2, LONG, None, "s", 1, "x"), (3, LONG, "en", None, 1, None), (None, LONG, "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root string")
    near = corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in near) == [1, 2]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
