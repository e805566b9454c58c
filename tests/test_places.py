"""Places by ranges, exact selection, versions that readers see in one step, and vectors of an injected embedder."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from wayfind.operators import vector
from wayfind.operators.places import places, upper_median_by
from wayfind.sources import sinks


def test_places_in_hot_groups(spark):
    """A third of the rows in one group, ties, null keys and null values."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "b", "c", None]), rng.choice([None, *range(40)])) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, g string, v int").repartition(7)
    out = {r["id"]: (r["place"], r["in_group"]) for r in places(places(df, [F.col("v").desc_nulls_first(), F.col("id")]), [F.col("v").asc_nulls_last(), F.col("id")], ("g",), "in_group").collect()}
    whole = sorted(rows, key=lambda r: (r[2] is not None, -(r[2] or 0), r[0]))
    assert all(out[r[0]][0] == i for i, r in enumerate(whole, 1))
    for g in ("hot", "b", "c", None):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
        assert all(out[r[0]][1] == i for i, r in enumerate(mine, 1))
    assert places(df.limit(0), [F.col("id")], ("g",)).count() == 0


def test_places_plan_has_no_single_partition(spark):
    df = places(spark.range(100), [F.col("id").desc()])
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [4, 4096])
def test_upper_median(spark, most):
    rng = random.Random(5)
    rows = [("hot", rng.randrange(10**6)) for _ in range(3001)] + [("even", i) for i in range(10)] + [("one", 7), ("none", None), (None, 3), (None, 4)] + [("same", 9)] * 500
    df = spark.createDataFrame(rows, "g string, v long")
    want = {}
    for g in {r[0] for r in rows}:
        values = sorted(v for h, v in rows if h == g and v is not None)
        if values:
            want[g] = (len(values), values[len(values) // 2], values[0], values[-1])
    assert {r["g"]: tuple(r)[1:] for r in upper_median_by(df, "v", ("g",), 4, most).collect()} == want
    values = sorted(v for _, v in rows if v is not None)
    assert tuple(upper_median_by(df, "v", cuts=4, most=most).first()) == (len(values), values[len(values) // 2], values[0], values[-1])
    assert upper_median_by(df.limit(0), "v").count() == 0


def test_readers_never_miss_a_version(spark, tmp_path):
    path, seen, over = f"{tmp_path}/published", [], threading.Event()
    sinks.publish({"a": spark.range(1), "b": spark.range(1)}, path)

    def read():
        while not over.is_set():
            try:
                version = sinks.versions(spark, path)[-1]
                seen.append(sinks.current(spark, path, "a", version).count() == sinks.current(spark, path, "b", version).count())
            except Exception as e:
                seen.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 8):
        more = sinks.current(spark, path, "a").union(spark.range(n - 1, n))
        sinks.publish({"a": more, "b": spark.range(n)}, path)  # made from the version before
    over.set()
    reader.join()
    assert len(seen) > 1 and all(x is True for x in seen)
    assert sinks.current(spark, path, "a").count() == 7
    with pytest.raises(Exception, match="broken"):
        sinks.publish(spark.range(5).selectExpr("CASE WHEN id = 4 THEN raise_error('broken') ELSE id END AS id"), path)
    assert sinks.current(spark, path, "b").count() == 7
    assert sinks.retire(spark, path, 2) == 5 and len(sinks.versions(spark, path)) == 2 and sinks.current(spark, path, "a").count() == 7
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, f"{tmp_path}/nothing")


def test_backfill_with_is_all_or_nothing(spark, tmp_path):
    def embedder(texts):  # in here, so that it travels by value
        if any("poison" in t for t in texts):
            raise ValueError("the service is down")
        return [[float(len(t)), 1.0, 0.0] for t in texts]

    path = f"{tmp_path}/vectors"
    good = spark.createDataFrame([(i, "x" * i) for i in range(1, 200)] + [(500, None)], "doc_id long, text string")
    done = vector.backfill_with(good, path, embedder, 3, batch=16)
    assert (done["updated"], done["dim"]) == (200, 3)
    held = {r["doc_id"]: r["embedding"] for r in sinks.current(spark, path).collect()}
    assert held[5] == [5.0, 1.0, 0.0] and held[500] == [0.0, 1.0, 0.0]
    bad = good.union(spark.createDataFrame([(900, "poison")], good.schema))
    for docs, dim in ((bad, 3), (good, 4)):
        with pytest.raises(Exception, match="service is down|not 4"):
            vector.backfill_with(docs, path, embedder, dim, batch=16)
        assert sinks.versions(spark, path) == [done["version"]] and sinks.current(spark, path).count() == 200
    one_by_one = vector.embed_rows(bad, embedder, 3, strict=False)
    assert [(r["doc_id"], r["error"]) for r in one_by_one.where("embedding IS NULL").collect()] == [(900, "the service is down")]
    assert one_by_one.where("error IS NULL").count() == 200
