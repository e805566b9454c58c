"""Each operator against a plain version of the same contract, and on rows that are null, empty, tied, repeated or oddly named."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayfind.llm import _common, _text, components, decontam, langid, license_scan, line_dedup, packing, quality_nbsvm, quality_rules, sharding, simhash, simhash_wide, url_lm
from wayfind.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, rank long, tokens int, h1 string, m string, fp string"
LONG = "word and another word in a line that is long enough to count"
ODD = [
    (None, None, None, None, None),
    (1, None, "en", None, 0),
    (2, "", None, "s", 0),
    (3, " \t\n\n ", "en", "s", 4),
    (4, "one", "en", "s", 3),
    (5, f"  {LONG}\nx\n{LONG.upper()} ", "en", "s", 0),
    (6, LONG, "en", "s", 0),
    (6, LONG, "en", "s", 0),
    (7, f"{LONG}\n{LONG}", "en", "t", 0),
    (8, f"É {LONG}\né {LONG}\n{LONG}", "fr", "t", 0),
    (9, "漢字 かな 🙂 " * 3, "xx", "t", 0),
    (10, "a b c d e f g h " * 3000, "en", "t", 0),
    (None, LONG, "en", "t", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "k", 7, 8, 9, "h", "m", "f") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]


def lines_expected(rows):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    held = defaultdict(list)
    for r in rows:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            held[k].append(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        keep = []
        for x in lines:
            own = held[key(x)]
            if len(key(x)) >= 40 and len(own) >= 5 and r[0] != max((i for i in own if i is not None), default=None):
                continue
            keep.append(x)
        out.append((r[0], len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


def order(found):
    return sorted(found, key=str)


def test_op1(docs, rows, odd):
    assert order(map(tuple, line_dedup.line_dedup_report(docs).collect())) == order(lines_expected(rows))
    found = order(map(tuple, line_dedup.line_dedup_report(odd).collect()))
    assert found == order(lines_expected(ODD))
    assert sum(r[2] for r in found) > 0
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)


def test_op1_many_lines(spark):
    text = "\n".join(f"{k % 100} {LONG}" if k % 3 else str(k) for k in range(500))
    data = [(i, text) for i in range(6)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert order(map(tuple, line_dedup.line_dedup_report(df).collect())) == order(lines_expected(data))


def test_op1_counts_documents_not_lines(spark):
    data = [(i, f"{LONG}\n{LONG}\n{i} {LONG}") for i in range(4)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert all(r["n_dropped"] == 0 for r in line_dedup.line_dedup_report(df).collect())
    df = df.union(spark.createDataFrame([(9, LONG)], df.schema))
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup_report(df).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 9: 0}


def test_op1_sorts_and_streams(spark):
    """One range exchange and one sort; with more keys a task than an aggregate by hash would hold, each run is in order and its first marked."""
    hashes = spark.range(400_000).select((F.col("id") % 5_000).alias("h1"), (F.col("id") % 5_000).alias("h2"), (F.col("id") % 3).alias("d"), F.lit(7).cast("long").alias("t"), (F.col("id") % 3).alias("r"), F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int").alias("pos"))
    runs = line_dedup.line_runs(hashes)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    seen, last, n = set(), None, 0
    for r in runs.select("h1", "d", "pos", "first").toLocalIterator():
        key = (r["h1"], r["d"])
        assert r["first"] == (key not in seen)
        if key in seen:
            assert last[0] == key and last[1] <= r["pos"]
        seen.add(key)
        last, n = (key, r["pos"]), n + 1
    assert n == 400_000 and len(seen) == 15_000


def test_op1_first_only_against_plain_code(spark):
    """Many keys a task, each several times a document: only the first occurrence stays, and in the keeper alone."""
    lines = [f"line number {i:05d} " + "x" * 40 for i in range(700)]
    texts = [(d, "\n".join(lines[(d * 13 + j * 7) % 700] for j in range(1500))) for d in range(8)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), first_only=True).collect()}
    holders = {}
    for d, t in texts:
        for line in set(t.split("\n")):
            holders.setdefault(line, set()).add(d)
    for d, t in texts:
        kept, seen = [], set()
        for line in t.split("\n"):
            if len(holders[line]) < 5 or (d == max(holders[line]) and line not in seen):
                kept.append(line)
            seen.add(line)
        assert got[d] == "\n".join(kept)


def test_op1_first_only(spark):
    """Without the contract's rule that the keeper keeps all: only the first occurrence stays, by position."""
    data = [(i, f"a\n{LONG}\nb\n{LONG}\nc") for i in range(5)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, first_only=True).collect()}
    assert out == {**dict.fromkeys(range(4), "a\nb\nc"), 4: f"a\n{LONG}\nb\nc"}


def test_op1_sql_on_repeated_rows(odd):
    """The SQL and the operator mean the same by a document: a row."""
    rows = odd.where("doc_id is not null").toPandas()[["doc_id", "text"]]
    con = duckdb.connect()
    con.register("documents", rows)
    assert order(con.sql(ORACLE_SQL["op1_line_dedup"]).fetchall()) == order(map(tuple, line_dedup.line_dedup_report(odd.where("doc_id is not null")).collect()))


def test_op1_sql(spark, small, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert order(con.sql(ORACLE_SQL["op1_line_dedup"]).fetchall()) == order(map(tuple, QUERIES["op1_line_dedup"](spark, small).collect()))


def counts_expected(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(text.split("\n")) if text else 0


def test_op2_counts(rows):
    for r in [*rows, *ODD]:
        assert quality_rules.text_counts(r[1]) == counts_expected(r[1])
    for text in ("a " * 16, "a b " * 9, "x\nx\ny\nx", "# #\n# #"):
        assert quality_rules.text_counts(text) == counts_expected(text)


def test_op2(spark, small, docs, odd):
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for r in found.values():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = [found[i]["kept"] for i, q in labels.items() if q and not found[i]["base_failed"]]
    assert np.mean(good) > 0.97
    out = quality_rules.quality_rules(odd).collect()
    assert len(out) == len(ODD)
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


def test_op2_follows_the_group(spark):
    """A source whose own documents are full of symbols keeps them; the same document elsewhere goes."""
    plain = " ".join(f"w{k}" for k in range(40))
    marked = " ".join(f"w{k}#" for k in range(40))
    data = [(k, f"{plain} {k}", "en", "plain") for k in range(100)] + [(100 + k, f"{marked} {k}", "en", "marked") for k in range(100)] + [(999, marked, "en", "plain")]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[k] for k in range(200)) and not out[999]


def test_op2_thresholds_come_from_the_groups(spark):
    """On the driver's own tables: fences differ between groups of a language, and decide."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_rules.quality_counts(docs).select("doc_id", "lang", "source", "__counts.*")
    rows = rows.where("n_words >= 20").withColumns({f"s_{k}": F.expr(e) for k, (e, _, _) in quality_rules.SIGNALS.items()})
    found = quality_rules.thresholds(rows, 3.0, 20, 0.002).collect()
    for k in ("word_length", "repeats", "dup_lines"):
        assert len({r[f"hi_{k}"] for r in found if r["lang"] == "en"}) > 5
    out = quality_rules.quality_rules(docs)
    assert out.where("not base_failed and not kept").count() > 5


def test_op2_sketch(spark):
    """Fences are within the accuracy of those of exact quantiles, and do not depend on how rows are partitioned."""
    random = np.random.default_rng(3)
    values = np.concatenate((np.zeros(300), random.gamma(2.0, 3.0, 700)))
    data = [("en", "s", float(v), 0.0, 0.0, float(v)) for v in values]
    rows = spark.createDataFrame(data, "lang string, source string, s_symbols double, s_repeats double, s_dup_lines double, s_word_length double")
    seen = set()
    for parts in (1, 7):
        r = quality_rules.thresholds(rows.repartition(parts), 3.0, 20, 0.002).first()
        seen.add((r["hi_symbols"], r["lo_word_length"], r["hi_repeats"]))
    (hi, lo, none), *others = seen
    q = {p: np.quantile(values, p, method="inverted_cdf") for p in (0.1, 0.5, 0.9)}
    assert not others and none == 0
    assert abs(hi - (q[0.9] + 3 * (q[0.9] - q[0.5]))) < 0.002 * 4 * (q[0.9] + q[0.5]) and abs(lo - (q[0.1] - 3 * (q[0.5] - q[0.1]))) < 0.002 * 4 * q[0.5]


def pack_expected(items, capacity, per_source):
    """Best fit by looking at every bin."""
    bins = []
    for size, k in sorted(((t % capacity, k) for k, (t, _, _) in enumerate(items) if t % capacity), key=lambda x: (-x[0], x[1])):
        _, s, c = items[k]
        fit = [b for b in bins if b["left"] >= size and (c is None or c not in b["c"]) and (s is None or b["s"][s] < per_source)]
        b = min(fit, key=lambda b: (b["left"], b["n"]), default=None)
        if b is None:
            bins.append(b := {"left": capacity, "c": set(), "s": Counter(), "n": len(bins), "of": []})
        b["left"] -= size
        b["c"].add(c)
        b["s"][s] += 1
        b["of"].append(k)
    return sorted(tuple(b["of"]) for b in bins)


@pytest.mark.parametrize("seed", range(5))
def test_op3_pack(seed):
    random = np.random.default_rng(seed)
    items = [(int(random.integers(0, 130)), f"s{random.integers(0, 3)}" if random.random() < 0.9 else None, int(random.integers(0, 40)) if random.random() < 0.8 else None) for _ in range(200)]
    found = packing.pack(items, 100, 2)
    bins = defaultdict(list)
    for k, _, _, n, b, _ in found:
        bins[b].append((k, n))
    for b, own in bins.items():
        if b >= 0:
            assert sum(n for _, n in own) <= 100
    rests = sorted(tuple(k for k, n in own) for b, own in bins.items() if b >= 0 and not (len(own) == 1 and own[0][1] == 100))
    assert rests == pack_expected(items, 100, 2)
    whole = Counter()
    for k, _, _, n, _, _ in found:
        whole[k] += n
    assert [whole[k] for k in range(200)] == [t for t, _, _ in items]


def test_op3(docs, rows, odd):
    found = packing.pack_documents(docs, group_rows=64).collect()
    source = {r[0]: r[3] for r in rows}
    text = {r[0]: " ".join((r[1] or "").lower().encode().split().__repr__().split()) for r in rows}
    bins = defaultdict(list)
    for r in found:
        bins[r["bin_id"]].append(r)
    for b, own in bins.items():
        if b is None:
            continue
        assert sum(r["n_tokens"] for r in own) <= 2048
        assert max(Counter(source[r["doc_id"]] for r in own).values()) <= 4
        assert max(Counter(text[r["doc_id"]] for r in own).values()) == 1
        spans = sorted((r["bin_offset"], r["n_tokens"]) for r in own)
        assert all(a + n == c for (a, n), (c, _) in zip(spans, spans[1:], strict=False))
    total = Counter()
    for r in found:
        total[r["doc_id"]] += r["n_tokens"]
    assert total == Counter({r[0]: len((r[1] or "").encode().split()) for r in rows}) + Counter()
    assert packing.pack_documents(odd).where("bin_id is null").count() == 4
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_op3_does_not_depend_on_partitions(docs, odd):
    for df, size in ((docs, 32), (odd, 4)):
        one, two = (order(map(tuple, packing.pack_documents(df.repartition(n), group_rows=size).collect())) for n in (1, 6))
        assert one == two and len(one) >= df.count()


def test_op3_large_ids(spark):
    ids = [(1 << 62) + 1, (1 << 62) + 2, None]
    docs = spark.createDataFrame([(i, "a b", "s") for i in ids], "doc_id long, text string, source string")
    assert order(r["doc_id"] for r in packing.pack_documents(docs).collect()) == order(ids)


def test_op3_opens_bins_again(spark):
    """Small groups come near to one large one, as what they leave loose is packed together."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    bins = lambda **k: packing.pack_documents(docs, **k).select("bin_id").distinct().count()
    whole = bins()
    assert bins(group_rows=128) <= whole * 1.01 < bins(group_rows=128, full=0.0)


def fp_expected(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_expected(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def near_expected(rows):
    fps = [fp_expected(r[1]) for r in rows]
    roots = components_expected([(i, j) for i in range(len(rows)) for j in range(i + 1) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[roots[i]].append(r[0])
    return order((r[0], f"{fps[i]:016x}", min((x for x in least[roots[i]] if x is not None), default=None)) for i, r in enumerate(rows))


def test_op4(docs, rows, odd):
    assert order(map(tuple, simhash.simhash_report(docs).collect())) == near_expected(rows)
    assert order(map(tuple, simhash.simhash_report(odd).collect())) == near_expected(ODD)
    assert simhash.simhash_report(odd.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [4096, 5])
def test_op4_links_lose_nothing(spark, crowded):
    """Random balls around a few centres, with files both below and above the bound."""
    random = np.random.default_rng(1)
    fps = set()
    for _ in range(4):
        centre = int(random.integers(0, 1 << 63))
        for _ in range(60):
            fps.add(centre ^ sum(1 << int(b) for b in random.choice(64, random.integers(0, 5), replace=False)))
    fps = sorted(fps)
    want = components_expected([(a, b) for a in fps for b in fps if a <= b and (a ^ b).bit_count() <= 3])
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    links = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), crowded=crowded).collect()
    got = components_expected([(x, x) for x in signed] + [tuple(r) for r in links])
    split = lambda of, name: sorted(sorted(name(x) for x in of if of[x] == r) for r in set(of.values()))
    assert split(want, lambda x: x) == split(got, lambda x: x % (1 << 64))


def jaccard_sets(texts, words=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    return out


def wide_expected(texts, distance):
    """Links by looking at every pair: a key in common and few enough differing bits."""
    cache = _text.WordCache(lambda word: xxhash.xxh64_intdigest(word, 11))
    made = [simhash_wide.wide_fingerprint(simhash_wide.shingles(t, 5, cache)) for t in texts]
    bits = np.array([np.unpackbits(np.frombuffer(b, np.uint8)) for b, _ in made])
    keys = [set(k.tolist()) for _, k in made]
    return components_expected([(i, j) for i in range(len(texts)) for j in range(i + 1) if (i == j or keys[i] & keys[j]) and (bits[i] != bits[j]).sum() <= distance])


def copies(random, n=60, length=200):
    """Texts with copies that differ in some words."""
    out = []
    for _ in range(n):
        words = [f"w{x}" for x in random.integers(0, 3000, length)]
        out.append(" ".join(words))
        for _ in range(random.integers(0, 3)):
            other = list(words)
            for at in random.integers(0, length, random.integers(1, 10)):
                other[at] = "new"
            out.append(" ".join(other))
    return out


@pytest.mark.parametrize("crowded", [16_384, 2])
def test_wide_simhash_against_brute_force(spark, crowded):
    texts = [*copies(np.random.default_rng(4)), None, "", "one two", "one two", "ONE two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked, found = simhash_wide.similar_duplicates(docs, crowded=crowded)
    got = {r["doc_id"]: r["component_id"] for r in marked.join(found, "fp").collect()}
    if crowded > 2:
        assert got == wide_expected(texts, simhash_wide.most_bits(0.8))
    assert {r["doc_id"] for r in simhash_wide.one_of_each(docs, crowded=crowded).collect()} == set(got.values())
    sets = jaccard_sets(texts)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    far = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) < 0.3 * len(sets[i] | sets[j])]
    assert len(near) > 40 and np.mean([got[i] == got[j] for i, j in near]) >= 0.95
    assert not any(got[i] == got[j] for i, j in far)


def test_wide_simhash_recall_on_tables(spark):
    """Near copies of the driver's own tables, found by exact Jaccard similarity over an index of shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids, sets = list(texts), jaccard_sets(texts.values())
    index = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            index[x].append(k)
    pairs = {(i, j) for held in index.values() for i in held for j in held if i < j and texts[ids[i]] != texts[ids[j]]}
    near = [(ids[i], ids[j]) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    marked, found = simhash_wide.similar_duplicates(docs)
    got = {r["doc_id"]: r["component_id"] for r in marked.join(found, "fp").collect()}
    assert len(near) > 10 and np.mean([got[i] == got[j] for i, j in near]) >= 0.9


def test_wide_votes():
    """Each bit's votes, by counting; more than 255 hashes."""
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 700).astype(np.uint64)
    one = [simhash_wide.votes(hashes[k : k + 1]) for k in range(len(hashes))]
    assert set(np.unique(one)) == {0, 1} and (simhash_wide.votes(hashes) == np.sum(one, 0)).all()
    assert abs(np.mean(one) - 0.5) < 0.01


def test_components(spark):
    random = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in random.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components_expected(pairs)
    assert found == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op5(spark, small, docs):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    want = {
        (d["doc_id"], b["item_id"])
        for b in bench.collect()
        for d in docs.collect()
        if b" ".join(b["text"].lower().encode().split()) in b" ".join(d["text"].lower().encode().split())
    }
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    assert want and want <= found
    left = decontam.drop_leaks(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in found})


def test_op5_slots(spark):
    item = "A train leaves the station at 9 and travels 120 km before it meets Anna near the bridge over the river"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "7 8"), (5, item)], "item_id long, text string")
    texts = [
        f"Before. {item.replace('9', '17').replace('120', '450').replace('Anna', 'Peter')}. After.",  # other numbers and names
        f"before {item.upper()} after",
        "A train leaves the other station later and meets nobody near a bridge",
        None,
        "",
        "the of and to in",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    assert found == {(0, 1), (0, 5), (1, 1), (1, 5)}
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "He bought 5 apples at noon and then sold 5 apples again to the shop")], "item_id long, text string")
    ask = spark.createDataFrame([(0, "He bought 8 apples at noon and then sold 8 apples again to the shop"), (1, "He bought 8 apples at noon and then sold 3 apples again to the shop")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.find_leaks(ask, twice).collect()) == [0, 1]  # only the window with both slots is vetoed
    near = spark.createDataFrame([(1, "He bought 5 apples and 5 pears at noon")], "item_id long, text string")
    ask = spark.createDataFrame([(0, "He bought 7 apples and 7 pears at noon"), (1, "He bought 7 apples and 8 pears at noon")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontam.find_leaks(ask, near).collect()] == [0]
    two = spark.createDataFrame([(1, "He bought 3 apples and 4 pears at noon")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.find_leaks(ask, two).collect()) == [0, 1]  # different values may become equal


def test_op5_names_begin_sentences(spark):
    item = "Tom has 12 apples. Ann gives him 7 more. Tom eats 3 of them. Paris is far away. How many apples are left?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = item.replace("12", "31").replace("7", "8").replace("3 of", "5 of")
    texts = [
        other.replace("Tom", "Bob").replace("Ann", "Eve").replace("Paris", "Oslo"),
        "Before. " + other.replace("Tom", "Mary Lou").replace("Ann", "EVE").replace("Paris", "New York") + " After.",
        other.replace("Tom", "BOB", 1).replace("Tom", "Jim").replace("Ann", "Eve").replace("Paris", "Oslo"),  # one slot, two values, in windows apart
        "Rivers run far away. Who gives more? Many eat apples. Anna has 3 pears. She is left alone.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.find_leaks(docs, bench).collect()) == [0, 1, 2]


def leaks_expected(docs, items, width=8, coverage=0.5):
    """Every window of every document against every window of every item, as tuples of template words with the slots spelled out."""
    pack = decontam.packer()

    def windows(text):
        words = (text or "").encode().split()
        packed = np.array([pack(w) for w in words], np.uint64)
        if len(words) < 3:
            return words, []
        plain, named = decontam.templates(packed)
        short, begins = decontam.short_names(packed, plain)
        out = []
        for kind, reading, at in ((0, plain, range(len(words) + 1)), (0, named, range(len(words) + 1)), (1, short, begins)):
            value = [b" ".join(words[at[k] : at[k + 1]]).strip(b".,;:!?").lower() if reading[k] <= decontam.NAME else None for k in range(len(reading))]
            out.append((kind, [int(x) for x in reading], value, [int(x) for x in at]))
        return words, out

    known = defaultdict(list)
    sizes = {}
    for i, text in items:
        words, readings = windows(text)
        if len(words) < 3 or sum(x > decontam.NAME for x in readings[0][1]) < 3:
            continue
        sizes[i] = len(words)
        for kind, reading, value, at in readings:
            w = min(width, len(reading))
            for k in range(len(reading) - w + 1):
                if sum(x > decontam.NAME for x in reading[k : k + w]) >= min(3, w):
                    known[kind, w, tuple(reading[k : k + w])].append((i, at[k], at[k + w], value[k : k + w]))
    out = []
    for d, text in docs:
        hits = defaultdict(set)
        where = {}
        for kind, reading, value, at in windows(text)[1]:
            for w in range(1, width + 1):
                for k in range(len(reading) - w + 1):
                    for i, first, last, own in known.get((kind, w, tuple(reading[k : k + w])), ()):
                        if all(value[k + a] == value[k + b] for a in range(w) for b in range(a) if own[a] is not None and own[a] == own[b] and reading[k + a] == reading[k + b]):
                            hits[i] |= set(range(first, last))
                            where[i] = min(where.get(i, 1 << 60), at[k])
        out += [(d, i, len(c) / sizes[i], where[i]) for i, c in hits.items() if len(c) >= coverage * sizes[i]]
    return order(out)


def templated(random, names=("Tom", "Ann", "Bob", "EVE", "Mary Lou", "New York", "Oslo")):
    """Word problems with numbers and names exchanged, cut and mixed."""
    stems = ["{n} has {a} apples and {b} pears. {m} gives {n} {a} more.", "How many km does {n} travel in {a} hours at {b} km before {m} arrives?", "{n} sold {a} kg of rice and {m} sold {b} kg. Who sold more?"]
    text = " ".join(str(random.choice(stems)).format(n=random.choice(names), m=random.choice(names), a=random.integers(1, 6), b=random.integers(1, 6)) for _ in range(random.integers(1, 4)))
    words = text.split()
    return " ".join(words[: random.integers(2, len(words) + 1)])


@pytest.mark.parametrize("crowd", [64, 2])
def test_op5_against_brute_force(spark, crowd):
    random = np.random.default_rng(7)
    items = [(k, templated(random)) for k in range(25)] + [(100, None), (101, "a b"), (102, "one two three four"), (103, "one two three four")]
    docs = [(k, f"{'Before this. ' * (k % 2)}{templated(random)} and so on. {templated(random)}") for k in range(60)] + [(60, None), (61, ""), (62, "then one two three four"), (62, "then one two three four")]
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), crowd=crowd, filter_bits=10)
    want = leaks_expected(docs, items)
    assert order(map(tuple, found.collect())) == want and len(want) > 100


def test_op5_on_tables(spark, small, docs, rows):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    want = leaks_expected([(r[0], r[1]) for r in rows], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert order(map(tuple, decontam.find_leaks(docs, bench).collect())) == want


def test_op5_odd_rows(spark, odd):
    """Repeated rows, clashing columns and ids that are not numbers."""
    bench = spark.createDataFrame([("x", LONG, "k"), (None, LONG, "k"), ("y", None, "k")], "item_id string, text string, doc_id string")
    named = odd.withColumn("item_id", F.lit("i")).withColumn("cls", F.lit(1)).withColumn("r", F.lit(2)).withColumn("t", F.lit(3))
    found = order((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(named, bench).collect())
    holds = [r[0] for r in ODD if r[1] and LONG in r[1].replace("\n", " ")]
    assert found == order((d, i) for d in holds for i in ("x", None))
    left = decontam.drop_leaks(named, bench)
    assert left.columns == named.columns and left.count() == len(ODD) - len(holds)
    assert decontam.find_leaks(named.limit(0), bench).count() == 0 and decontam.drop_leaks(named, bench.limit(0)).count() == len(ODD)


def test_hilbert_curve():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    at = sharding.hilbert_index(list(points.T), 3)
    assert sorted(at) == list(range(512))
    path = points[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()  # each step goes to a neighbour


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_op6(docs, rows, odd, law):
    for df, data in ((docs, rows), (odd, ODD)):
        found = sharding.hilbert_shards(df, law=law).collect()
        assert order((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == order((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in data)
        slots, sizes = defaultdict(list), Counter({k: 0 for k in range(16)})
        for r in found:
            slots[r["shard"]].append(r["slot"])
            sizes[r["shard"]] += 1 if law == "rows" else r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert set(slots) <= set(range(16))
        assert max(sizes.values()) - min(sizes.values()) <= (1 if law == "rows" else 2 * max(r["size"] for r in found))
        along = [r["curve_index"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))]
        assert along == sorted(along)
    assert sharding.hilbert_shards(odd.limit(0), law=law).count() == 0


def test_op6_against_a_second_construction(rows, docs):
    """Cells by counting rows by hand (the curve itself has a test of its own), one sort, and ranks give the shards."""

    def cells(column):
        names = sorted({r[column] for r in rows}, key=lambda x: (x is not None, x or ""))
        before, out = 0, {}
        for name in names:
            out[name] = min(31, before * 32 // len(rows))
            before += sum(r[column] == name for r in rows)
        return out

    lang, source = cells(2), cells(3)
    size = {r[0]: len((r[1] or "").encode()) + 1 for r in rows}
    points = np.array([(lang[r[2]], source[r[3]], min(31, size[r[0]].bit_length() - 1)) for r in rows])
    index = {r[0]: int(i) for r, i in zip(rows, sharding.hilbert_index(list(points.T)), strict=True)}
    ranked = sorted(rows, key=lambda r: (index[r[0]], zlib.crc32((r[1] or "").encode()), size[r[0]], r[0]))
    shard = {r[0]: k * 16 // len(rows) for k, r in enumerate(ranked)}
    firsts = {s: min(k for k, r in enumerate(ranked) if shard[r[0]] == s) for s in set(shard.values())}
    want = {r[0]: (index[r[0]], shard[r[0]], k - firsts[shard[r[0]]]) for k, r in enumerate(ranked)}
    assert {r["doc_id"]: (r["curve_index"], r["shard"], r["slot"]) for r in sharding.hilbert_shards(docs).collect()} == want


def test_op6_equal_texts_are_neighbours(spark):
    data = [(k, f"text {k % 7}", "en", "s") for k in range(70)]
    found = sharding.hilbert_shards(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), shards=2).collect()
    along = [r["text_crc32"] for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(a != b for a, b in zip(along, along[1:], strict=False)) == 6


def held(i, folds, fold):
    return zlib.crc32(str(i if i is not None else "").encode()) % folds == fold


def test_op7(spark, odd):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = QUERIES["op7_quality_classifier"](spark, sf).collect()
    assert len(found) == 1000
    test = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    good = [p for p, q in test if q]
    assert np.mean(good) > 0.97 and np.mean([p == q for p, q in test]) > 0.93
    marks = spark.createDataFrame([(5, 1), (6, 0), (6, 0), (None, 1), (99, 1)], "doc_id long, quality int")
    assert quality_nbsvm.quality_scores(odd, marks).where("score between 0 and 1").count() == len(ODD)
    assert quality_nbsvm.quality_scores(odd, marks.limit(0)).where("score = 0.5").count() == len(ODD)
    assert quality_nbsvm.keep_good(odd, marks.limit(0)).columns == odd.columns
    assert quality_nbsvm.quality_scores(odd.limit(0), marks).count() == 0


def test_op7_against_plain_code(spark, docs, small):
    """The sample, the fit and the scores without Spark."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = [i for i in labels if i in texts and not held(i, 5, 0)]
    by = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    ids = sorted(ids, key=lambda i: by[i])
    ratio, w, b, a, c = quality_nbsvm.fit([quality_nbsvm.indicators(texts[i]) for i in ids], [labels[i] for i in ids])
    for r in quality_nbsvm.quality_scores(docs, spark.read.parquet(f"{small}/labels.parquet")).collect():
        x = quality_nbsvm.indicators(texts[r["doc_id"]])
        margin = (ratio * w)[x].sum() / np.sqrt((ratio[x] ** 2).sum()) + b
        assert abs(r["score"] - 1 / (1 + np.exp(-(a * margin + c)))) < 1e-3


def test_op7_bounds_the_sample(spark):
    docs = spark.createDataFrame([(k, f"word{k} good text" if k % 2 else f"#{k} || bad") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = quality_nbsvm.quality_model(spark, docs, labels, most_features=100)
    assert docs.select(model(F.col("text")).alias("p")).where("p between 0 and 1").count() == 60


def test_dual_coordinate_descent_reaches_the_optimum():
    random = np.random.default_rng(0)
    x = random.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + random.normal(size=60) * 0.3 > 0, 1, -1)
    rows = [np.arange(5) for _ in y]
    w, b = quality_nbsvm.dual_coordinate_descent(rows, list(x), y, passes=500)
    value = lambda w, b: (w @ w + b * b) / 2 + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = value(w[:5], b)
    for _ in range(300):
        assert value(w[:5] + random.normal(size=5) * 0.05, b + random.normal() * 0.05) >= best - 1e-2


def judged_expected(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_lm.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, None)


def test_op8(spark, small):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(1000 + k, u) for k, u in enumerate([None, "", "x", "http://", "HTTP://A.ORG/x?y#z", "a://b.example.org/en/12://c", "http://example.org?q=/es/", "ftp://forg/a", "http://x.com/fr", "http://É.org/é"])]
    pages = pages.union(spark.createDataFrame(odd, "page_id long, url string"))
    url = {r["page_id"]: r["url"] for r in pages.collect()}
    found = url_lm.judge_urls(pages).collect()
    assert len(found) == len(url)
    for r in found:
        host, path, rule, verdict = judged_expected(url[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["p_block"] >= 0.5 else "allow"))
    ruled = [(r["p_block"] >= 0.5) == (r["verdict"] == "block") for r in found if r["rule"]]
    assert np.mean(ruled) > 0.9
    none = url_lm.judge_urls(pages.where("url like '%.net%'"))
    assert none.where("verdict = 'allow' and p_block is null").count() == none.count() > 0
    assert url_lm.judge_urls(pages.limit(0)).count() == 0


def test_op8_odd_rows(spark):
    """Repeated ids, names that the operator uses itself, and very long URLs."""
    rows = [(1, "http://a.org/x"), (1, "http://a.org/x"), (2, "http://b.com/de/y"), (3, None), (None, "http://c.net/" + "long/" * 20_000), (4, "http://b.com/fr/z")]
    rows += [(10 + k, f"http://h{k}.org/{k}") for k in range(40)] + [(100 + k, f"http://h{k}.com/de/{k}") for k in range(40)]
    pages = spark.createDataFrame([(*r, "h", "t", "p", 1) for r in rows], "page_id long, url string, host string, hit string, p_block string, n int")
    found = url_lm.judge_urls(pages)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "p_block"] and found.count() == len(rows)
    by = Counter((r["page_id"], r["host"], r["rule"], r["verdict"]) for r in found.collect() if r["page_id"] in (1, 2, 4))
    assert by == {(1, "a.org", "org/", "allow"): 2, (2, "b.com", "com/de/", "block"): 1, (4, "b.com", "com/fr/", "allow"): 1}


def test_op8_verdicts_against_plain_code(spark):
    """Counting, calibration and verdict without Spark, over URLs of which a tenth is held out."""
    random = np.random.default_rng(3)
    urls = sorted({f"http://{random.choice(['a', 'bb', 'site'])}{random.integers(0, 30)}.{random.choice(['org', 'com/de', 'com/fr', 'net'])}/{random.integers(0, 50)}" for _ in range(400)})
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    by = {r["page_id"]: r for r in url_lm.judge_urls(pages).collect()}
    held = {r["page_id"] for r in pages.where(F.pmod(F.xxhash64("url"), F.lit(10)) == 0).collect()}
    grams, contexts, follow = Counter(), Counter(), defaultdict(set)
    marks = lambda u: b"\x01" * 5 + u.encode() + b"\x02"
    for i, u in enumerate(urls):
        verdict = judged_expected(u)[3]
        if verdict is None or i in held:
            continue
        data = marks(u)
        for at in range(5, len(data)):
            for k in range(6):
                c = data[at - k : at]
                grams[verdict, c, data[at]] += 1
                contexts[verdict, c] += 1
                follow[verdict, c].add(data[at])

    def margin(u):
        data, total = marks(u), 0.0
        for at in range(5, len(data)):
            p = dict.fromkeys(("block", "allow"), 1 / 256)
            for v in p:
                for k in range(6):
                    c = data[at - k : at]
                    kinds = max(1, len(follow[v, c]))
                    p[v] = (grams[v, c, data[at]] + kinds * p[v]) / (contexts[v, c] + kinds)
            total += np.log(p["block"] / p["allow"])
        return total / (len(data) - 5)

    m = [margin(u) for u in urls]
    known = [i for i in held if judged_expected(urls[i])[3]]
    y = np.array([1 if judged_expected(urls[i])[3] == "block" else -1 for i in known])
    assert len(set(y)) == 2
    a, c = quality_nbsvm.logistic_fit(np.round([m[i] for i in known], 2), y)
    for i, u in enumerate(urls):
        p = 1 / (1 + np.exp(-np.clip(a * m[i] + c, -30, 30)))
        assert abs(by[i]["p_block"] - p) < 1e-3
        if abs(p - 0.5) > 1e-3:
            assert by[i]["verdict"] == (judged_expected(u)[3] or ("block" if p >= 0.5 else "allow"))


def test_op8_model():
    """One context at a time, with plain dictionaries, gives the same log-likelihood."""
    urls = ["http://a.b/c", "http://a.b/d", "https://x.y/z"]
    grams, contexts, follow = Counter(), Counter(), defaultdict(set)
    tables = [np.zeros((url_lm.ORDER + 1) * url_lm.SPAN, np.float32) for _ in range(3)]
    seen = set()
    for u in urls:
        data = b"\x01" * 5 + u.encode() + b"\x02"
        for at in range(5, len(data)):
            for k in range(6):
                c, x = data[at - k : at], data[at]
                grams[c, x] += 1
                contexts[c] += 1
                follow[c].add(x)
        g, c = url_lm.places(u)
        np.add.at(tables[0], g.ravel(), 1)
        np.add.at(tables[1], c.ravel(), 1)
        seen |= set(zip(g.ravel().tolist(), c.ravel().tolist(), strict=True))
    for _, c in seen:
        tables[2][c] += 1
    model = url_lm.Model(*tables)
    for u in [*urls, "http://q"]:
        data, logs = b"\x01" * 5 + u.encode() + b"\x02", []
        for at in range(5, len(data)):
            p = 1 / 256
            for k in range(6):
                c = data[at - k : at]
                kinds = max(1, len(follow[c]))
                p = (grams[c, data[at]] + kinds * p) / (contexts[c] + kinds)
            logs.append(np.log(p))
        assert abs(model.mean_log(url_lm.places(u)) - np.mean(logs)) < 1e-3


def test_op8_counts_are_exact(spark):
    """More distinct grams than 2^16 an order: scores equal those of plain dictionaries, with rows as weights."""
    urls = [(f"http://h{hashlib.md5(b'%d' % k).hexdigest()}.org/{k}", ("allow", "block", None)[k % 3], 1 + k % 2) for k in range(4000)]
    found = {r["gram"]: r["score"] for r in url_lm.gram_scores(spark.createDataFrame(urls, "url string, verdict string, n long")).collect()}
    assert len(found) > url_lm.SPAN
    grams, contexts, follow = Counter(), Counter(), defaultdict(set)
    for url, verdict, n in urls:
        data = b"\x01" * 5 + url.encode() + b"\x02"
        for at in range(5, len(data)) if verdict else ():
            for k in range(6):
                c, x = data[at - k : at], data[at]
                grams[verdict, c, x] += n
                contexts[verdict, c] += n
                follow[verdict, c].add(x)
    for url, _, _ in urls[:100]:
        data = b"\x01" * 5 + url.encode() + b"\x02"
        for at, gram in enumerate(url_lm.packed_grams(url).tolist(), 5):
            p = dict.fromkeys(("block", "allow"), 1 / 256)
            for v in p:
                for k in range(6):
                    c = data[at - k : at]
                    kinds = max(1, len(follow[v, c]))
                    p[v] = (grams[v, c, data[at]] + kinds * p[v]) / (contexts[v, c] + kinds)
            assert abs(found[gram] / url_lm.SCALE - np.log(p["block"] / p["allow"])) < 1e-6


def test_logistic_fit_weights():
    m, y, n = np.array([-1.0, 0.5, 0.2, 2.0]), np.array([-1, -1, 1, 1]), np.array([30, 5, 7, 40])
    assert np.allclose(quality_nbsvm.logistic_fit(m, y, weight=n.astype(float)), quality_nbsvm.logistic_fit(np.repeat(m, n), np.repeat(y, n)))


def test_op9(spark, odd):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op9_language_id"](spark, sf).collect()
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in found)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in found if r["held_out"]]) > 0.98
    out = langid.identify_languages(odd).collect()
    assert len(out) == len(ODD)
    assert sorted(str(r["doc_id"]) for r in out if r["lang_pred"] == "und")[:3] == ["1", "2", "3"]
    assert all(r["lang_pred"] == "und" for r in langid.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert langid.identify_languages(odd.limit(0)).count() == 0


def test_op9_mixture(spark):
    en, fr = "the cat and the dog went with that thing over there ", "le chat et le chien sont avec la chose que nous avons "
    train = [(k, t, lang, "s") for k, (t, lang) in enumerate([(en, "en"), (fr, "fr")] * 20)]
    docs = spark.createDataFrame([*train, (1000, en * 6 + fr * 3, None, "s"), (1001, en * 9, None, "s")], "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in langid.identify_languages(docs).where("doc_id >= 1000").collect()}
    assert out[1000]["langs"] == "en,fr" and 0.5 < out[1000]["score"] < 0.8
    assert out[1001]["langs"] == "en" and out[1001]["score"] == 1.0


def test_op10(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "All rights reserved.": "Proprietary"}
    found = {r["doc_id"]: r["families"] for r in license_scan.scan_licenses(docs).collect()}
    want = {r["doc_id"]: ",".join(sorted({f for line, f in lines.items() if line in r["text"].split("\n")})) for r in docs.collect()}
    assert found == want and sum(map(bool, want.values())) > 20
    assert license_scan.scan_licenses(odd).where("families = ''").count() == len(ODD)
    assert license_scan.scan_licenses(odd.limit(0)).count() == 0
    near = spark.createDataFrame([(1, "Intro\nCopyright 2001 J. Doe. Licensed under the BSD 3-Clause License for all users"), (2, "The license of the engine was long in the making")], "doc_id long, text string")
    assert {r["doc_id"]: r["families"] for r in license_scan.scan_licenses(near).collect()} == {1: "BSD-3-Clause", 2: ""}


NOTICES = [
    ("This page describes rivers and lakes. This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("GNU General Public License, version 2.", "GPL-2.0"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.", "LGPL-2.1"),
    ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "AGPL-3.0"),
    ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    ("SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL-3.0"),
    ("Licensed under CC BY-NC-ND 4.0", "CC-BY-NC-ND"),
    ("Licensed under CC BY 3.0.", "CC-BY"),
    ("Permission is hereby granted, free of\ncharge, to any person obtaining a copy of this\nsoftware and associated documentation files (the Software)", "MIT"),
    ("Intro line\n\nThis program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General Public License as\npublished by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.\n\nThe end", "GPL-3.0"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:", "BSD"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Licensed under the ISC License", "ISC"),
]


def test_op10_versions_and_wrapped_notices(spark):
    filler = [(1000 + k, f"plain line {k} about rivers\nand more text about the {k} lakes") for k in range(50)]
    docs = spark.createDataFrame([*[(k, t) for k, (t, _) in enumerate(NOTICES)], (900, "Licensed under the Eclipse Public License, version 2.0"), (901, "Licensed under the GNU General Public License, version 1"), *filler], "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    assert {k: found[k]["families"] for k in range(len(NOTICES))} == {k: f for k, (_, f) in enumerate(NOTICES)}
    assert all(found[k]["n_paragraphs"] == 1 for k in range(len(NOTICES)))
    assert [(found[k]["families"], found[k]["n_unknown"]) for k in (900, 901)] == [("", 1), ("", 1)]
    assert not any(found[k]["families"] or found[k]["n_unknown"] for k, _ in filler)


def follows(wanted, words, at, misses, found=0):
    """The definition, by trying the next word that fits at the least distance or leaving a word out."""
    if not wanted:
        return found
    w, rest = wanted[0], wanted[1:]
    for k in range(1 if not found else license_scan.GAP + 1):
        if at + k >= len(words):
            break
        if words[at + k] == w or w == "#" and license_scan.NUMBER.fullmatch(words[at + k]):
            return 0 if set(words[at : at + k]) & license_scan.QUALIFIERS else follows(rest, words, at + k + 1, misses, found + 1)
    return 0 if not misses or license_scan.needs(w) else follows(rest, words, at, misses - 1, found)


def test_op10_confirmation_against_brute_force():
    random = np.random.default_rng(5)
    hits = 0
    for family, texts in license_scan.TEMPLATES.items():
        for text in texts:
            for _ in range(12):
                words = license_scan.words_of(text.replace("#", "4.0"))
                for _ in range(random.integers(0, 4)):
                    at = int(random.integers(0, len(words) + 1))
                    words[at : at + int(random.integers(0, 2))] = [str(random.choice(["x", "the", "nc", "2", "3", "lesser", "version"]))] * int(random.integers(0, 3))
                words = ["under", "the", *words, "end"]
                want = 0.0
                for t in texts:
                    wanted = license_scan.words_of(t)
                    most = int(len(wanted) * 0.1 + 1e-9)
                    want = max([want, *[follows(wanted, words, at, most) / len(wanted) for at in range(len(words))]])
                got = license_scan.template_match(family, words)
                assert got == (want if want >= 0.9 else 0.0)
                hits += got > 0
    assert hits > 100


def test_op10_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, f"line {k} {'long ' * 50}\nsecond {k}") for k in range(40)], "doc_id long, text string")
    assert len(license_scan.sample_paragraphs(docs, 10, 5, 10_000)) == 5
    assert len(license_scan.sample_paragraphs(docs, 10, 100, 10_000)) == 20
    assert sum(map(len, license_scan.sample_paragraphs(docs, 10, 100, 600))) <= 600
    assert license_scan.sample_paragraphs(docs.limit(0), 10, 5, 100) == []


@pytest.mark.parametrize("bits", [6, 24])
def test_split_rows(spark, bits):
    """Every row comes once; what the keys hold is never among the rows that certainly have none."""
    docs = spark.range(500).withColumn("__w", F.lit("x")).withColumn("at", F.lit(1))
    keys = spark.range(0, 500, 7).select(F.xxhash64("id").alias("key"))
    maybe, others = _common.split_rows(docs, F.xxhash64("id"), keys, bits)
    a, b = ([r["id"] for r in df.collect()] for df in (maybe, others))
    assert sorted(a + b) == list(range(500)) and set(range(0, 500, 7)) <= set(a)
    assert maybe.columns == docs.columns and (bits == 6 or len(a) == len(range(0, 500, 7)))


def test_scratch_needs_a_shared_folder():
    """A temporary folder only where the driver and the executors are one process."""

    class Session:
        def __init__(self, master, folder=None):
            self.sparkContext, self.master, self.conf = self, master, {"spark.checkpoint.dir": folder} if folder else {}

        def getConf(self):
            return {}

    assert _common.scratch_folder(Session("local[4]"))
    assert _common.scratch_folder(Session("spark://elsewhere:7077", "s3a://shared/x/")) == "s3a://shared/x"
    for master in ("spark://elsewhere:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            _common.scratch_folder(Session(master))


def test_word_cache():
    cache = _text.WordCache(len, most=2)
    assert [cache[w] for w in (b"a", b"bb", b"ccc", b"a")] == [1, 2, 3, 1] and len(cache) <= 2


def test_words_of_a_batch_are_looked_up_once():
    """batch_numbers gives what numbers gives text by text, and asks for each word once a batch."""
    asked = []

    def f(word):
        asked.append(word)
        return decontam.packer()(word)

    texts = ["a b  a", None, "", " \tÉa 12km\x0bB. a\r\n", "x\x1cy é. ß", "a"]
    got = _text.batch_numbers(texts, _text.WordCache(f, 1))
    assert len(asked) == len(set(asked))
    want = [_text.numbers(t.encode().split() if t else [], _text.WordCache(decontam.packer())) for t in texts]
    assert [g.tolist() for g in got] == [w.tolist() for w in want] and _text.batch_numbers([], _text.WordCache(f)) == []
