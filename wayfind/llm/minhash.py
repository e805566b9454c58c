"""MinHash near-duplicates by fast similarity sketching.

A set of word shingles is sketched in rounds. In each of the first T rounds every element is hashed into one of the T
bins, with a value that is larger the later the round is, and a bin keeps its least value; soon all bins are filled, and later
rounds change nothing. Round T + b hashes all elements into bin b, so that after 2 T rounds no bin is empty even for a set of one
element. That gives T coordinates which agree with a probability of the Jaccard similarity and concentrate like those of T
independent permutations, in O(n + T log T) steps instead of O(n T).

Sets that agree on all six coordinates of one of 42 bands share a file; a pair at 0.8 shares none with a probability of three in a
million. What is in a file is then verified on the whole sets, in tasks of bounded size:

1. Each set is compared with the least set of the file it shares most often, then of the other files, unless the two
   are in one group already. So a group of near copies costs about one comparison a member.
2. Files whose members are not known to be in one group are gone through completely, in blocks: each member is compared with
   those of other groups. Large files are cut into blocks, and every pair of blocks meets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm._common import materialise, same, split_rows, text_udf
from wayfind.llm._text import WordCache
from wayfind.llm.components import connected_components
from wayfind.llm.simhash_wide import shingles

BANDS, ROWS = 42, 6
BINS = BANDS * ROWS
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_SEEDS = _mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = _mix(np.arange(7, BINS + 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketch(elements: np.ndarray, step: int = 1536) -> np.ndarray:
    """BINS values (uint64: the round above, a hash below) of a set that is not empty. About `step` elements are placed at a time; the result doesn't depend on it."""
    bins, done = np.full(BINS, np.iinfo(np.uint64).max, np.uint64), 0
    while done < BINS and (bins >> np.uint64(32) > done).any():
        rounds = np.arange(done, min(BINS, done + max(1, step // len(elements))))
        x = _mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        place = (x >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)
        np.minimum.at(bins, place.ravel().astype(np.int64), ((rounds.astype(np.uint64) << np.uint64(32))[:, None] | x & _LOW).ravel())
        done = int(rounds[-1]) + 1
    rest = np.flatnonzero(bins == np.iinfo(np.uint64).max)  # only sets of a few elements leave bins empty
    if len(rest):
        bins[rest] = (rest + BINS).astype(np.uint64) << np.uint64(32) | (_mix(elements[None, :] ^ _SEEDS[BINS + rest][:, None]) & _LOW).min(1)
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    """One key (int64) a band, of all its coordinates and its number."""
    return _mix((_mix(bins) * _ODD).reshape(BANDS, ROWS).sum(1) + _SEEDS[:BANDS]).view(np.int64)


def _marks(words: int):
    """Column function: the size of a text's set, two hashes of it, and its keys; without a word 0 and no keys."""

    def make():
        cache = WordCache(lambda word: xxhash.xxh64_intdigest(word, 13))

        def f(texts: list) -> dict:
            sets = [shingles(t, words, cache) for t in texts]
            keys = [band_keys(sketch(s)) if len(s) else np.empty(0, np.int64) for s in sets]
            hashes = lambda seed: [xxhash.xxh64_intdigest(s.tobytes(), seed) - (1 << 63) for s in sets]
            return {"n": [len(s) for s in sets], "k1": hashes(1), "k2": hashes(2), "keys": keys}

        return f

    return text_udf(make, "struct<n: long, k1: long, k2: long, keys: array<long>>")


def _whole_sets(words: int):
    def make():
        cache = WordCache(lambda word: xxhash.xxh64_intdigest(word, 13))
        return lambda texts: [shingles(t, words, cache).tobytes() for t in texts]

    return text_udf(make, "binary")


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the others shares with one set; all are sorted and not empty."""
    flat = np.concatenate(others)
    found = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(found, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def links(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the others have a Jaccard similarity of that many hundredths, or more."""
    sizes = np.array([len(x) for x in others])
    shared = overlaps(one, others)
    return 100 * shared >= percent * (sizes + len(one) - shared)


def group_links(ids: list[int], groups: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join different groups, until no pair of two groups is left untested. Members of small groups come first."""
    _, root, count = np.unique(np.array(groups), return_inverse=True, return_counts=True)
    order = np.lexsort((np.array(ids), root, count[root]))
    root, sizes, out = root[order], np.array([len(sets[k]) for k in order]), []
    for x in range(len(order) - 1):
        fits = (root[x + 1 :] != root[x]) & (100 * np.minimum(sizes[x + 1 :], sizes[x]) >= percent * np.maximum(sizes[x + 1 :], sizes[x]))
        rest = np.flatnonzero(fits) + x + 1
        if len(rest):
            for y in rest[links(sets[order[x]], [sets[order[k]] for k in rest], percent)]:
                if root[y] != root[x]:
                    out.append((ids[order[x]], ids[order[y]]))
                    root[root == root[y]] = root[x]
    return out


def _sets(values: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint64) for v in values]


def _parts(rows: Column, elements: Column, most_rows: int, most_elements: int) -> Column:
    """Into how many parts a group is dealt, so that each has about so many rows and elements at most."""
    return F.greatest(F.ceil(rows / most_rows), F.ceil(elements / most_elements)).cast("int")


def verify_stars(pairs: DataFrame, sets: DataFrame, percent: int, most_rows: int, most_elements: int) -> DataFrame:
    """pairs: lead, id, n (elements of id). sets: id, s. Those that link, as a (the lead), b."""
    parts = pairs.groupBy("lead").agg(_parts(F.count("*"), F.sum("n"), most_rows, most_elements).alias("parts"))
    dealt = pairs.join(parts.hint("merge"), "lead").select("lead", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id", F.lit(False).alias("leads"))
    leads = dealt.select("lead", "part", F.col("lead").alias("id"), F.lit(True).alias("leads")).distinct()

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        lead, others = rows[rows["leads"]], rows[~rows["leads"]]
        found = others["id"].to_numpy()[links(_sets(lead["s"])[0], _sets(others["s"]), percent)] if len(lead) and len(others) else []
        return pd.DataFrame({"a": rows["lead"].iat[0], "b": found}, columns=["a", "b"])

    return dealt.unionByName(leads).join(sets.hint("merge"), "id").groupBy("lead", "part").applyInPandas(compare, "a long, b long")


def verify_files(files: DataFrame, sets: DataFrame, percent: int, most_rows: int, most_elements: int) -> DataFrame:
    """files: key, id, n, group. sets: id, s. Links a, b between groups of a file, enough that no two members of different groups are left untested."""
    mixed = files.groupBy("key").agg(_parts(F.count("*"), F.sum("n"), most_rows, most_elements).alias("parts"), F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 <> g1")
    dealt = files.join(mixed.select("key", "parts").hint("merge"), "key").select("key", "id", "group", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("own"), F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    met = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "group")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id")
        return pd.DataFrame(group_links(rows["id"].tolist(), rows["group"].tolist(), _sets(rows["s"]), percent), columns=["a", "b"], dtype="int64")

    return met.join(sets.hint("merge"), "id").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def link_sets(docs: DataFrame, marked: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, percent: int, most_rows: int, most_elements: int) -> DataFrame:
    """node, root: the groups of all links between different sets."""
    filed = nodes.select("id", "n", F.explode("keys").alias("key"))
    shared = materialise(filed.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("lead")).where("members > 1"), "minhash-files")
    members = materialise(split_rows(filed, F.col("key"), shared)[0].join(shared.hint("merge"), "key"), "minhash-members")
    stars = materialise(members.where("id <> lead").groupBy("lead", "id", "n").agg(F.count("*").alias("bands")), "minhash-stars")

    need = stars.select("id").union(stars.select("lead")).distinct()
    wanted = materialise(marked.join(need.hint("merge"), marked["r"] == need["id"]).select("doc_id", "t", "id"), "minhash-wanted")
    key = F.xxhash64(id_col, F.xxhash64(text_col))
    concerned = split_rows(docs.select(id_col, text_col), key, wanted.select(F.xxhash64("doc_id", "t").alias("key")))[0]
    texts = concerned.join(wanted.hint("merge"), same(concerned[id_col], wanted["doc_id"]) & (F.xxhash64(concerned[text_col]) == wanted["t"])).select("id", concerned[text_col].alias("text"))
    sets = texts.select("id", _whole_sets(words)("text").alias("s"))
    if not marked.groupBy("doc_id", "t").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty():
        sets = sets.dropDuplicates(["id"])
    sets = materialise(sets, "minhash-sets")

    bounds = (percent, most_rows, most_elements)
    best = stars.groupBy("id", "n").agg(F.max(F.struct("bands", -F.col("lead")))["col2"].alias("lead")).select("id", "n", (-F.col("lead")).alias("lead"))
    first = materialise(verify_stars(best, sets, *bounds), "minhash-links-1")
    # Two steps along the links of the first round: what has one label is in one group.
    label = first.select(F.col("b").alias("id"), F.col("a").alias("label"))
    label = label.join(label.toDF("label", "top").hint("merge"), "label", "left")
    label = materialise(label.select("id", F.coalesce("top", "label").alias("label")), "minhash-labels")
    labelled = lambda df, c, new: df.join(label.toDF(c, new).hint("merge"), c, "left").withColumn(new, F.coalesce(new, c))
    rest = labelled(labelled(stars, "id", "own"), "lead", "other").where("own <> other").select("lead", "id", "n")
    second = materialise(verify_stars(rest, sets, *bounds), "minhash-links-2")
    met = labelled(labelled(second, "a", "la"), "b", "lb").select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("hook"))
    hooks = materialise(met.groupBy("label").agg(F.min("hook").alias("hook")), "minhash-hooks")

    files = labelled(members.where("members > 2").select("key", "id", "n"), "id", "label").join(hooks.hint("merge"), "label", "left")
    third = materialise(verify_files(files.select("key", "id", "n", F.coalesce("hook", "label").alias("group")), sets, *bounds), "minhash-links-3")
    return materialise(connected_components(first.union(second).union(third)), "minhash-groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 80, most_rows: int = 1024, most_elements: int = 1 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (distinct), component_id (least id that its links reach, its own included), kept (the row has that id).

    A set holds the distinct shingles of `words` words, A-Z in lower case; fewer words are one shingle. Sets link at a Jaccard
    similarity of `percent` hundredths, confirmed on the whole sets. Texts without a word, null texts included, have no
    shingle and link with nothing, not even with each other. Rows without an id are linked too but name no component; alone they
    have a null component_id and are kept. Repeated rows come back each. Tasks have about most_rows sets and most_elements shingles at
    most, or one set; results don't depend on either. Empty tables give no rows.
    """
    marks = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), _marks(words)(F.col(text_col)).alias("m"))
    marked = materialise(marks.select("doc_id", "t", "m.n", "m.k1", "m.k2", "m.keys", F.monotonically_increasing_id().alias("r")), "minhash")
    nodes = marked.where("n > 0").groupBy("k1", "k2", "n", "keys").agg(F.min("r").alias("id"), F.min("doc_id").alias("least"))
    nodes = materialise(nodes, "minhash-sets-of")
    groups = link_sets(docs, marked.drop("keys"), nodes, id_col, text_col, words, percent, most_rows, most_elements)
    rooted = nodes.select("k1", "k2", "id", "least").join(groups.hint("merge"), nodes["id"] == groups["node"], "left")
    rooted = materialise(rooted.select("k1", "k2", "least", F.coalesce("root", "id").alias("root")), "minhash-rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(named.hint("merge"), "root").select("k1", "k2", "component_id"), "minhash-named")
    rows = marked.where("n > 0").select("doc_id", "n", "k1", "k2").join(named.hint("merge"), ["k1", "k2"])
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(marked.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", same(F.col("doc_id"), F.col("component_id")))
