"""Near-duplicates by the similarity of their word shingles: SimHash with fingerprints wide enough for it.

Two texts whose sets of five-word shingles have a Jaccard similarity of 0.8 differ in 15 % of the bits of a SimHash, far
more than 64 bits can tell from chance. So fingerprints have 576 bits, in 48 blocks of 12, and close pairs share a block.
Blocks so short are shared by chance as well, the more the larger the corpus is; so a text is filed under each block
together with the least of its shingles in an order of that block's own, which unrelated texts do not share. What meets in
a file is verified by the Hamming distance of the whole fingerprints: files only decide what is compared. A pair at a
similarity of 0.8 meets with a probability of 0.995, one at 0.85 with 0.9999. Files are bounded: one with more than
`crowded` fingerprints is cut again by the other blocks; what does not become one group by that is compared whole, by pairs of parts of the file. A file gives the edges of a spanning forest of its links, never all
pairs, and copies are counted once.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm._common import materialise, same, split_rows, text_udf
from wayfind.llm._text import WordCache, numbers, rolling
from wayfind.llm.components import connected_components
from wayfind.llm.simhash import classes

BLOCKS, WIDTH = 48, 12
BITS = BLOCKS * WIDTH


def shingles(text: str | None, words: int, cache: WordCache) -> np.ndarray:
    """Hashes of the distinct shingles of a text, A-Z in lower case; fewer words are one shingle, no words none."""
    parts = text.encode().lower().split() if text else []
    return np.unique(rolling(numbers(parts, cache), min(words, len(parts)))) if parts else np.empty(0, np.uint64)


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each of BITS bits: how many of the hashes, each stretched to BITS bits, have it set."""
    out = np.zeros(BITS, np.int64)
    step = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, len(hashes), 255):
        x = hashes[k : k + 255, None] + step
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ x >> np.uint64(31)).view(np.uint8), axis=1)
        out += bits.view(np.uint64).sum(0).view(np.uint8)  # eight counters a word; 255 rows can't overflow one
    return out


def wide_fingerprint(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The fingerprint and its keys (int64, one a block); zeros, and keys of the zeros alone, without a shingle."""
    bits = 2 * votes(hashes) > len(hashes)
    value = (bits.reshape(BLOCKS, WIDTH) @ (1 << np.arange(WIDTH))).astype(np.uint64)
    number = np.arange(1, BLOCKS + 1, dtype=np.uint64)
    odd = number * np.uint64(0xBF58476D1CE4E5B8) | np.uint64(1)
    least = np.zeros(BLOCKS, np.uint64) if not len(hashes) else np.array([(hashes * m).min() for m in odd])
    keys = (least ^ value * np.uint64(0x9E3779B97F4A7C15)) * odd + number
    return np.packbits(bits).tobytes(), (keys ^ keys >> np.uint64(29)).view(np.int64)


def most_bits(similarity: float, spread: float = 2.0) -> int:
    """The bits in which a pair of that Jaccard similarity differs, and `spread` standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(BITS * p + spread * math.sqrt(BITS * p * (1 - p)))


def forest(ids: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links. fps: (n, BITS / 64). Each is compared with those not yet reached."""
    edges, left = [], np.arange(len(ids))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]).sum(1) <= distance
            if near.any():
                found, left = left[near], left[~near]
                edges += [(int(ids[x]), int(ids[y])) for y in found]
                queue += found.tolist()
    return edges


def _links(files: DataFrame, distance: int) -> DataFrame:
    """files: key, id, fp, rows of bounded files. a, b."""

    def make():
        def f(rows: list) -> list:
            out = []
            for members in rows:
                fps = np.frombuffer(b"".join(m["fp"] for m in members), np.uint64).reshape(len(members), -1)
                out.append([{"a": a, "b": b} for a, b in forest(np.array([m["id"] for m in members], np.int64), fps, distance)])
            return out

        return f

    gathered = files.groupBy("key").agg(F.collect_list(F.struct("id", "fp")).alias("m")).where(F.size("m") > 1)
    return gathered.select(F.explode(text_udf(make, "array<struct<a long, b long>>")("m")).alias("e")).select("e.a", "e.b")


def link_wide(nodes: DataFrame, distance: int, crowded: int = 16_384) -> DataFrame:
    """nodes: id (distinct), fp, keys. Edges a, b between ids that meet in a file and differ in at most `distance` bits."""
    filed = nodes.select("id", F.explode("keys").alias("key"))
    shared = materialise(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "wide-files")
    members = split_rows(filed, F.col("key"), shared)[0].join(shared.hint("merge"), "key")
    fps = nodes.select("id", "fp")
    edges = _links(members.where(F.col("n") <= crowded).select("key", "id").join(fps, "id"), distance)
    if shared.where(F.col("n") > crowded).isEmpty():
        return edges
    dense = materialise(members.where(F.col("n") > crowded).select("id", F.col("key").alias("file"), "n"), "wide-crowded")
    finer = dense.join(nodes, "id").select("id", "file", F.explode("keys").alias("k")).where("k <> file").select(F.xxhash64("file", "k").alias("key"), "id")
    again = finer.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, crowded)).select("key")
    edges = materialise(edges.union(_links(finer.join(again, "key").join(fps, "id"), distance)), "wide-links")
    # Pairs within a group need no link of their own; files of several groups are compared whole.
    parts = materialise(connected_components(edges), "wide-groups")
    dense = materialise(dense.join(parts.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")), "wide-crowded")
    loose = dense.groupBy("file").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("file")
    rest = materialise(dense.join(loose.hint("merge"), "file"), "wide-loose")
    if rest.isEmpty():
        return edges
    count = F.ceil(F.col("n") / max(1, crowded // 2)).cast("int")
    rest = rest.select("id", "file", count.alias("parts")).withColumn("p", F.pmod(F.xxhash64("id", "file"), "parts"))
    rest = rest.select("id", "file", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    pairs = rest.select(F.xxhash64("file", F.least("p", "q"), F.greatest("p", "q")).alias("key"), "id")
    return edges.union(_links(pairs.join(fps, "id"), distance))


def mark(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, t (hash of the text), fp (long: the number of the node), bits, keys."""

    def make():
        cache = WordCache(lambda word: xxhash.xxh64_intdigest(word, 11))

        def f(texts: list) -> dict:
            made = [wide_fingerprint(shingles(t, words, cache)) for t in texts]
            return {"bits": [b for b, _ in made], "keys": [k for _, k in made]}

        return f

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), text_udf(make, "struct<bits: binary, keys: array<long>>")(F.col(text_col)).alias("m"))
    return rows.select("doc_id", "t", F.xxhash64("m.bits", "m.keys").alias("fp"), "m.bits", "m.keys")


def similar_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, crowded: int = 16_384) -> tuple[DataFrame, DataFrame]:
    """Tables of (doc_id, t, fp) by row and (fp, root, component_id) by fingerprint."""
    marked = materialise(mark(docs, id_col, text_col, words), "wide-fingerprints")
    nodes = materialise(marked.groupBy(F.col("fp").alias("id"), F.col("bits").alias("fp"), "keys").agg(F.count("*").alias("n")).drop("n"), "wide-nodes")
    return marked.select("doc_id", "t", "fp"), classes(marked, link_wide(nodes, most_bits(similarity), crowded))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, crowded: int = 16_384) -> DataFrame:
    """docs with one row of each group of near copies: that of the least id (no id: last), then of the least hash of the text.

    Null and empty texts are copies of each other. Repeated rows are copies. Empty tables give no rows; columns stay as they were.
    """
    marked, found = similar_duplicates(docs, id_col, text_col, words, similarity, crowded)
    rows = materialise(marked.groupBy("doc_id", "t", "fp").agg(F.count("*").alias("n")).join(found, "fp"), "distinct-rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("x")).select("root", "x.doc_id", "x.t")
    first = materialise(first, "first").withColumnsRenamed({"doc_id": "__d", "t": "__t"})
    judged = rows.join(first, "root").withColumn("stays", same(F.col("doc_id"), F.col("__d")) & (F.col("t") == F.col("__t")))
    goes = materialise(judged.where(~F.col("stays")).select(F.col("doc_id").alias("__d"), F.col("t").alias("__t")), "copies")
    concerned, kept = split_rows(docs, F.xxhash64(id_col), goes.select(F.xxhash64("__d").alias("key")))
    kept = kept.union(concerned.join(goes.hint("merge"), same(F.col(id_col), F.col("__d")) & (F.xxhash64(text_col) == F.col("__t")), "left_anti"))
    return kept if judged.where("stays and n > 1").isEmpty() else kept.dropDuplicates([id_col, text_col])
