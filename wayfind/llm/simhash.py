"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into six blocks. Two that differ in at most three bits agree on at least three whole blocks, so each
distinct fingerprint is filed under the 20 triples of its blocks (32 bits each) and only fingerprints of one file are
compared. Files are bounded: one with more than `crowded` fingerprints is cut again by the same principle on its other
32 bits; then 48 bits are fixed and at most 65,536 distinct fingerprints remain. A file gives the edges of a spanning
forest of its links, never all pairs, and copies of a fingerprint are counted once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.llm._common import materialise, text_udf
from wayfind.llm.components import connected_components

BITS = 64


def text_fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over the XXH64 values (seed 42) of word shingles, repeats included. Texts without a word: 0."""
    parts = text.encode().lower().split() if text else []  # of bytes: only A-Z changes, only ASCII space separates
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), 42)]
    else:
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    set_bits = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[k : k + (1 << 16)], "<u8")
        set_bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed long."""
    return text_udf(lambda: lambda texts: [int(np.uint64(text_fingerprint(t, words)).astype(np.int64)) for t in texts], "long")(text)


def block_masks(blocks: int, keep: int, bits: list[int]) -> list[int]:
    """Masks over the given bit places, one for each choice of `keep` blocks out of `blocks` nearly equal ones."""
    cuts = [len(bits) * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, keep)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def spanning_links(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints. Each is compared with those not yet reached."""
    if len(members) == 2:
        return [(int(members[0]), int(members[1]))] if np.bitwise_count(members[0] ^ members[1]) <= distance else []
    edges, left = [], members
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found, left = left[near], left[~near]
                edges += [(int(x), int(y)) for y in found]
                queue += list(found)
    return edges


def _links(groups: DataFrame, distance: int) -> DataFrame:
    """groups: fps array<long>. Returns a, b."""

    def make():
        def f(rows: list) -> list:
            return [[{"a": int(np.uint64(a).astype(np.int64)), "b": int(np.uint64(b).astype(np.int64))} for a, b in spanning_links(np.asarray(fps, np.int64).view(np.uint64), distance)] for fps in rows]

        return f

    return groups.select(F.explode(text_udf(make, "array<struct<a long, b long>>")("fps")).alias("e")).select("e.a", "e.b")


def link_fingerprints(fps: DataFrame, distance: int = 3, blocks: int = 6, crowded: int = 4096) -> DataFrame:
    """fps: fp (long, distinct). Returns edges a, b whose components are those of all pairs within the distance."""
    keep = blocks - distance
    masks = block_masks(blocks, keep, list(range(BITS)))
    filed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for k, m in enumerate(masks)])).alias("x"))
    filed = filed.select("fp", F.col("x.k").alias("k"), F.xxhash64("x.k", "x.v").alias("key"))
    shared = materialise(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "blocks")
    members = filed.join(shared, "key")
    small = members.where(F.col("n") <= crowded).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    edges = _links(small.select("fps"), distance)
    if shared.where(F.col("n") > crowded).isEmpty():
        return edges
    finer = []
    for k, m in enumerate(masks):
        rest = [b for b in range(BITS) if not m >> b & 1]
        finer.append(F.array(*[F.xxhash64(F.lit(k), F.lit(j), F.col("fp").bitwiseAND(F.lit(_signed(m | s)))) for j, s in enumerate(block_masks(blocks, keep, rest))]))
    per_file = F.element_at(F.array(*finer), F.col("k") + 1)
    dense = members.where(F.col("n") > crowded).select("fp", F.explode(per_file).alias("key"))
    dense = dense.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return edges.union(_links(dense.select("fps"), distance))


def classes(marked: DataFrame, edges: DataFrame) -> DataFrame:
    """marked: doc_id, fp. fp, root, component_id of each fingerprint: the least node and the least id that the edges reach."""
    kinds = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "kinds")
    parts = materialise(connected_components(edges), "parts")
    rooted = kinds.join(parts, kinds["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    named = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    return materialise(rooted.join(named, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), component_id: the least id that its links reach, its own included.

    Fingerprints link at `distance` differing bits or fewer; null and empty texts have fingerprint 0 and link like any
    other. Rows without an id are linked too but name no component; one of them alone has a null component_id.
    Repeated rows come back each. Empty tables give no rows.
    """
    marked = materialise(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")), "fingerprints")
    edges = link_fingerprints(marked.select("fp").distinct(), distance)
    return marked.join(classes(marked, edges), "fp").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
