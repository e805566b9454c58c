"""Best-fit packing with conflicts.

Documents are dealt by a hash of what they are into groups of a bounded number of rows, and each group is packed by one
Python call. A bin carries the room left and two bitmaps: sources and duplicate clusters. A document goes into the
tightest bin that has room and no conflict: bins are kept in order of room, and the search walks up from the first that
fits. Bins that a group could not fill are opened again and their documents dealt into fewer groups, round after round,
until one group has seen all that is left or a round no longer helps. No group is larger because a source or a cluster is.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm._common import materialise


def pack(items: list[tuple[int, object, object]], capacity: int, per_source: int) -> list[tuple[int, int, int, int, int]]:
    """items: (tokens, source, cluster). Returns (item, piece, start, tokens, bin, offset) rows, largest remainders first.

    What exceeds the capacity is cut into full pieces, each a bin of its own; the rest is packed. A bin takes at most
    per_source items of a source and one of a cluster; None conflicts with nothing. Items without tokens get no bin.
    """
    out, rests, n_bins = [], [], 0
    for k, (tokens, _, _) in enumerate(items):
        full, rest = divmod(max(tokens, 0), capacity)
        for piece in range(full):
            out.append((k, piece, piece * capacity, capacity, n_bins, 0))
            n_bins += 1
        if rest:
            rests.append((-rest, k, full))
        elif not full:
            out.append((k, 0, 0, 0, -1, 0))
    places: dict = {}
    room: list[tuple[int, int]] = []  # (left, bin), in order
    maps: dict[int, list[int]] = {}  # bin: sources (per_source bits each), clusters
    whole = (1 << per_source) - 1
    for negative, k, piece in sorted(rests):
        size, (_, source, cluster) = -negative, items[k]
        s = None if source is None else places.setdefault(("s", source), len(places)) * per_source
        c = 0 if cluster is None else 1 << places.setdefault(("c", cluster), len(places))
        at = bisect_left(room, (size, -1))
        while at < len(room):
            sources, clusters = maps[room[at][1]]
            if not clusters & c and (s is None or sources >> s & whole != whole):
                break
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, n_bins
            maps[b] = [0, 0]
            n_bins += 1
        if s is not None:
            taken = maps[b][0] >> s & whole
            maps[b][0] |= (taken + 1) << s  # the lowest free bit: taken is 0, 1, 3, 7...
        maps[b][1] |= c
        out.append((k, piece, piece * capacity, size, b, capacity - left))
        if left > size:
            insort(room, (left - size, b))
        else:
            del maps[b]
    return out


OUT = "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_offset long"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _round(items: DataFrame, number: int, groups: int, capacity: int, per_source: int, full: float) -> DataFrame:
    """items: doc_id (0 for null), no_id, source, cluster, piece, start, n_tokens, copy. OUT, what a further round needs, and loose: whether the bin is to be opened again."""
    dealt = items.withColumn("dealt", F.pmod(F.xxhash64(F.lit(number), "doc_id", "no_id", "source", "cluster", "piece", "n_tokens", "copy"), F.lit(groups)))
    order = ["n_tokens", "no_id", "doc_id", "cluster", "source", "copy"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, ascending=[False, True, True, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        sources = [None if s is None or s != s else s for s in rows["source"]]
        found = pack(list(zip(rows["n_tokens"].tolist(), sources, rows["cluster"].tolist(), strict=True)), capacity, per_source)
        out = pd.DataFrame(found, columns=["item", "piece", "start", "n_tokens", "bin", "bin_offset"])
        at = out["item"].to_numpy(dtype="int64")
        fill = out.groupby("bin")["n_tokens"].transform("sum")
        pick = lambda c: rows[c].to_numpy()[at]
        return pd.DataFrame(
            {
                "doc_id": pick("doc_id"),
                "piece": (out["piece"] + pick("piece")).astype("int32"),
                "start": out["start"] + pick("start"),
                "n_tokens": out["n_tokens"],
                "bin_id": (out["bin"] + (number << 56) + (int(key[0]) << 32)).astype("Int64").where(out["bin"] >= 0),
                "bin_offset": out["bin_offset"],
                "no_id": pick("no_id"),
                "source": pick("source"),
                "cluster": pick("cluster"),
                "copy": pick("copy"),
                "loose": (out["bin"] >= 0) & (fill < full * capacity),
            }
        )

    return dealt.groupBy("dealt").applyInPandas(run, f"{OUT}, no_id boolean, source string, cluster long, copy long, loose boolean")


def pack_documents(docs: DataFrame, capacity: int = 2048, per_source: int = 4, group_rows: int = 8192, full: float = 0.95) -> DataFrame:
    """doc_id, piece (int), start, n_tokens (long), bin_id (long; null without tokens), bin_offset (long) for each piece of each row.

    Tokens are words [^\\x20\\x09-\\x0D]+. A cluster is the text in lower case with spaces squeezed; empty texts and null
    sources conflict with nothing. Repeated rows are documents of their own and never share a bin. The bins depend on the
    rows alone, not on how they are partitioned. A group has about group_rows rows; bins filled to less than `full` are
    opened again as long as there are several groups and a round leaves at most three quarters of its rows in such bins.
    Empty tables give no rows.
    """
    squeezed = F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " ")
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(squeezed).alias("cluster"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"))
    kinds = materialise(narrow.groupBy("doc_id", "source", "cluster", "n_tokens").agg(F.count("*").alias("n")), "packing")
    items = kinds.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "source", "cluster", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).withColumns({"piece": F.lit(0), "start": F.lit(0).cast("long")})
    rows, out, number = kinds.agg(F.sum("n")).first()[0] or 0, None, 0
    while True:
        groups = max(1, -(-rows // group_rows))
        packed = materialise(_round(items, number, groups, capacity, per_source, full), f"packed-{number}")
        loose = packed.where("loose").count() if groups > 1 else 0
        again = 0 < loose <= 0.75 * rows
        kept = (packed.where("not loose") if again else packed).select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), *COLUMNS[1:])
        out = kept if out is None else out.union(kept)
        if not again:
            return out
        items, rows, number = packed.where("loose").select("doc_id", "no_id", "source", "cluster", "piece", "start", "n_tokens", "copy"), loose, number + 1
