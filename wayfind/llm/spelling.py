"""Spelling variants by a positional q-gram inverted index.

Words are padded and cut into bigrams with their positions. One edit destroys two bigrams at most and moves the others by one place,
so words within one edit share all but two of the longer one's bigrams (the count filter), at positions that differ by
one at most, and differ in length by one at most. With the bigrams of all words ordered from rare to common, two such words
also share four of the first six of each; so the index is dealt over the cluster by what may be shared: a word
is filed under each choice of four of its six rarest bigrams, and words that can't be near hardly meet.

In a file, the bigrams become posting lists of (word, position), in order of length. A word's lists are cut to the words that
are long enough; the three shortest are heap-merged (who is on none of them can't reach the bound), whoever turns up is
looked up in the longer ones until the bound is reached or out of reach, and then verified.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, groupby

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm._common import materialise, split_rows

Q, SHARED = 2, 4
PREFIX = Q + SHARED  # one edit destroys Q bigrams: of so many, SHARED are left
_ID = 1 << 32

#: Letters [A-Za-z] in lower case and À-ÿ as they are, all else a space: of Latin-1, where a byte is a code point.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str | None) -> Counter:
    """The runs of letters with their numbers, in Latin-1; what lies beyond it separates runs, like any other sign."""
    return Counter(text.encode("latin-1", "replace").translate(_KEEP).split()) if text else Counter()


def misspelt(run: bytes, crc: int, modulus: int) -> bytes:
    """The run without one code point, if modulus divides its checksum; crc: that of what stands before the run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), crc)
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_count: int, modulus: int, most: int = 200_000) -> DataFrame:
    """word, n (long). A task sends the counts of its documents on whenever it holds `most` words, so that its memory is bounded."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})

        for rows in batches:
            for doc_id, text in zip(rows["id"].tolist(), rows["text"].tolist(), strict=True):
                crc = zlib.crc32(f"{doc_id or ''}:".encode())
                for run, n in runs_of(text).items():
                    if len(run) >= min_chars and len(word := misspelt(run, crc, modulus)) >= min_chars:
                        held[word] += n
                if len(held) >= most:
                    yield out()
                    held.clear()
        if held:
            yield out()

    counts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def grams(word: str) -> list[str]:
    padded = f"\0{word}\0"
    return [padded[k : k + Q] for k in range(len(word) + Q - 1)]


def prefix(word: str, rank: dict[str, int]) -> list[str]:
    """The PREFIX rarest of a word's bigrams, rarest first; one that occurs twice counts twice."""
    return sorted(grams(word), key=rank.__getitem__)[:PREFIX]


def first_shared(a: list[str], b: list[str], rank: dict[str, int]) -> str:
    """The first SHARED bigrams that two prefixes have in common, put together; one that both have twice counts twice."""
    out, i, j = [], 0, 0
    while len(out) < SHARED and i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif rank[a[i]] < rank[b[j]]:
            i += 1
        else:
            j += 1
    return "".join(out)


def file_keys(word: str, rank: dict[str, int]) -> list[int]:
    found = {"".join(c) for c in combinations(prefix(word, rank), SHARED)}
    return [xxhash.xxh64_intdigest(c.encode()) - (1 << 63) for c in sorted(found)]


def near(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def near_pairs(words: list[str], side: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of distinct words within one edit, by merging posting lists. side: only pairs of different sides."""
    order = sorted(range(len(words)), key=lambda k: (len(words[k]), words[k]))
    postings: dict[str, list[int]] = {}  # bigram: word * _ID + position, words by length
    first: dict[int, int] = {}  # the first place with that length
    for at, k in enumerate(order):
        word = words[k]
        own, long = grams(word), len(word)
        from_place = first.get(long - 1, first.setdefault(long, at))
        begin, bound = from_place * _ID, max(1, long - 1)  # long + Q - 1 bigrams, but for Q
        lists = [(p, pos) for pos, g in enumerate(own) if (p := postings.get(g)) and p[-1] >= begin] if from_place < at else []
        # With fewer lists no word reaches the bound; a word that does is on one of any len(lists) - bound + 1 of them.
        if len(lists) >= bound:
            lists = sorted(((p, bisect_left(p, begin), pos) for p, pos in lists), key=lambda x: len(x[0]) - x[1])
            merged = len(lists) - bound + 1
            short = [[e // _ID for e in p[lo:] if -1 <= e % _ID - pos <= 1] for p, lo, pos in lists[:merged]]
            for other, seen in groupby(heapq.merge(*short)):
                shared, left = len(list(seen)), bound - 1
                for p, lo, pos in lists[merged:]:
                    if shared >= bound or shared + left < bound:
                        break
                    left -= 1
                    x = bisect_left(p, other * _ID + max(0, pos - 1), lo)
                    shared += x < len(p) and p[x] <= other * _ID + pos + 1
                if shared >= bound and (side is None or side[k] != side[order[other]]) and near(word, words[order[other]]):
                    yield k, order[other]
        if at + 1 < len(order) and len(words[order[at + 1]]) <= long + 1:  # else no later word can be near
            for pos, g in enumerate(own):
                if g in postings:
                    postings[g].append(at * _ID + pos)
                else:
                    postings[g] = [at * _ID + pos]


def link_words(words: DataFrame, crowded: int = 4096) -> DataFrame:
    """words: word, n. near: word, other, m (the n of other), both ways, once each. Files of more than `crowded` words are cut into blocks, and every pair of blocks meets; the result does not depend on it."""

    def bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for rows in batches:
            for word in rows["word"]:
                held.update(set(grams(word)))
        if held:
            yield pd.DataFrame({"gram": list(held), "n": list(held.values())})

    # At most 91 * 91 bigrams: 26 letters, 64 of Latin-1 and the pad.
    counted = words.mapInPandas(bigrams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    frequent = sorted((r["n"], r["gram"]) for r in counted.collect())
    rank = {g: k for k, (_, g) in enumerate(frequent)}

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(keys=[file_keys(w, rank) for w in rows["word"]])

    filed = materialise(words.mapInPandas(keys, "word string, n long, keys array<long>"), "spelling-keys").select("word", "n", F.explode("keys").alias("key"))
    shared = materialise(filed.groupBy("key").agg(F.count("*").alias("words")).where("words > 1"), "spelling-files")

    def compare(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in files:
            out = []
            for key, words, counts, side in zip(rows["key"].tolist(), rows["words"], rows["counts"], rows["side"], strict=True):
                words, side = list(words), None if side is None else list(side)
                for i, j in near_pairs(words, side):
                    # A pair that shares several files is told in one of them: that of the first bigrams that both have.
                    if xxhash.xxh64_intdigest(first_shared(prefix(words[i], rank), prefix(words[j], rank), rank).encode()) - (1 << 63) == key:
                        out += [(words[i], words[j], counts[j]), (words[j], words[i], counts[i])]
            if out:
                yield pd.DataFrame(out, columns=["word", "other", "m"])

    made = "word string, other string, m long"
    large = shared.where(F.col("words") > crowded)
    some = filed if large.isEmpty() else split_rows(filed, F.col("key"), large)[1].unionByName(split_rows(filed, F.col("key"), large)[0].join(large.select("key"), "key", "left_anti"))
    files = some.groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("x")).where(F.size("x") > 1)
    files = files.select("key", F.col("x.word").alias("words"), F.col("x.n").alias("counts"), F.lit(None).cast("array<int>").alias("side"))
    pairs = files.mapInPandas(compare, made)
    if not large.isEmpty():
        dealt = split_rows(filed, F.col("key"), large)[0].join(large.hint("merge"), "key")
        dealt = dealt.withColumn("blocks", F.ceil(F.col("words") / crowded).cast("int")).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
        dealt = dealt.select("key", "word", "n", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        blocks = dealt.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("word", "n", "own")).alias("x"))
        blocks = blocks.select("key", F.col("x.word").alias("words"), F.col("x.n").alias("counts"), F.when(F.col("i") != F.col("j"), F.col("x.own")).alias("side"))
        pairs = pairs.unionByName(blocks.mapInPandas(compare, made))
    return pairs


def follow(words: DataFrame) -> DataFrame:
    """words: word, form, ... with root: the word at the end of its forms. A step at least doubles the count, so chains are short, and each round doubles what is known of them."""
    roots = materialise(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        nearer = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("further")).hint("merge"), "root", "left")
        nearer = materialise(nearer.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        roots = nearer.select("word", "root")
        if nearer.where("moved").isEmpty():
            return words.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3, modulus: int = 97, factor: int = 2, crowded: int = 4096) -> DataFrame:
    """One row per word: word, form, root (string), n, n_near, form_n (long).

    Words are runs of [A-Za-z\\u00C0-\\u00FF], A-Z in lower case, of min_chars code points and min_count occurrences at least; where
    modulus divides the checksum of `<id>:<run>`, a run loses one code point. A null id counts as an empty one; null texts have no
    runs; repeated rows count each. Of the words one edit away, the most frequent (ties: the least in code-point order) is the
    form, if it is `factor` (2 at least) times as frequent. Empty tables give no rows.
    """
    words = materialise(count_words(docs, id_col, text_col, min_chars, min_count, modulus), "spelling-words")
    pairs = link_words(words, crowded)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("m"), F.col("other"))).alias("best"))
    judged = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.col1")).alias("m"))
    fits = F.col("m") >= factor * F.col("n")
    judged = materialise(judged.select("word", F.when(fits, F.col("other")).alias("form"), "n", "n_near", F.when(fits, F.col("m")).alias("form_n")), "spelling-forms")
    return follow(judged).select("word", "form", "root", "n", "n_near", "form_n")
