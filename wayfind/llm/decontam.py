"""Benchmark decontamination by template windows.

Words of documents and benchmark items are reduced to templates: numbers, units after numbers and names become typed
placeholders. Names are read in three ways: as words, as capitals inside a sentence, and with first words of sentences,
words in all capitals and runs of names as one. Windows of template words are hashed. The windows of the benchmark are a
table; those of the documents pass a bit filter of a fixed size made from it, and what passes meets that table in a hash
join, in one pass over the documents. A window counts if its slots are consistent: where the item has one value in two
slots, the document has one value there too. So a re-parameterised question is caught and a chance mixture is not.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm._common import materialise, same, split_rows, text_udf
from wayfind.llm._text import WordCache, batch_numbers, numbers, rolling

# Units that follow a number.
UNITS = "mm cm m km in ft mi mg g kg lb oz ml l s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years mph kmh usd eur gbp dollars euros percent % $ € °c °f kb mb gb tb w kw v hz"

# Words that begin sentences without being names (English, German, French, Spanish).
COMMON = """a about after all also although an and any are as at because before both but by can consider could did do does during each
either every few find first for from give given had has have he her here his how however i if in is it its last let many more most my
new no not now of on once one or our out over she should show since so some such suppose than that the their them then there these
they this those three to today tomorrow two under until up use was we were what when where which while who whom whose why will with
would yesterday yet you your
aber alle als am an auch auf aus bei beim das dass dem den der des die dies diese dieser dieses du durch ein eine einem einen einer er
es für gib hat heute ich ihr ihre im in ist jede jeder jedes kann man mein mit nach nicht nun nur ob oder seine sie sind so um und uns
von vor wann war warum was weil welche welcher welches wenn wer wie wir wird wo zu zum zur zwei
au aux avec ce ces cet cette chaque combien comme comment dans de depuis des donc du elle elles en est et il ils je la le les leur
leurs lorsque mais ne nous on ou où par pendant plus pour pourquoi puis quand que quel quelle quelles quels qui sa sans se ses si
soit son sous sur tous tout toute un une vous
al ante aquel aquella así aunque cada como con cuando cuál cuáles cuánto cuánta cuántos cuántas cómo de del desde después donde dos
dónde el ella ellas ellos en entre era es esa ese eso esta estas este esto estos está fue ha hay la las lo los luego más mi mientras
muchos no nos nosotros para pero por porque qué que quien quién se según ser si sin sobre son su sus también tiene toda todas todo
todos tras tu un una y ya yo"""

NUMBER, UNIT, NAME = 1, 2, 3
ENDS, CAPITAL = 1, 2  # flags in the two low bits of a packed word
UPPER, USUAL = 1 << 63, 1 << 62  # and in the two high bits: all capitals, a common word
FLAGS = UPPER | USUAL
EDGE = b".,;:!?"


def packer() -> Callable[[bytes], int]:
    """Word to 60 bits of identity and the flags. Identities 1 and 2 are the number and unit placeholders."""
    units, common = {u.encode() for u in UNITS.split()}, {w.encode() for w in COMMON.split()}
    edge = b".,;:!?\"'()[]{}<>*#$%&|`~_-"
    number = re.compile(rb"[+-]?[$]?\d[\d.,:/]*[%]?$")
    measured = re.compile(rb"[+-]?\d[\d.,:/]*([a-zA-Z%]+)$")

    digest, identity = xxhash.xxh64_intdigest, USUAL - 4

    def f(word: bytes) -> int:
        # Most words are letters and perhaps one mark after them; they need none of the patterns.
        last = word[-1] if word else 0
        bare = word[:-1] if last in EDGE else word
        low = bare.lower()
        if low not in units:
            ends = ENDS if last in b".!?:" else 0
            if bare.isalpha():
                capital = 0 if low == bare or len(bare) < 2 or bare[0] > 90 else UPPER if bare.isupper() else CAPITAL
                return digest(low, 7) & identity | (8 | ends | capital | (USUAL if low in common else 0))
            text = bare.decode("utf-8", "replace")
            if text.isalpha():
                capital = 0 if len(text) < 2 or not text[0].isupper() else UPPER if text.isupper() else CAPITAL
                low = text.lower().encode()
                return digest(low, 7) & identity | (8 | ends | capital | (USUAL if low in common else 0))
        ends = ENDS if word.rstrip(b"\"')]}*#$%&|").endswith((b".", b"!", b"?", b":")) else 0
        bare = word.strip(edge)
        if number.match(bare or word):
            return NUMBER << 2 | ends
        if (m := measured.match(bare)) and m[1].lower() in units:
            return NUMBER << 2 | ends
        low = bare.lower() or word
        if low in units:
            return xxhash.xxh64_intdigest(b"unit " + low, 7) % USUAL >> 3 << 3 | ends  # a placeholder only after a number
        text = bare.decode("utf-8", "replace")
        capital = 0
        if len(text) > 1 and text[0].isupper():
            capital = UPPER if text.isupper() else CAPITAL
        low = text.lower().encode()
        return (xxhash.xxh64_intdigest(low, 7) % USUAL | 8) >> 2 << 2 | ends | capital | (USUAL if low in common else 0)

    return f


def templates(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two readings of the words: with the names as words, and with names (capital inside a sentence) as placeholders."""
    ids = (packed & np.uint64(USUAL - 1)) >> np.uint64(2)
    unit = np.zeros(len(ids), bool)
    unit[1:] = (packed[1:] & np.uint64(4 | CAPITAL) == 0) & (ids[:-1] == NUMBER) & (ids[1:] > NAME)
    plain = np.where(unit, np.uint64(UNIT), ids)
    named = np.where((packed & np.uint64(CAPITAL) > 0) & inside(packed), np.uint64(NAME), plain)
    return plain, named


def inside(packed: np.ndarray) -> np.ndarray:
    """Whether a word is not the first of a sentence."""
    out = np.zeros(len(packed), bool)
    out[1:] = packed[:-1] & np.uint64(ENDS) == 0
    return out


def short_names(packed: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A third reading: also names in all capitals and capitalised first words of sentences, common words aside, are names,
    and a run of them in a sentence is one placeholder. With it: where each of its words begins, and the number of words."""
    within = inside(packed)
    name = (packed & np.uint64(CAPITAL | UPPER) > 0) & (within | (packed & np.uint64(USUAL) == 0)) & (plain > NAME)
    first = np.ones(len(packed), bool)
    first[1:] = ~(name[1:] & name[:-1] & within[1:])
    begins = np.flatnonzero(first)
    return np.where(name, np.uint64(NAME), plain)[begins], np.append(begins, len(packed))


WIDEST = 8  # words of a window, at most: a pair of slots has its bit in an int


class Readings:
    """The windows of one text: three readings with their slots. The text is cut into words again where slots are asked for."""

    def __init__(self, text: str, packed: np.ndarray):
        self.text = text
        self.plain, named = templates(packed)
        short, begins = short_names(packed, self.plain)
        places = np.arange(len(packed) + 1)
        self.all = [(0, self.plain, places), (0, named, places), (1, short, begins)]

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    def keys(self, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each reading: its number, the starts of its windows, and their keys. A window that two readings share comes once."""
        for number, (kind, reading, _) in enumerate(self.all):
            hashes = rolling(reading, width)
            starts = np.arange(len(hashes))
            if number == 1 and len(hashes):
                other = np.concatenate(([0], np.cumsum(reading != self.plain)))
                starts = np.flatnonzero(other[width:] > other[:-width])
                hashes = hashes[starts]
            keys = (hashes ^ np.uint64(kind << 4 | width)) * np.uint64(0x9E3779B97F4A7C15)
            yield number, starts, keys ^ keys >> np.uint64(32)

    def slots(self, number: int, start: int, width: int) -> int:
        """The pairs of slots of a window that have one type and one value, a bit each."""
        _, reading, begins = self.all[number]
        at = [k for k in range(start, start + width) if reading[k] <= NAME]
        value = [(int(reading[k]), b" ".join(self.words[begins[k] : begins[k + 1]]).strip(EDGE).lower()) for k in at]
        return sum(1 << (a - start) * (2 * WIDEST - 1 - (a - start)) // 2 + b - a - 1 for i, a in enumerate(at) for j, b in enumerate(at[i + 1 :], i + 1) if value[i] == value[j])


def item_windows(text: str, packed: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """width, key, first word, word after the last, slot pairs of each window with three plain words (or all, if it is narrower)."""
    item = Readings(text, packed)
    if len(packed) < 3 or (item.plain > NAME).sum() < 3:
        return  # nothing to hold on to
    for w in {min(width, len(reading)) for _, reading, _ in item.all}:
        for number, starts, keys in item.keys(w):
            _, reading, begins = item.all[number]
            if min(width, len(reading)) != w or not len(starts):
                continue
            literal = np.convolve(reading > NAME, np.ones(w, int), "valid")
            for start, key in zip(starts.tolist(), keys.view(np.int64).tolist(), strict=True):
                if literal[start] >= min(3, w):
                    yield w, key, int(begins[start]), int(begins[start + w]), item.slots(number, start, w)


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """cls (hash of the text), n_words, width, key, first, last, pairs: the windows of each distinct text, as a table."""
    texts = benchmark.where(F.col("text").isNotNull()).groupBy(F.xxhash64("text").alias("cls")).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordCache(packer())
        for rows in batches:
            for cls, text in zip(rows["cls"].tolist(), rows["text"].tolist(), strict=True):
                words = text.encode().split()
                found = pd.DataFrame(item_windows(text, numbers(words, cache), width), columns=["width", "key", "first", "last", "pairs"])
                found.insert(0, "n_words", len(words))
                found.insert(0, "cls", cls)
                yield found

    return materialise(texts.mapInPandas(run, "cls long, n_words int, width int, key long, first int, last int, pairs int"), "benchmark-windows")


def bit_filter(windows: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits (2 MB for 24), set at the low bits of each key. The driver gets at most 2^bits / 64 rows, whatever the benchmark."""
    place = F.col("key").bitwiseAND((1 << bits) - 1)
    rows = windows.groupBy(F.shiftright(place, 6).cast("int").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, CAST((key & {(1 << bits) - 1}) % 64 AS INT)))").alias("w")).collect()
    out = np.zeros(1 << bits - 6, np.int64)
    for at, w in rows:
        out[at] = w
    return out.view(np.uint8)


def window_hits(spark: SparkSession, windows: DataFrame, width: int, bits: int) -> Callable[[Column], Column]:
    """Text to array<struct<key long, at int, pairs int>>: its windows that pass the filter; null without any."""
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # WIDEST at most
    shared = spark.sparkContext.broadcast((bit_filter(windows, bits), widths))

    def make():
        bits, widths = shared.value
        known, cache = np.unpackbits(bits, bitorder="little").view(bool), WordCache(packer(), 500_000)

        def f(texts: list) -> list:
            out = []
            for t, packed in zip(texts, batch_numbers(texts, cache), strict=True):
                found = []
                if len(packed) >= 3:
                    text = Readings(t, packed)
                    for w in widths:
                        for number, starts, keys in text.keys(w):
                            for k in np.flatnonzero(known[(keys & np.uint64(len(known) - 1)).astype(np.int64)]).tolist():
                                start = int(starts[k])
                                found.append({"key": int(keys[k].astype(np.int64)), "at": int(text.all[number][2][start]), "pairs": text.slots(number, start, w)})
                out.append(found or None)
            return out

        return f

    return text_udf(make, "array<struct<key long, at int, pairs int>>")


def covered(spans: Column) -> Column:
    """The number of words in the union of sorted struct<first, last> spans."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["upto"], x["last"]).alias("upto"), (s["n"] + F.greatest(x["last"] - F.greatest(s["upto"], x["first"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, start, step, lambda s: s["n"])


def matched(hits: DataFrame, windows: DataFrame, coverage: float, crowd: int) -> DataFrame:
    """r, cls, first, last, at, n_words: windows of documents and items with one key and consistent slots.

    Windows that more than `crowd` items share would give every document that has one a row for every item. They count only
    for a pair of document and item that also shares another window, except for items that such windows alone could
    carry; so no pair is lost.
    """
    fits = F.col("pairs").bitwiseAND(F.bitwise_not(F.col("held"))) == 0
    seen = hits.withColumnRenamed("pairs", "held")
    out = ["r", "cls", "first", "last", "at", "n_words"]
    crowded = materialise(windows.groupBy("key").agg(F.count_distinct("cls").alias("items")).where(F.col("items") > crowd).select("key"), "crowded-windows")
    if crowded.isEmpty():
        return seen.join(windows, "key").where(fits).select(*out)
    common = windows.join(crowded, "key", "left_semi")
    spans = common.groupBy("cls", "n_words").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("s"))
    carried = materialise(spans.where(covered(F.col("s")) >= coverage * F.col("n_words")).select("cls"), "carried-items")
    direct = windows.join(crowded, "key", "left_anti").unionByName(common.join(carried, "cls", "left_semi"))
    one = materialise(seen.join(direct, "key").where(fits).select(*out), "direct-matches")
    pairs = one.select("r", "cls").distinct()
    two = seen.join(crowded, "key", "left_semi").join(pairs, "r").join(common.join(carried, "cls", "left_anti"), ["key", "cls"]).where(fits)
    return one.union(two.select(*out))


def _leaks(docs: DataFrame, benchmark: DataFrame, width: int, coverage: float, filter_bits: int, crowd: int) -> DataFrame:
    """doc_id, t (hash of the text), r (number of the row), cls, coverage, word_at."""
    if not 3 <= width <= WIDEST:
        raise ValueError(f"a window has 3 to {WIDEST} words")
    windows = benchmark_windows(benchmark, width)
    find = window_hits(docs.sparkSession, windows, width, filter_bits)
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("r"), find(F.col("text")).alias("m")).where(F.col("m").isNotNull())
    rows = materialise(rows, "window-hits")
    hits = rows.select("r", F.explode("m").alias("m")).select("r", "m.*")
    spans = matched(hits, windows, coverage, crowd).groupBy("r", "cls", "n_words", "first", "last").agg(F.min("at").alias("at"))
    found = spans.groupBy("r", "cls", "n_words").agg(covered(F.array_sort(F.collect_list(F.struct("first", "last")))).alias("n"), F.min("at").alias("word_at"))
    found = found.where(F.col("n") >= coverage * F.col("n_words")).select("r", "cls", (F.col("n") / F.col("n_words")).alias("coverage"), "word_at")
    return rows.select("r", "doc_id", "t").join(materialise(found, "found-items"), "r")


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5, filter_bits: int = 24, crowd: int = 64) -> DataFrame:
    """doc_id, item_id, coverage, word_at: the documents that hold benchmark items, and which.

    An item is found if slot-consistent windows of `width` template words cover at least that share of its words; word_at is
    the document's first word in them. Items of fewer words are one window; those without three plain words can't be told
    and are not looked for. Null and empty texts hold nothing; null items are skipped, and copies of an item are each
    reported. Repeated rows come back each. Ids keep their types.
    """
    found = _leaks(docs, benchmark, width, coverage, filter_bits, crowd)
    items = benchmark.select(F.xxhash64("text").alias("cls"), "item_id")
    return found.join(items, "cls").select("doc_id", "item_id", "coverage", "word_at")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, coverage: float = 0.5, filter_bits: int = 24, crowd: int = 64) -> DataFrame:
    """docs without the rows that hold a benchmark item; columns as they were."""
    found = _leaks(docs, benchmark, width, coverage, filter_bits, crowd).select(F.col("doc_id").alias("__d"), F.col("t").alias("__t")).distinct()
    found = materialise(found, "leaked-rows")
    concerned, others = split_rows(docs, F.xxhash64("doc_id"), found.select(F.xxhash64("__d").alias("key")))
    return concerned.join(found, same(F.col("doc_id"), F.col("__d")) & (F.xxhash64("text") == F.col("__t")), "left_anti").union(others)
