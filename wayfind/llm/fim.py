"""Fill-in-middle by a parallel automaton scan.

One automaton reads a text: it counts the places where a token begins (a run of letters, or any other code point) and
notices the markers. It has six states, so a piece of text is summed up by a function from states to states and, for each
state it may be entered in, the number of tokens that begin in it. Such sums compose, and composition is associative:

- A text is cut into strips of 64 code points; all strips of a batch are scanned in lockstep, from all six states at once.
- A giant document is also cut into pieces that are dealt over the cluster. Pieces are summed up where they are, blocks of
  256 sums are composed, then the blocks of a document; going back down, each piece learns its entry state and the tokens
  before it. The piece that holds a cut is found by a join, and only there is the cut looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from wayfind.llm._common import materialise

STRIP, BLOCK = 64, 256
#: What separates the parts of an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# Classes of code points: neither letter nor sign of a marker, letter, P S or M, <, >; PAD changes nothing.
OTHER, LETTER, NAME, OPEN, CLOSE, PAD = range(6)
# States: between words, in a word, after <, after < and a name; after a whole marker: between words, in a word.
BETWEEN, WORD, OPENED, NAMED, FOUND, FOUND_WORD = range(6)
STATES = 6


def _move(state: int, kind: int) -> tuple[int, int]:
    """The next state, and 1 if a token begins here."""
    if kind == PAD:
        return state, 0
    letter, found = kind in (LETTER, NAME), state >= FOUND or (state == NAMED and kind == CLOSE)
    begins = int(not (letter and state in (WORD, NAMED, FOUND_WORD)))
    if found:
        return (FOUND_WORD if letter else FOUND), begins
    if letter:
        return (NAMED if state == OPENED and kind == NAME else WORD), begins
    return (OPENED if kind == OPEN else BETWEEN), begins


_TABLE = [_move(s, k) for k in range(6) for s in range(STATES)]
STEP = np.array([to for to, _ in _TABLE], np.int64)
BEGINS = np.array([n for _, n in _TABLE], np.int64)
_STEP, _BEGINS = STEP.tolist(), BEGINS.tolist()
KIND = np.array([NAME if c in b"PSM" else LETTER if chr(c).isalpha() else OPEN if c == ord("<") else CLOSE if c == ord(">") else OTHER for c in range(128)] + [OTHER], np.uint8)


class Scan:
    """The strips of some texts, scanned in lockstep."""

    def __init__(self, texts: list[str]):
        kinds, self.first = [], [0]
        for text in texts:
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            kinds += [KIND[np.minimum(points, 128)], np.full(-len(points) % STRIP, PAD, np.uint8)]
            self.first.append(self.first[-1] - (-len(points) // STRIP))
        self.strips = np.concatenate(kinds).reshape(-1, STRIP) if kinds else np.empty((0, STRIP), np.uint8)
        to, n = np.tile(np.arange(STATES), (len(self.strips), 1)), np.zeros((len(self.strips), STATES), np.int64)
        for k in range(STRIP):
            at = self.strips[:, k, None].astype(np.int64) * STATES + to
            n += BEGINS[at]
            to = STEP[at]
        self.to, self.n = to.tolist(), n.tolist()

    def follow(self, text: int, state: int) -> tuple[int, list[tuple[int, int]]]:
        """The end state of a text entered in a state, and for each strip its entry state and the tokens before it, with a last pair for the end."""
        before, ways = 0, []
        for k in range(self.first[text], self.first[text + 1]):
            ways.append((state, before))
            state, before = self.to[k][state], before + self.n[k][state]
        ways.append((state, before))
        return state, ways

    def summary(self, text: int) -> tuple[list[int], list[int]]:
        """The end state and the number of tokens for each entry state."""
        ends = [self.follow(text, s) for s in range(STATES)]
        return [e for e, _ in ends], [ways[-1][1] for _, ways in ends]

    def cut(self, text: int, ways: list[tuple[int, int]], rank: int) -> int:
        """The offset at which token number `rank` (from 0) begins; there must be such a token."""
        lo, hi = 0, len(ways) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if ways[mid][1] <= rank else (lo, mid)
        state, left = ways[lo][0], rank - ways[lo][1]
        for k, kind in enumerate(self.strips[self.first[text] + lo].tolist()):
            at = kind * STATES + state
            if _BEGINS[at]:
                if not left:
                    return lo * STRIP + k
                left -= 1
            state = _STEP[at]
        raise IndexError(rank)


def _groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `most` code points, so that a scan's memory is bounded, with the place of the first."""
    at = size = 0
    for k, text in enumerate(texts):
        if k > at and size + len(text) > most:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(text)
    if texts:
        yield at, texts[at:]


@F.pandas_udf(StructType([StructField("n", LongType()), StructField("marked", BooleanType()), StructField("first", LongType()), StructField("second", LongType())]))
def _cut_whole(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Of whole texts: number of tokens, whether a marker is in it, and both cuts in code points."""
    for text, h1, h2 in batches:
        texts, out = text.tolist(), []
        for at, some in _groups(texts):
            scan = Scan(some)
            for k, one in enumerate(some):
                end, ways = scan.follow(k, BETWEEN)
                n = ways[-1][1]
                cuts = [scan.cut(k, ways, r) if r < n else len(one) for r in sorted((int(h1.iat[at + k]) % (n + 1), int(h2.iat[at + k]) % (n + 1)))]
                out.append((n, end >= FOUND, *cuts))
        yield pd.DataFrame(out, columns=["n", "marked", "first", "second"])


@F.pandas_udf(StructType([StructField("to", ArrayType(IntegerType())), StructField("n", ArrayType(LongType()))]))
def _sum_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for pieces in batches:
        out = []
        for _, some in _groups(pieces.tolist()):
            scan = Scan(some)
            out += [scan.summary(k) for k in range(len(some))]
        yield pd.DataFrame(out, columns=["to", "n"])


@F.pandas_udf(LongType())
def _cut_piece(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pieces, entries, ranks in batches:
        out = []
        for at, some in _groups(pieces.tolist()):
            scan = Scan(some)
            for k in range(len(some)):
                _, ways = scan.follow(k, int(entries.iat[at + k]))
                out.append(scan.cut(k, ways, int(ranks.iat[at + k])))
        yield pd.Series(out, dtype="int64")


_cut_whole, _sum_up, _cut_piece = (f.asNondeterministic() for f in (_cut_whole, _sum_up, _cut_piece))  # so that none is evaluated twice


def _compose(sums: Column) -> Column:
    """One sum of an array of sums (to, n), in their order: f, then g, goes to g.to[f.to[s]] with f.n[s] + g.n[f.to[s]] tokens."""
    same = F.struct(F.array(*[F.lit(s) for s in range(STATES)]).alias("to"), F.array(*[F.lit(0).cast("long")] * STATES).alias("n"))
    return F.aggregate(
        sums,
        same,
        lambda f, g: F.struct(F.transform(f["to"], lambda s: F.get(g["to"], s)).alias("to"), F.zip_with(f["n"], f["to"], lambda n, s: n + F.get(g["n"], s)).alias("n")),
    )


def _entries(sums: Column, state: Column, before: Column) -> Column:
    """For each of an array of sums: its key `at`, its entry state, the tokens before it and in it."""
    start = F.struct(state.alias("state"), before.alias("before"), F.array().cast("array<struct<at: int, entry: int, before: bigint, n: bigint>>").alias("found"))
    step = lambda x, g: F.struct(
        F.get(g["to"], x["state"]).alias("state"),
        (x["before"] + F.get(g["n"], x["state"])).alias("before"),
        F.array_append(x["found"], F.struct(g["at"].alias("at"), x["state"].alias("entry"), x["before"].alias("before"), F.get(g["n"], x["state"]).alias("n"))).alias("found"),
    )
    return F.aggregate(sums, start, step, lambda x: x["found"])


def _cut_giants(giants: DataFrame, piece: int) -> DataFrame:
    """giants: k1, k2 (the key of a document), h1, h2, text. k1, k2, n, marked, first, second by pieces; one row a key."""
    key, cell = ["k1", "k2"], ["k1", "k2", "at"]
    cut = giants.select(*key, F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))).alias("at", "piece"))
    pieces = materialise(cut.repartition(*cell), "fim-pieces")
    sums = pieces.select(*cell, _sum_up("piece").alias("s")).groupBy(*cell).agg(F.first("s").alias("s"))  # repeated rows: once
    sums = materialise(sums.select(*key, F.expr(f"at div {BLOCK}").cast("int").alias("block"), F.struct("at", "s.to", "s.n").alias("s")), "fim-sums")
    blocks = sums.groupBy(*key, "block").agg(F.array_sort(F.collect_list("s")).alias("sums"))
    blocks = materialise(blocks.select(*key, "block", "sums", _compose(F.col("sums")).alias("whole")), "fim-blocks")
    whole = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("block").alias("at"), "whole.to", "whole.n"))).alias("sums"))
    whole = whole.select(*key, "sums", _compose(F.col("sums")).alias("whole"))
    whole = whole.select(*key, "sums", F.get("whole.n", F.lit(BETWEEN)).alias("n"), (F.get("whole.to", F.lit(BETWEEN)) >= FOUND).alias("marked"))
    asked = giants.select(*key, "h1", "h2", F.length("text").cast("long").alias("size")).distinct()
    totals = materialise(whole.join(asked, key), "fim-totals")
    ranks = F.array(F.least(F.expr("h1 % (n + 1)"), F.expr("h2 % (n + 1)")), F.greatest(F.expr("h1 % (n + 1)"), F.expr("h2 % (n + 1)")))
    wanted = totals.select(*key, "sums", F.posexplode(ranks).alias("which", "rank"))
    wanted = wanted.select(*key, "which", "rank", F.explode(_entries(F.col("sums"), F.lit(BETWEEN), F.lit(0).cast("long"))).alias("b"))
    inside = lambda c: (F.col("rank") >= F.col(f"{c}.before")) & (F.col("rank") < F.col(f"{c}.before") + F.col(f"{c}.n"))
    wanted = wanted.where(inside("b")).select(*key, "which", "rank", F.col("b.at").alias("block"), "b.entry", "b.before")
    wanted = wanted.join(blocks.select(*key, "block", "sums"), [*key, "block"])
    wanted = wanted.select(*key, "which", "rank", F.explode(_entries(F.col("sums"), F.col("entry"), F.col("before"))).alias("p")).where(inside("p"))
    wanted = materialise(wanted.select(*key, F.col("p.at").alias("at"), "which", F.col("p.entry").alias("entry"), (F.col("rank") - F.col("p.before")).alias("rank")), "fim-wanted")
    places = wanted.join(pieces.dropDuplicates(cell), cell).select(*key, "which", (F.col("at").cast("long") * piece + _cut_piece("piece", "entry", "rank")).alias("place"))
    places = places.groupBy(*key).agg(F.max(F.when(F.col("which") == 0, F.col("place"))).alias("first"), F.max(F.when(F.col("which") == 1, F.col("place"))).alias("second"))
    # A cut behind the last token is at the end of the text.
    return totals.join(places, key, "left").select(*key, "n", "marked", F.coalesce("first", "size").alias("first"), F.coalesce("second", "size").alias("second"))


def _between(text: Column, begin: Column, end: Column) -> Column:
    """Code points begin to end - 1, from 0."""
    return F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output: markers do not occur in the text, so the first of each kind is the one that was put there."""
    at = lambda mark: F.instr(output, mark) - 1
    p, s, m = at(PREFIX), at(SUFFIX), at(MIDDLE)
    n = F.length(output)
    psm = F.concat(_between(output, p + 3, s), _between(output, m + 3, n), _between(output, s + 3, m))
    spm = F.concat(_between(output, p + 3, m), _between(output, m + 3, n), _between(output, s + 3, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_from: int = 90, spm_below: int = 20, piece: int = 32_768, seed: int = 1) -> DataFrame:
    """docs with five more columns: fim_tokens (long), fim_form (plain, psm, spm), fim_prefix_chars, fim_middle_chars (long), fim_output.

    Cuts and forms follow from the id and the seed alone. plain_from: of a hundred ids, those from here on stay plain, as do
    empty texts and texts that hold a marker; spm_below: of the others, so many of a hundred put the suffix first. Null texts are empty; a null id
    counts as an empty one. Repeated rows come back each, and rows that share an id but not the text are cut by their own
    tokens. Texts of more than `piece` code points are cut by pieces; results don't depend on it. Empty tables give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    own = docs.columns
    rows = docs.withColumns({"__text": text, "__h": F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substring(digest, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))})
    short = rows.where(F.length("__text") <= piece).withColumn("__c", _cut_whole("__text", F.get("__h", F.lit(0)), F.get("__h", F.lit(1))))
    keyed = rows.where(F.length("__text") > piece).withColumns({"__k1": F.xxhash64(id_col, text_col), "__k2": F.xxhash64(F.lit(1), id_col, text_col)})
    found = _cut_giants(keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.get("__h", F.lit(0)).alias("h1"), F.get("__h", F.lit(1)).alias("h2"), F.col("__text").alias("text")), piece)
    found = found.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.struct("n", "marked", "first", "second").alias("__c"))
    giant = keyed.join(found.hint("merge"), ["__k1", "__k2"]).select(*short.columns)
    cut = short.unionByName(giant)
    plain = (F.col("__text") == "") | F.col("__c.marked") | (F.get("__h", F.lit(2)) % 100 >= plain_from)
    cut = cut.withColumn("fim_form", F.when(plain, "plain").when(F.get("__h", F.lit(3)) % 100 < spm_below, "spm").otherwise("psm"))
    t, a, b = F.col("__text"), F.col("__c.first"), F.col("__c.second")
    prefix, middle, suffix = _between(t, F.lit(0), a), _between(t, a, b), _between(t, b, F.length(t))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    parted = F.col("fim_form") != "plain"
    return cut.select(
        *own,
        F.col("__c.n").alias("fim_tokens"),
        "fim_form",
        F.when(parted, a).alias("fim_prefix_chars"),
        F.when(parted, b - a).alias("fim_middle_chars"),
        F.when(~parted, t).when(F.col("fim_form") == "psm", psm).otherwise(spm).alias("fim_output"),
    )


def fim_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id",
        F.col("fim_tokens").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        sha(F.col("fim_output")).alias("output_sha256"),
        sha(restore(F.col("fim_output"), F.col("fim_form"))).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
k AS (
  SELECT doc_id, text, t, len(t) AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, text, n, form, array_to_string(t[1:least(a, b)], '') AS prefix,
         array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(t[greatest(a, b) + 1:], '') AS suffix
  FROM k)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
