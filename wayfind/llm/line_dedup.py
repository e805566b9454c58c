"""Line dedup with DataFrame functions only.

Eligible lines become 128-bit hashes with their document and position. The hashes are range-partitioned with a
secondary sort by document and position, so that one very common line is spread over many partitions; each sorted run is
streamed once, and the first occurrence of a line in a document is marked. The marks are counted, one row per key and
partition, and the occurrences of common lines become sparse 64-line bitmaps per document; text is read again only to apply
them. No run is gathered into a row, however often a document repeats a line.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm._common import SPACES, materialise, same, split_rows


def line_key(line: Column) -> Column:
    """The line without SPACES at its ends, A-Z in lower case. lower() is the same on pure ASCII, and faster."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_runs(hashes: DataFrame) -> DataFrame:
    """hashes: h1, h2, d, t, r, pos. The same rows, sorted, with a mark: first, for the least pos of a line in a row of the table (r).

    The window has the keys and the order of the range partition and sort, so it adds no exchange and no sort: it reads the
    sorted run once.
    """
    order = ["h1", "h2", "d", "r"]
    run = hashes.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    return run.withColumn("first", F.row_number().over(Window.partitionBy(*order).orderBy("pos")) == 1)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, first_only: bool = False) -> DataFrame:
    """One row per document that loses lines: d (its id), t (hash of its text), n_dropped, drops array<struct<w int, bits long>>.

    Bit b of word w is set if line 64 * w + b goes. A row is a document: repeated rows count one by one, and rows that
    share the largest id all keep their lines, or with first_only only the first occurrence in each. A null id counts as the smallest. Null and empty texts have one empty
    line, which is never eligible unless min_chars is 0. Empty tables give no rows.
    """
    # r numbers the rows, so it must be there before they are exploded into lines.
    rows = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("t"), F.monotonically_increasing_id().alias("r"), _lines(F.col(text_col)).alias("lines"))
    lines = rows.select("d", "t", "r", F.posexplode("lines").alias("pos", "line"))
    rows = lines.select("d", "t", "r", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashes = materialise(rows.select("d", "t", "r", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")
    runs = materialise(line_runs(hashes), "line-runs")
    common = runs.where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("d").alias("keeper")).where(F.col("n") >= min_docs)
    common = materialise(common.select("h1", "h2", "keeper"), "common-lines")
    goes = ~same(F.col("d"), F.col("keeper"))
    if first_only:
        goes = goes | ~F.col("first")
    dropped = runs.join(common, ["h1", "h2"]).where(goes).select("d", "t", "pos")
    words = dropped.groupBy("d", "t", F.expr("pos div 64").cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy("d", "t").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.collect_list(F.struct("w", "bits")).alias("drops"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col replaced by the lines that stay, joined by line feeds (null: empty), and __n_lines, __n_dropped (long).

    Only texts that may lose a line are moved to meet their bitmaps. Both grow with the corpus, so they are merged at every size.
    """
    bitmaps = materialise(bitmaps, "bitmaps")
    concerned, others = split_rows(docs, F.xxhash64(id_col), bitmaps.select(F.xxhash64("d").alias("key")))
    marked = bitmaps.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("n_dropped").alias("__n"), F.map_from_entries("drops").alias("__words"))
    text, lines = F.coalesce(F.col(text_col), F.lit("")), _lines(F.col(text_col))
    joined = concerned.join(marked.hint("merge"), same(F.col(id_col), F.col("__d")) & (F.xxhash64(text_col) == F.col("__t")), "left")
    joined = joined.withColumn("__n_lines", F.size(lines).cast("long"))
    dense = F.transform(F.sequence(F.lit(0), F.expr("int((__n_lines - 1) div 64)")), lambda w: F.coalesce(F.try_element_at("__words", w), F.lit(0).cast("long")))
    joined = joined.withColumn("__dense", F.when(F.col("__n").isNotNull(), dense))
    stays = F.filter(lines, lambda line, i: F.getbit(F.get("__dense", (i / 64).cast("int")), i % 64) == 0)
    kept = F.when(F.col("__n").isNull(), text).otherwise(F.array_join(stays, "\n"))
    joined = joined.withColumns({text_col: kept, "__n_dropped": F.coalesce("__n", F.lit(0)).cast("long")}).drop("__d", "__t", "__n", "__words", "__dense")
    whole = others.withColumns({text_col: text, "__n_lines": F.size(lines).cast("long"), "__n_dropped": F.lit(0).cast("long")})
    return joined.unionByName(whole)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, first_only: bool = False) -> DataFrame:
    """docs with repeated lines gone from all documents but the one of the largest id; other columns as they were."""
    return apply_bitmaps(docs, line_bitmaps(docs, id_col, text_col, min_chars, min_docs, first_only), id_col, text_col).select(*docs.columns)


def line_dedup_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, kept_sha256 for each row of docs."""
    docs = docs.select("doc_id", "text")
    out = apply_bitmaps(docs, line_bitmaps(docs, min_chars=min_chars, min_docs=min_docs))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
k AS (
  SELECT r, doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT r) >= 5)
SELECT k.doc_id AS doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (c.key IS NULL OR k.doc_id IS NOT DISTINCT FROM c.keeper), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key
GROUP BY k.r, k.doc_id
"""
