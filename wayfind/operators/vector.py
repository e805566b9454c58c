"""Exact vector search and hashed-term vectors."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.functions import text as T
from wayfind.functions import vectors as V
from wayfind.functions.batches import BATCH_ROWS, bound_batches
from wayfind.sources.sinks import current, keep, publish, replace_table, retire

MOST_QUERY_NUMBERS = 4_000_000  # of one block of queries that travels to the executors: 32 MB
MOST_SCORES = 2_000_000  # that a task holds at once: 16 MB
MOST_ASKED_COUNTS = 64_000_000  # of one block of questions that hash_topk sends: 64 MB before they are compressed
CHUNK, PART, SLICE = 16_384, 768, 1024  # documents that a task of hash_topk holds, documents and questions that meet at once


def clamp_k(k: float) -> int:
    """floor(k), 5 for zero and what is no number, then between 1 and 50."""
    whole = 0 if k is None or math.isnan(k) else (50 if k == math.inf else 1 if k == -math.inf else math.floor(k))
    return min(50, max(1, whole or 5))


def cosine_topk(vectors: DataFrame, query: list[float], k: float = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, score of the k nearest to one query, ties by id; null vectors are left out. A top-k of each partition is merged."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col), V.cosine(F.col(vec_col), q).alias("score"))
    return scored.orderBy(F.desc("score"), F.col(id_col)).limit(clamp_k(k))


def cosine_topk_many(vectors: DataFrame, queries: DataFrame, k: float = 5, id_col: str = "vec_id", vec_col: str = "embedding", query_col: str = "query_id", places: int | None = None) -> DataFrame:
    """query_id, id, score, rank for each query; queries: query_id, vec_col. places: scores are rounded to so many first.

    Queries travel in blocks of a bounded size; each task multiplies its batches by a block, at most MOST_SCORES numbers at a time,
    and keeps k rows a query, so what is shuffled is k rows a query and task, not the product.
    """
    k = clamp_k(k)
    spark = vectors.sparkSession
    bound_batches(spark, BATCH_ROWS)
    rows = queries.where(F.col(vec_col).isNotNull()).select(F.col(query_col).alias("q"), F.col(vec_col).cast("array<double>").alias("v"))
    dim, n = rows.select(F.max(F.size("v")), F.count("*")).first()
    parts = max(1, -(-n * (dim or 0) // MOST_QUERY_NUMBERS))
    if parts > 1:  # vectors may be made of texts: once, not once a block
        rows, vectors = keep(rows, "asked-vectors"), keep(vectors.select(id_col, vec_col), "vectors")
    part = F.pmod(F.xxhash64("q"), F.lit(parts))
    out = None
    for p in range(parts):
        block = rows.where(part == p).toArrow()
        matrix = block["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1) if n and len(block) else np.empty((0, dim or 0))
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((block["q"].to_pylist(), matrix / np.where(length == 0, 1, length)))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            held: list = []  # for each slice of queries: scores and ids of the best so far, in order
            step = 1
            for rows in batches:
                if not len(names) or not len(rows):
                    continue
                v = np.array(rows["v"].tolist(), np.float64)
                length = np.linalg.norm(v, axis=1, keepdims=True)
                v = (v / np.where(length == 0, 1, length)).T
                ids = rows["id"].to_numpy()
                if not held:
                    step = max(1, MOST_SCORES // max(BATCH_ROWS, len(ids)))
                    held = [(np.empty((len(names[a : a + step]), 0)), np.empty((len(names[a : a + step]), 0), ids.dtype)) for a in range(0, len(names), step)]
                for i, (scores, found) in enumerate(held):
                    score = matrix[i * step : (i + 1) * step] @ v
                    if places is not None:
                        score.round(places, out=score)
                    score[np.isnan(score)] = -np.inf
                    held[i] = _merge(scores, found, score, ids, k)
            for i, (scores, found) in enumerate(held):
                mine = names[i * step : (i + 1) * step]
                has = scores.ravel() > -np.inf  # not what is no number
                yield pd.DataFrame({"q": np.repeat(np.array(mine), scores.shape[1])[has], "id": found.ravel()[has], "score": scores.ravel()[has]})

        kinds = dict(vectors.dtypes)
        found = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInPandas(best, f"q {dict(queries.dtypes)[query_col]}, id {kinds[id_col]}, score double")
        out = found if out is None else out.union(found)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_col), F.col("id").alias(id_col), "score", "rank")


def _merge(scores: np.ndarray, found: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of those held (a row a query) and of a batch, by score, then id."""
    if scores.shape[1] == k:
        rows = np.flatnonzero((score >= scores[:, -1:]).any(1))  # only these can change
        if not len(rows):
            return scores, found
    else:
        rows = np.arange(len(score))
    most = min(k, scores.shape[1] + len(ids))
    new_scores, new_found = (scores, found) if scores.shape[1] == most else (np.empty((len(score), most)), np.empty((len(score), most), found.dtype))
    at_least = np.partition(score[rows], -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
    for row, least in zip(rows, at_least, strict=True):
        near = np.flatnonzero(score[row] >= least)  # k, and what ties with the last
        all_scores, all_ids = np.concatenate((scores[row], score[row][near])), np.concatenate((found[row], ids[near]))
        order = np.lexsort((all_ids, -all_scores))[:most]
        new_scores[row], new_found[row] = all_scores[order], all_ids[order]
    return new_scores, new_found


class _Signed(dict):
    """Term to bucket and sign, by FNV-1a over UTF-16 units; computed once a term, emptied when it is full."""

    def __init__(self, dim: int, most: int = 100_000):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, term: str) -> tuple[int, float]:
        if len(self) >= self.most:
            self.clear()
        units, h = np.frombuffer(term.encode("utf-16-le"), "<u2").tolist(), 2166136261
        for c in units:
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        self[term] = out = (h % self.dim, 1.0 if (h ^ ord("#")) * 16777619 & 1 else -1.0)
        return out


def _signed_sums(terms: Iterable[str], signed: _Signed) -> np.ndarray:
    v = np.zeros(signed.dim)
    for at, sign in map(signed.__getitem__, terms):
        v[at] += sign
    return v


def hash_embedding(text: Column, dim: int = 768) -> Column:
    """array<double>: each distinct term adds +1 or -1 to a bucket, then unit length; null without a term left.

    It is marked as not deterministic, though it is, so that a filter on the vectors (of isNotNull, or that explode brings along)
    stays above it: pushed below, it would embed all texts a second time, in a second Python worker a task.
    """

    bound_batches(SparkSession.getActiveSession(), BATCH_ROWS)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        signed = _Signed(dim)
        for rows in batches:
            out = []
            for terms in rows:
                v = _signed_sums(terms, signed)
                length = np.sqrt(v @ v)
                out.append(v / length if length else None)
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>").asNondeterministic()(T.content_terms(text))


def hash_vectors(docs: DataFrame, dim: int = 768, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, bucket, weight: the numbers of hash_embedding that are not zero. Rows without terms have none. No shuffle."""
    dense = docs.select(F.col(id_col), hash_embedding(F.col(text_col), dim).alias("v")).where(F.col("v").isNotNull())
    return dense.select(id_col, F.posexplode("v").alias("bucket", "weight")).where("weight <> 0")


def hash_counts(text: Column, dim: int = 768) -> Column:
    """binary: hash_embedding before it is brought to unit length, whole numbers of one byte each, or of four where one is too
    great for a byte; null without a term left. Marked as not deterministic for the same reason."""

    bound_batches(SparkSession.getActiveSession(), BATCH_ROWS)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        signed = _Signed(dim)
        for rows in batches:
            sums = (_signed_sums(terms, signed) for terms in rows)
            yield pd.Series([v.astype(np.int8 if np.abs(v).max() < 128 else "<i4").tobytes() if v.any() else None for v in sums], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary").asNondeterministic()(T.content_terms(text))


def _counts(packed: Iterable[bytes], dim: int) -> np.ndarray:
    """A row for each value of hash_counts: of bytes if all are."""
    packed = list(packed)
    if all(len(b) == dim for b in packed):
        return np.frombuffer(b"".join(packed), np.int8).reshape(-1, dim)
    return np.array([np.frombuffer(b, np.int8 if len(b) == dim else "<i4") for b in packed], np.int32)


def _lengths(counts: np.ndarray) -> np.ndarray:
    wide = counts.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", wide, wide))


class _Part:
    """Documents of like length, as a factor of products that hold several scalar products in one number.

    Scalar products of whole numbers are whole, and none, nor any sum on the way to it, is greater than the lengths multiplied. So
    where that is under 128, three fit into the 24 bits of a float, and two where it is under 2,048; beyond that a double holds one.
    """

    def __init__(self, counts: np.ndarray, lengths: np.ndarray, at: int):
        self.counts, self.lengths, self.at = counts, lengths, at
        self.least, self.most = lengths[0], lengths[-1]
        self.factors: dict[int, np.ndarray] = {}

    def products(self, asked: np.ndarray, longest: float) -> np.ndarray:
        """Whole numbers, a row a question and a column a document."""
        bound = longest * self.most + 1
        each = 3 if bound < 128 else 2 if bound < 2048 else 1
        if each == 1:
            return np.rint(asked.astype(np.float64) @ self.counts.T.astype(np.float64))
        bits = 24 // each
        if each not in self.factors:
            rows = -(-len(self.counts) // each)
            whole = np.zeros((rows * each, self.counts.shape[1]), np.float32)
            whole[: len(self.counts)] = self.counts
            self.factors[each] = sum(whole[i::each] * np.float32(1 << bits * i) for i in range(each)).T
        held = asked @ self.factors[each]
        held += np.float32(sum(1 << bits * i + bits - 1 for i in range(each)))  # so that no field is negative
        held = held.astype("<i4")
        if each == 3:
            return held.view(np.uint8).reshape(len(asked), -1, 4)
        return np.stack((held & 4095, held >> 12), 2)

    def candidates(self, asked: np.ndarray, lengths: np.ndarray, best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and scores of nine places that may be among the k best. best: the least score of each row that has k."""
        fields = self.products(asked, lengths.max())
        each = 1 if fields.ndim == 2 else 3 if fields.shape[2] == 4 else 2
        half = {1: 0, 2: 2048, 3: 128}[each]
        n = len(self.counts)
        row, column, product = [], [], []
        new = np.isneginf(best)
        if new.any():
            some = np.flatnonzero(new)
            dots = fields[some].astype(np.float64)
            dots = (dots if each == 1 else dots[:, :, :each].reshape(len(some), -1)[:, :n]) - half
            of = np.argpartition(-dots / self.lengths, min(k, n) - 1, axis=1)[:, : min(k, n)]
            scores = np.take_along_axis(dots, of, 1) / self.lengths[of] / lengths[some, None]
            best = best.copy()
            if n >= k:
                best[some] = scores.min(1)
        # The least product that can make that score, with room for what is lost in rounding.
        least = (best - 1e-8) * lengths
        least = np.where(least > 0, least * self.least, least * self.most)
        least = np.ceil(np.where(np.isneginf(least), -half if each > 1 else -np.inf, least - 1e-6))
        if each == 3:
            flat = fields.reshape(len(asked), -1)
            at = np.flatnonzero(flat >= np.clip(least + half, 1, 255).astype(np.uint8)[:, None])  # the fourth byte is 0
            row, column = np.divmod(at, flat.shape[1])
            product = flat.ravel()[at].astype(np.float64) - half
            column = column // 4 * 3 + column % 4
        else:
            flat = fields.reshape(len(asked), -1)
            at = np.flatnonzero(flat >= (least + half)[:, None].astype(flat.dtype))
            row, column = np.divmod(at, flat.shape[1])
            product = flat.ravel()[at].astype(np.float64) - half
        real = column < n
        row, column, product = row[real], column[real], product[real]
        score = np.round(product / (lengths[row] * self.lengths[column]), 9)
        near = score >= best[row] - 1e-8
        return row[near], column[near], score[near]


def _keep_best(scores: np.ndarray, ids: np.ndarray, row: np.ndarray, score: np.ndarray, own: np.ndarray) -> None:
    """Put what is among the k best by score, then id, into scores and ids, a row a question, those without k filled by -inf."""
    k = scores.shape[1]
    touched = np.unique(row)
    rows = np.concatenate((np.repeat(touched, k), row))
    every, of = np.concatenate((scores[touched].ravel(), score)), np.concatenate((ids[touched].ravel(), own))
    order = np.lexsort((of, -every, rows))
    first = np.searchsorted(rows[order], touched)
    chosen = order[first[:, None] + np.arange(k)]
    scores[touched], ids[touched] = every[chosen], of[chosen]


def hash_topk(docs: DataFrame, queries: DataFrame, k: float = 5, dim: int = 768, id_col: str = "doc_id", query_col: str = "query_id", text_col: str = "text", query_text: str = "query") -> DataFrame:
    """query_id, id, score, rank by cosine of hashed vectors of the texts, ties (to nine places) by id; all documents with
    a vector are ranked.

    Every question meets every document, so the work grows with the product, and what counts is what a pair costs. The vectors are
    whole numbers until they are divided by their lengths, so products hold two or three of them in each number (_Part), documents of
    like length side by side; a pair is looked at by itself only if its product may be enough for the k best. Texts are embedded
    once, and questions travel in blocks of a bounded size.
    """
    k = clamp_k(k)
    spark = docs.sparkSession
    vectors = docs.select(F.col(id_col).alias("id"), hash_counts(F.col(text_col), dim).alias("v")).where("v IS NOT NULL")
    asked = keep(queries.select(F.col(query_col).alias("q"), hash_counts(F.col(query_text), dim).alias("v")).where("v IS NOT NULL"), "asked-vectors")
    n, n_docs = asked.count(), docs.count()
    blocks = max(1, -(-n * dim // MOST_ASKED_COUNTS))
    if blocks > 1:
        vectors = keep(vectors, "vectors")
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n_docs // CHUNK) // 4)
    dealt = vectors.repartition(min(tasks, max(1, n_docs // PART)))
    out = None
    for p in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == p).toArrow()
        slices, lengths = [], np.zeros(len(block))
        values = block["v"]
        for a in range(0, len(block), SLICE):
            lengths[a : a + SLICE] = _lengths(_counts(values.slice(a, SLICE).to_pylist(), dim))
        order = np.argsort(lengths, kind="stable")  # so that few long questions do not widen the fields of all
        names = block["q"].take(order)
        for a in range(0, len(block), SLICE):
            mine = _counts(values.take(order[a : a + SLICE]).to_pylist(), dim)
            slices.append((names.slice(a, SLICE).to_pylist(), lengths[order[a : a + SLICE]], mine.dtype.str, zlib.compress(mine.tobytes(), 1)))
        shared = spark.sparkContext.broadcast(slices)

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            slices, held = shared.value, {}

            def meet(chunk: list[pd.DataFrame]) -> None:
                rows = pd.concat(chunk, ignore_index=True)
                counts = _counts(rows["v"], dim)
                lengths = np.concatenate([_lengths(counts[a : a + PART]) for a in range(0, len(counts), PART)])
                order = np.argsort(lengths, kind="stable")
                ids = rows["id"].to_numpy()[order]
                parts = [_Part(counts[order[a : a + PART]], lengths[order[a : a + PART]], a) for a in range(0, len(order), PART)]
                parts.sort(key=lambda part: abs(part.at - len(order) // 2))  # from the middle, where many are near
                for i, (names, long, kind, packed) in enumerate(slices):
                    asked = np.frombuffer(zlib.decompress(packed), kind).reshape(len(names), dim).astype(np.float32 if kind == "|i1" else np.float64)
                    scores, found = held.setdefault(i, (np.full((len(names), k), -np.inf), np.empty((len(names), k), ids.dtype)))
                    found[np.isneginf(scores)] = ids[0]
                    for part in parts:
                        row, column, score = part.candidates(asked, long, scores[:, -1], k)
                        if len(row):
                            _keep_best(scores, found, row, score, ids[part.at + column])

            chunk: list[pd.DataFrame] = []
            for rows in batches:
                chunk.append(rows)
                if sum(map(len, chunk)) >= CHUNK:
                    meet(chunk)
                    chunk = []
            if sum(map(len, chunk)):
                meet(chunk)
            for i, (scores, found) in held.items():
                has = scores.ravel() > -np.inf
                yield pd.DataFrame({"q": np.repeat(np.array(slices[i][0]), k)[has], "id": found.ravel()[has], "score": scores.ravel()[has]})

        made = dealt.mapInPandas(best, f"q {dict(asked.dtypes)['q']}, id {dict(vectors.dtypes)['id']}, score double")
        out = made if out is None else out.union(made)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_col), F.col("id").alias(id_col), "score", "rank")


def embed_text(title: F.Column, body: F.Column, between: str = "\n") -> F.Column:
    return F.concat_ws(between, title, body)


def backfill(docs: DataFrame, path: str, dim: int = 768) -> dict:
    """Hash vectors of all documents as a table at path, which replaces an old one once it is whole; rows and dim."""
    replace_table(hash_vectors(docs, dim), path)
    return {"updated": docs.count(), "dim": dim}


def embed_rows(rows: DataFrame, embedder: Callable[[list[str]], list], dim: int | None = None, id_col: str = "doc_id", text_col: str = "text", batch: int = 64, strict: bool = True) -> DataFrame:
    """id, embedding (array<double>), error: vectors of an injected embedder, which takes a list of at most `batch` texts.

    strict: a failing batch, a wrong number of vectors or a wrong length raises, so that nothing is written. Else a failing
    batch is tried again text by text, and a text that fails alone has a null vector and the error. Null texts count as empty.
    """

    def checked(texts: list[str]) -> list[list[float]]:
        vectors = [[float(x) for x in v] for v in embedder(texts)]
        if len(vectors) != len(texts):
            raise ValueError(f"the embedder gives {len(vectors)} vectors for {len(texts)} texts")
        wrong = next((len(v) for v in vectors if dim and len(v) != dim), None)
        if wrong is not None:
            raise ValueError(f"the embedder gives {wrong} numbers, not {dim}")
        return vectors

    def alone(text: str) -> tuple[list[float] | None, str | None]:
        try:
            return checked([text])[0], None
        except Exception as e:
            return None, (str(e).strip() or type(e).__name__).splitlines()[0][:300]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                texts = ["" if t is None else t for t in part["t"].tolist()]
                try:
                    found = [(v, None) for v in checked(texts)]
                except Exception:
                    if strict:
                        raise
                    found = [alone(t) for t in texts]
                yield pd.DataFrame({"id": part["id"].tolist(), "embedding": [v for v, _ in found], "error": [e for _, e in found]})

    kind = dict(rows.dtypes)[id_col]
    out = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, embedding array<double>, error string")
    return out.withColumnRenamed("id", id_col)


def backfill_with(docs: DataFrame, path: str, embedder: Callable[[list[str]], list], dim: int, batch: int = 64, id_col: str = "doc_id", text_col: str = "text", held: int = 2) -> dict:
    """Vectors of all documents by an injected embedder, published at path all or not at all; rows, dim and version.

    A batch that fails ends the job, and readers go on with the version before. Read them with sinks.current. The newest
    `held` versions stay.
    """
    version = publish(embed_rows(docs, embedder, dim, id_col, text_col, batch).drop("error"), path)
    retire(docs.sparkSession, path, held)
    return {"updated": current(docs.sparkSession, path, version=version).count(), "dim": dim, "version": version}
