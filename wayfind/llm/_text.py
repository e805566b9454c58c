"""Word-level helpers for code that runs in Python workers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class WordCache(dict):
    """Word to number, computed once a word. Emptied when it is full, so its memory is bounded; results don't depend on that."""

    def __init__(self, f: Callable[[bytes], int], most: int = 100_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = n = self.f(word)
        return n


def numbers(words: list[bytes], cache: WordCache, kind: type = np.uint64) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), kind, len(words))


def batch_numbers(texts: list[str | None], cache: WordCache) -> list[np.ndarray]:
    """numbers() of the words (split at ASCII white space) of each text; each word is looked up once for all texts. Null: none."""
    words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()).fill_null(""))
    flat = words.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False), bool)  # white space at the ends leaves empty ones
    coded = flat.cast(pa.large_binary()).dictionary_encode()
    table = np.fromiter((cache[w] if w else 0 for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    ids = table[coded.indices.to_numpy()][full] if len(flat) else np.empty(0, np.uint64)
    ends = np.concatenate(([0], np.cumsum(full)))[words.offsets.to_numpy()]
    return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of that many ids (uint64, wraps around)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += ids[k : k + n]
    return out ^ (out >> np.uint64(29))
