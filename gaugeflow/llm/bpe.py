"""Byte-level BPE encoding with a two-tier lookup.

A text is split into pre-tokens by the tokenizer's pattern. Pre-tokens that are vocabulary entries themselves are found
by a minimal perfect hash over the vocabulary, for all distinct ones of a batch at once; the rest are merged with a heap
over linked bytes, in O(n log n) for a pre-token of n bytes. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH_CHARS = 2_000_000
MEMO_TOKENS = 200_000


class PerfectHash:
    """Minimal perfect hash of 64-bit keys: levels of bits in which a key is alone, ranked by running counts."""

    def __init__(self, keys: np.ndarray, spread: float = 1.7) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        left, base = np.asarray(keys, dtype=np.uint64), 0
        while len(left):
            size = max(64, int(len(left) * spread))
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, np.cumsum(alone) - 1, base))
            base += int(alone.sum())
            left = left[~alone[at]]
            if len(self.levels) > 60:
                raise ValueError("keys repeat")
        self.size = base

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return (x % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, 0 to size - 1; keys that were not hashed get any place or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (alone, rank, base) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(keys[left], level, len(alone))
            hit = alone[at]
            out[left[hit]] = base + rank[at[hit]]
            left = left[~hit]
        return out


class Encoder:
    """A vocabulary of byte strings with their ranks."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        words = list(self.ranks)
        keys = self._keys(words)
        self.hash = PerfectHash(keys)
        place = self.hash.index(keys)
        self.words: list[bytes] = [b""] * len(words)
        self.ids = np.zeros(len(words), dtype=np.int32)
        for w, p in zip(words, place.tolist(), strict=True):
            self.words[p] = w
            self.ids[p] = self.ranks[w]
        self.pattern = regex.compile(PATTERN)
        self.memo: dict[bytes, list[int]] = {}

    @staticmethod
    def _keys(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no vocabulary entry: always the merge of lowest rank, leftmost first."""
        n = len(word)
        ranks = self.ranks
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = end[i]
            if j >= n or end[j] != stop:
                continue  # one side has grown since
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                x = ranks.get(word[i : end[stop]])
                if x is not None:
                    heapq.heappush(heap, (x, i, end[stop]))
            h = before[i]
            if h >= 0:
                x = ranks.get(word[h:stop])
                if x is not None:
                    heapq.heappush(heap, (x, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each text in them); NULL and empty texts have no ids."""
        known: dict[str, int] = {}
        code: list[int] = []
        ends = np.zeros(len(texts) + 1, dtype=np.int64)
        find = self.pattern.findall
        for i, text in enumerate(texts):
            if text:
                code.extend([known.setdefault(t, len(known)) for t in find(text)])
            ends[i + 1] = len(code)
        words = [t.encode("utf-8", "surrogatepass") for t in known]
        ids, size, start = self._distinct(words)
        codes = np.array(code, dtype=np.int64)
        lens = size[codes] if len(codes) else np.zeros(0, dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(lens)])
        flat = ids[np.repeat(start[codes] - total[:-1], lens) + np.arange(total[-1])] if len(codes) else np.zeros(0, dtype=np.int32)
        return flat, total[ends]

    def _distinct(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, one after the other, with the number and start of each."""
        if not words:
            z = np.zeros(0, dtype=np.int64)
            return z.astype(np.int32), z, z
        place = self.hash.index(self._keys(words)).tolist()
        per: list[list[int]] = []
        if len(self.memo) > MEMO_TOKENS:
            self.memo.clear()
        vocabulary, ids, memo = self.words, self.ids.tolist(), self.memo
        for w, p in zip(words, place, strict=True):
            if p >= 0 and vocabulary[p] == w:
                per.append([ids[p]])
                continue
            got = memo.get(w)
            if got is None:
                got = self.merge(w)
                if len(w) <= 64:
                    memo[w] = got
            per.append(got)
        size = np.fromiter(map(len, per), dtype=np.int64, count=len(per))
        flat = np.fromiter((x for p in per for x in p), dtype=np.int32, count=int(size.sum()))
        return flat, size, np.concatenate([[0], np.cumsum(size)[:-1]])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a rank file, built once per Python worker."""
    return Encoder(path)


def rank_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """Where the rank file of a tokenizer lies."""
    return f"{folder}/{name}.tiktoken"


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size; a very long text is a range of its own."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if chars and chars + n > BATCH_CHARS:
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, counts: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in _pieces(texts):
            flat, offsets = enc.encode(texts[a:b])
            keys = batch.column(0).slice(a, b - a)
            if counts:
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(offsets), pa.int64())], ["key", "n_tokens"])
            else:
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, lists], ["key", "ids"])


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's text, without special tokens.

    Defined cases: NULL and empty texts give the empty list; strings that look like special tokens are ordinary text; a
    text of any length is encoded whole; repeated rows stay repeated; NULL keys stay; other columns are ignored; an empty
    table gives an empty result.
    """
    where = path or rank_file()
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", slim.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return slim.mapInArrow(lambda it: _encoded(it, where, False), schema).withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens): the number of token ids of each row's text; 0 for NULL and empty texts."""
    where = path or rank_file()
    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", slim.schema["key"].dataType), T.StructField("n_tokens", T.LongType())])
    return slim.mapInArrow(lambda it: _encoded(it, where, True), schema).withColumnRenamed("key", key)
