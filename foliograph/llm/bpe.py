"""Encoding texts with a public byte-level BPE vocabulary in numpy matrices.

A text is cut into words by the vocabulary's pattern. The distinct words of a batch
that were not met before are padded into matrices by length bucket; each round
every row looks its adjacent pairs up in a hash table and merges its pair of
minimum rank, leftmost first, all places of that pair in one sweep (a pair made in
the sweep always has a later rank, so the result is that of one merge a round).
Rows that have no pair left leave the matrix, and the others are compacted.

Defined cases: a null or empty text has the empty list of ids; the strings of
special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the published word pattern of this family of vocabularies
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)


class Encoder:
    """Words to ids by one vocabulary file; words once encoded are kept up to `keep`."""

    def __init__(self, path: str, keep: int = 500_000) -> None:
        with open(path, "rb") as file:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        keys, ranks = [], []
        for token, rank in ids.items():
            for cut in range(1, len(token)):
                left, right = ids.get(token[:cut]), ids.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank)
        self._hash(np.array(keys, np.uint64), np.array(ranks, np.int32))
        self.words = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}
        self.keep = keep

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing: all pairs are placed in rounds, those that find their slot taken move on by one."""
        self.bits = int(np.ceil(np.log2(max(2, len(keys)) * 4)))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.probes, left, slots = 0, np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[slots] == np.uint64(2**64 - 1)
            first = np.unique(slots[free], return_index=True)[1]
            put = left[free][first]
            self.keys[slots[free][first]], self.ranks[slots[free][first]] = keys[put], ranks[put]
            stay = ~np.isin(left, put)
            left, slots = left[stay], (slots[stay] + 1) & self.mask
            self.probes += 1

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the vocabulary has no such pair; an id below zero has none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.keys[slots] != np.uint64(2**64 - 1)) & (right >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slots_open = (slots[open_] + 1) & self.mask
            slots[open_] = slots_open
            hit = self.keys[slots_open] == keys[open_]
            out[open_[hit]] = self.ranks[slots_open[hit]]
            open_ = open_[~hit & (self.keys[slots_open] != np.uint64(2**64 - 1))]
        return np.where(right < 0, NONE, out)

    def _matrix(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of similar length."""
        width = max(map(len, words))
        lengths = np.array([len(w) for w in words])
        m = np.full((len(words), width + 1), -1, np.int32)
        inside = np.arange(width + 1) < lengths[:, None]
        m[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        out: list[list[int]] = [[]] * len(words)
        rows = np.arange(len(words))
        ranks = self.pair_ranks(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(words), width)
        while len(rows):
            best = ranks.min(axis=1)
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = m[k, : lengths[k]].tolist()
                rows, m, ranks, lengths, best = rows[~done], m[~done], ranks[~done], lengths[~done], best[~done]
                if not len(rows):
                    break
                width = int(lengths.max())
                m, ranks = m[:, : width + 1], ranks[:, :width]
            at = ranks == best[:, None]
            # of overlapping places (aaa) every second one, counted from the left of its run
            if (at[:, 1:] & at[:, :-1]).any():
                cols = np.arange(at.shape[1])
                start = np.maximum.accumulate(np.where(~at, cols + 1, 0), axis=1)
                at &= (cols - start) % 2 == 0
            m[:, :-1][at] = np.broadcast_to(best[:, None], at.shape)[at]
            gone = np.zeros(m.shape, bool)
            gone[:, 1:] = at
            lengths = lengths - at.sum(axis=1)
            kept = ~gone
            target = np.cumsum(kept, axis=1) - 1
            moved = np.full(m.shape, -1, np.int32)
            r, c = np.nonzero(kept)
            moved[r, target[r, c]] = m[r, c]
            m = moved
            ranks = self.pair_ranks(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(rows), m.shape[1] - 1)
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes `words` by length bucket (each twice as wide as the last), a bounded number of cells at a time."""
        buckets: dict[int, list[str]] = {}
        for word in words:
            buckets.setdefault((len(word) * 2).bit_length(), []).append(word)
        for size, group in buckets.items():
            step = max(1, 400_000 >> size)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.known.update(zip(part, self._matrix([w.encode("utf-8", "replace") for w in part])))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        split = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
        self.learn({w for words in split for w in words} - self.known.keys())
        known = self.known
        return [[i for w in words for i in known[w]] for words in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path)


def _batches(key: str, path: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = code.encode(part.column(1).to_pylist())
                sizes = np.fromiter(map(len, ids), np.int32, len(ids))
                if count_only:
                    column = pa.array(sizes)
                else:
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
                    column = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), column], [key, "n_tokens" if count_only else "ids"])

    return run


def encode_texts(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row of `df`; one narrow pass, no shuffle."""
    schema = T.StructType([df.select(key).schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(_batches(key, path, False), schema)


def count_tokens(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row of `df`; the ids never leave Python."""
    schema = T.StructType([df.select(key).schema[0], T.StructField("n_tokens", T.IntegerType())])
    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(_batches(key, path, True), schema)
