"""Encoding of whole texts by a public byte-level BPE vocabulary (problem 6).

Texts are cut into pre-tokens by the vocabulary's public pattern; the distinct
new ones of a batch are encoded together through a pair occurrence index: every
adjacent pair that the vocabulary can merge is mapped, by its rank, to all its
positions in the batch. Ranks are taken in ascending order; all positions of a
rank are merged at once, and only the lists of the neighbouring pairs change.
Pre-tokens met before keep their ids, so that a worker encodes each once.

Defined cases: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; repeated rows each come out; only ``doc_id`` and
``text`` are read, so further columns never clash; an empty table gives an empty
result. Texts of any length are taken whole.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("TERMLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a worker keeps with their ids, and characters encoded in one go.
KEPT, GO = 300_000, 4_000_000


@lru_cache(4)
def ranks(name: str, folder: str = TOKENIZERS) -> dict[bytes, int]:
    """The vocabulary ``name``: ids, which are also merge ranks, by bytes."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairIndex:
    """Encodes batches of pre-tokens by ascending rank over an index of pair positions."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.byte_id = [vocabulary[bytes([b])] for b in range(256)]
        self.bytes_of = {i: t for t, i in vocabulary.items()}
        self.vocabulary = vocabulary
        self.merges: dict[int, int] = {}  # pair of ids -> id of both, or -1

    def merged(self, a: int, b: int) -> int:
        pair = a << 32 | b
        if (r := self.merges.get(pair)) is None:
            r = self.merges[pair] = self.vocabulary.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def encode(self, words: Iterable[str]) -> list[tuple[int, ...]]:
        """The ids of each pre-token."""
        ids: list[int] = []
        after: list[int] = []  # position of the next token of the same pre-token, or -1
        before: list[int] = []
        starts: list[int] = []
        where: dict[int, list[int]] = {}  # rank -> positions of the left token of a pair
        byte_id, merges, merged = self.byte_id, self.merges, self.merged
        for w in words:
            data = w.encode("utf-8")
            start, n = len(ids), len(data)
            starts.append(start)
            ids.extend(map(byte_id.__getitem__, data))
            after.extend(range(start + 1, start + n))
            after.append(-1)
            before.append(-1)
            before.extend(range(start, start + n - 1))
            for p in range(start, start + n - 1):
                if (r := merges.get(ids[p] << 32 | ids[p + 1])) is None:
                    r = merged(ids[p], ids[p + 1])
                if r >= 0:
                    where.setdefault(r, []).append(p)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            for p in sorted(where.pop(rank)):
                q = after[p]
                if q < 0 or ids[p] < 0 or merges.get(ids[p] << 32 | ids[q], -1) != rank:
                    continue  # an earlier merge took one side
                ids[p], ids[q] = rank, -1
                after[p] = nxt = after[q]
                if nxt >= 0:
                    before[nxt] = p
                    if (r := merges.get(rank << 32 | ids[nxt])) is None:
                        r = merged(rank, ids[nxt])
                    if r >= 0:
                        if r not in where:
                            where[r] = []
                            heapq.heappush(active, r)
                        where[r].append(p)
                if (prev := before[p]) >= 0:
                    if (r := merges.get(ids[prev] << 32 | rank)) is None:
                        r = merged(ids[prev], rank)
                    if r >= 0:
                        if r not in where:
                            where[r] = []
                            heapq.heappush(active, r)
                        where[r].append(prev)
        out = []
        for p in starts:
            own = []
            while p >= 0:
                own.append(ids[p])
                p = after[p]
            out.append(tuple(own))
        return out


class Encoder:
    """Encodes batches of texts; keeps the ids of pre-tokens between batches."""

    def __init__(self, vocabulary: str | dict[bytes, int] = "byte_bpe_50k", folder: str = TOKENIZERS):
        self.index = PairIndex(ranks(vocabulary, folder) if isinstance(vocabulary, str) else vocabulary)
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def batch(self, texts: list[str | None]) -> Iterator[list[tuple[int, ...]]]:
        """For each text the ids of its pre-tokens."""
        at = 0
        while at < len(texts):
            n, cut = 0, []
            while at < len(texts) and (n < GO or not cut):
                text = texts[at] or ""
                cut.append(self.cut(text))
                n += len(text)
                at += 1
            if len(self.known) > KEPT:
                self.known.clear()
            new = list(dict.fromkeys(w for words in cut for w in words if w not in self.known))
            self.known.update(zip(new, self.index.encode(new)))
            for words in cut:
                yield [self.known[w] for w in words]


def encoded(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and ``ids``, the token ids of each document's whole text. Only the driver reads the vocabulary, a file of fixed size, and broadcasts it."""
    shared = documents.sparkSession.sparkContext.broadcast(ranks(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            values, ends = [], [0]
            for words in encoder.batch(batch.column(1).to_pylist()):
                values.append(np.fromiter(chain.from_iterable(words), np.int32))
                ends.append(ends[-1] + len(values[-1]))
            flat = np.concatenate(values) if values else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def sized(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and ``n_tokens``, the number of tokens of each document's whole text; the ids themselves stay in the worker."""
    shared = documents.sparkSession.sparkContext.broadcast(ranks(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            sizes = [sum(map(len, words)) for words in encoder.batch(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")
