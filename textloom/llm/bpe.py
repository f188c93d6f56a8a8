"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the public pattern. Tier one asks a minimal perfect hash whether
the whole pre-token is in the vocabulary; tier two merges its bytes in rank order with a heap over
a doubly linked list, O(n log n) in the pre-token's length. Ids are those of greedy rank-order
merging without special tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Pre-tokens that a worker remembers; when full it starts anew, which costs time but changes nothing.
REMEMBERED = 250_000


class PerfectHash:
    """A minimal perfect hash from byte strings to their places 0..n-1, by hash and displace.

    Keys fall into buckets by one hash; each bucket, largest first, gets the least seed under
    which all its keys land on free slots. Buckets of one key name their slot directly.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        self.keys: list[bytes] = [b""] * n
        self.values: list[int] = [-1] * n
        self.seeds = [0] * self.buckets
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            members[xxhash.xxh3_64_intdigest(key) % self.buckets].append(i)
        taken = bytearray(n)
        free = iter(range(n))
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            ids = members[b]
            if not ids:
                break
            if len(ids) == 1:
                slot = next(s for s in free if not taken[s])
                self.seeds[b], slots = -1 - slot, [slot]
            else:
                seed = 1
                while True:
                    slots = [xxhash.xxh3_64_intdigest(keys[i], seed) % n for i in ids]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    seed += 1
                self.seeds[b] = seed
            for i, s in zip(ids, slots, strict=True):
                taken[s], self.keys[s], self.values[s] = 1, keys[i], i

    def get(self, key: bytes) -> int:
        """The key's place, or -1."""
        if not self.keys:
            return -1
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.buckets]
        slot = -1 - seed if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % len(self.keys)
        return self.values[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of ``piece``: the neighbouring pair of least rank, leftmost first, is joined until none has a rank."""
    n = len(piece)
    after = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is joined to its left
    before = list(range(-1, n))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if not j or j >= n or after[j] != end:
            continue  # one of the two parts has changed since
        after[i], after[j] = end, 0
        if end < n:
            before[end] = i
            if (rank := ranks.get(piece[i : after[end]])) is not None:
                heappush(heap, (rank, i, after[end]))
        left = before[i]
        if left >= 0 and (rank := ranks.get(piece[left:end])) is not None:
            heappush(heap, (rank, left, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(ids)


class Encoder(dict):
    """Ids of each pre-token, worked out when first asked for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        ordered = sorted(ranks, key=ranks.__getitem__)
        self.whole = PerfectHash(ordered)
        self.rank_of = [ranks[k] for k in ordered]
        self.bytes_of = {ranks[k]: k for k in ordered}
        self.digits = {r: str(r) for r in self.bytes_of}

    def __missing__(self, pretoken: str) -> tuple[int, ...]:
        key = pretoken.encode()
        place = self.whole.get(key)
        ids = (self.rank_of[place],) if place >= 0 else merge(key, self.ranks)
        self[pretoken] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        if len(self) > REMEMBERED:
            self.clear()
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def listed(self, ids: list[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file; each worker process reads it once."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(key): int(rank) for key, rank in map(bytes.split, lines)}
    return Encoder(ranks, pattern)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str]:
    return (x or "" for x in batch.column(column).to_pylist())


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of each row. A null text counts as empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            ids = pa.array([coder.encode(t) for t in _texts(batch, 1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and the bytes that each row's ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            out = pa.array([coder.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def bpe_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, without a shuffle.

    Encodes each whole text and decodes the ids in one pass, so that ids don't travel. Null texts
    count as empty, repeated rows and null ids stay, an empty table gives no rows, and columns
    other than the two named ones are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            counts, listed, decoded = [], [], []
            for text in _texts(batch, 1):
                ids = coder.encode(text)
                counts.append(len(ids))
                listed.append(hashlib.sha256(coder.listed(ids).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
