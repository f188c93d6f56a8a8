"""Best-fit packing of tokenized documents into fixed-length sequences.

Documents become pieces of at most ``seq_len`` tokens. Packing is bulk-synchronous best-fit, from
the longest pieces to the shortest. Open sequences are a table of gaps. In a superstep the pieces of
one class of lengths and the gaps that may hold them are range-sorted by size; every range is swept
on its own, each piece taking its successor, the smallest gap that is still free; what ranges leave
over is matched by rank, conflicts included, since each row has one rank; pieces without a gap open
new sequences; and the gaps are updated for the next superstep. Classes are narrow enough that the
number of sequences is that of one-by-one best-fit decreasing, or nearly so.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import _text
from textloom.llm._spark import BROADCAST_ROWS, durable, stored
from textloom.session import new_folder

SEQ_LEN = 2048
END_ID = 0
#: A class reaches down to this share of its longest piece, where that is longer than so much of a sequence.
CLASS_SHARES = [(1 / 6, 0.9), (1 / 16, 0.75), (0, 0.5)]
#: Rows of a range, which one task sweeps.
ROWS_EACH = 200_000
#: Partitions at least in which gaps and places are kept, so that no executor does all of a small superstep.
LEAST = 6
#: Atoms that a worker remembers (20 bytes each); when full it starts anew, which costs time but changes nothing.
REMEMBERED = 1_000_000

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_CLASS[list(b"0123456789")] = _DIGIT
_CLASS[0x80:] = _LETTER
_CLASS[_text.IS_SPACE] = _SPACE
#: First bytes of characters beyond U+017F, or below U+00C0.
_FAR = np.zeros(256, bool)
_FAR[0xC0:] = True
_FAR[0xC3:0xC6] = False


def atoms(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and oddness of the pieces of text that the tokenizer takes one by one.

    Those are runs of letters, single digits, and runs of other characters. A run without white
    space that has a letter beyond U+017F, a sign that isn't ASCII, or an apostrophe before a letter
    is odd and stays whole: only the tokenizer knows how to cut it.
    """
    kind = _CLASS[part]
    high = np.flatnonzero(part >= 0xC0)
    lead, trail = part[high], part[high + 1]
    signs = ((lead == 0xC3) & ((trail == 0x97) | (trail == 0xB7))) | ((lead == 0xC4) & (trail == 0xB0))  # two signs; a capital that becomes two characters
    quote = np.flatnonzero(part[:-1] == 0x27)
    odd = np.r_[high[_FAR[lead] | signs], quote[_CLASS[part[quote + 1]] == _LETTER]]
    edge = np.zeros(len(part) + 1, bool)
    edge[bounds] = True
    if len(odd):
        space = kind == _SPACE
        stops = np.flatnonzero(np.r_[space, True] | edge)
        first = np.flatnonzero(~space & (np.r_[True, space[:-1]] | edge[:-1]))
        for start in first[np.unique(np.searchsorted(first, odd, "right") - 1)].tolist():
            kind[start : int(stops[np.searchsorted(stops, start, "right")])] = _ODD
    new = np.ones(len(part) + 1, bool)
    new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT) | edge[1:-1]
    cut = np.flatnonzero(new)
    start, end = cut[:-1], cut[1:]
    full = kind[start] != _SPACE
    return start[full], end[full], kind[start[full]] == _ODD


class WordTokenizer:
    """The ids of whole texts, for a vocabulary whose pre-tokenizer drops white space.

    Texts are cut into atoms, which are told apart by 64-bit hashes; what a worker has seen it
    remembers as sorted arrays. Ids of a new atom come from the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows between ``offsets``, one after the other, and where each row's end."""
        part, bounds = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        start, end, odd = atoms(part, bounds)
        # an odd atom's capitals may matter to the tokenizer, so its hash keeps them
        hashes = _text.segment_hash(_text.LOWER[part], start, end)
        if odd.any():
            hashes[odd] = _text.mix(_text.segment_hash(part, start[odd], end[odd]))
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            new = ~known
            begin, size = self._learn(part, start[first[new]], end[first[new]], odd[first[new]])
            places = at[new]
            self.keys, self.begin, self.size = (np.insert(old, places, add) for old, add in ((self.keys, keys[new]), (self.begin, begin), (self.size, size)))
            at = np.searchsorted(self.keys, keys)
        begin, size = self.begin[at][which], self.size[at][which].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.flat[np.arange(int(size.sum())) + np.repeat(begin - ends + size, size)]
        row_ends = np.r_[0, ends][np.searchsorted(start, bounds[1:])]
        return ids, row_ends

    def _learn(self, part: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Asks the tokenizer for atoms; where their ids begin in ``flat``, and how many each has."""
        raw = part.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        plain = [t for t, o in zip(texts, odd.tolist(), strict=True) if not o]
        size = np.zeros(len(texts), np.int32)
        found: list[np.ndarray] = []
        # plain atoms are words of one closing id each, so many are encoded as one text and cut there
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.closes[ids]) + 1
        alone = np.flatnonzero(odd)
        if len(stops) == len(plain):
            size[~odd] = np.diff(np.r_[0, stops])
            found.append(ids)
            order = np.r_[np.flatnonzero(~odd), alone]
        else:
            order = alone = np.arange(len(texts))
        for i, one in zip(alone.tolist(), self.tokenizer.encode_batch_fast([texts[i] for i in alone.tolist()], add_special_tokens=False), strict=True):
            size[i] = len(one.ids)
            found.append(np.array(one.ids, np.uint32))
        begin = np.zeros(len(texts), np.int64)
        begin[order] = self.used + np.r_[0, np.cumsum(size[order])[:-1]]
        added = np.concatenate(found)
        if self.used + len(added) > len(self.flat):
            self.flat = np.r_[self.flat[: self.used], np.zeros(self.used + 2 * len(added), np.uint32)]
        self.flat[self.used : self.used + len(added)] = added
        self.used += len(added)
        return begin, size

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column; null is an empty text."""
        data, offsets = _text.text_bytes(column)
        for lo, hi in _text.chunks(offsets):
            part = data[offsets[lo] : offsets[hi]].tobytes()
            if any(s in part for s in self.special):  # a special token's string is that token, also amid a word
                for i in range(lo, hi):
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            ids, ends = self.encode(data, offsets[lo : hi + 1])
            yield from np.split(ids, ends[:-1])


@lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file; each worker process reads it once."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", seq_len: int = SEQ_LEN, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids with ``keep_ids``): each document's tokens, cut.

    A document is the ids of its whole text and then ``end_id``; only one of more than ``seq_len``
    tokens is cut. A null text counts as empty and gives the piece of ``end_id`` alone.
    """

    @_text.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.rows(batch.column(1)), strict=True):
                whole = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                for number, at in enumerate(range(0, len(whole), seq_len)):
                    own = whole[at : at + seq_len]
                    rows.append((doc, number, at, len(own), zlib.crc32(own), own if keep_ids else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(columns[: 5 + keep_ids], kinds, strict=False)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids)


PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PIECE_TYPE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_STEP = f"sequence_id long, {_PIECE_TYPE}, opens boolean"
_SWEPT = f"part int, kind int, rank long, sequence_id long, {_PIECE_TYPE}"
#: Kinds of rows that a sweep gives: gaps and pieces that its range left over, pieces that found their gap
#: there, and one row with the numbers of the first two (pieces as rank, gaps as sequence_id).
_GAP, _LEFT, _FOUND, _SUMS = 0, 1, 2, 3


def classes(counts: dict[int, int], seq_len: int) -> Iterator[tuple[int, int, int]]:
    """low, high, number of pieces: the lengths (low, high] of each superstep, from the longest on.

    Pieces of more than half a sequence never share one, so they are one class. Other classes are
    narrow where few pieces make a sequence, so that it hardly matters which of a class comes first.
    """
    left = sorted(counts, reverse=True)
    while left:
        high = left[0]
        share = next(share for least, share in CLASS_SHARES if high > least * seq_len)
        low = seq_len // 2 if 2 * high > seq_len else min(int(high * share), high - 1)
        yield low, high, sum(counts[x] for x in left if x > low)
        left = [x for x in left if x <= low]


def nest(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of a range's rows go together: indexes of gaps, of their pieces, and of rows left over.

    ``gap`` tells gaps from pieces; rows come from large to small, a gap before pieces of its size. A piece takes the smallest gap
    so far that is free, so gaps and pieces match as opening and closing brackets do: at each depth
    they take turns. What is left are pieces and, after them, gaps.
    """
    depth = np.cumsum(np.where(gap, 1, -1))
    level = np.where(gap, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    near = np.flatnonzero((level[order][1:] == level[order][:-1]) & gap[order][:-1] & ~gap[order][1:])
    opening, closing = order[near], order[near + 1]
    alone = np.ones(len(gap), bool)
    alone[opening] = alone[closing] = False
    by_place = np.argsort(closing)
    return opening[by_place], closing[by_place], np.flatnonzero(alone)


@_text.frugal
def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches within one range of sizes; the rest is numbered for the ranges after it."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    gap = np.asarray(table.column("length").is_null())
    opening, closing, alone = nest(gap)
    rows = np.r_[closing, alone]
    kind = np.r_[np.full(len(closing), _FOUND), np.where(gap[alone], _GAP, _LEFT)].astype(np.int32)
    rank = np.arange(len(rows))
    for k in (_GAP, _LEFT):
        rank[kind == k] = np.arange(int((kind == k).sum()))
    sequences = np.asarray(table.column("sequence_id").fill_null(-1))
    sequence = np.r_[sequences[opening], sequences[alone]]
    part = np.full(len(rows), TaskContext.get().partitionId(), np.int32)
    columns = [pa.array(part), pa.array(kind), pa.array(rank), pa.array(sequence), *(table.column(c).take(pa.array(rows)).combine_chunks() for c in PIECE)]
    out = pa.table(columns, names=["part", "kind", "rank", "sequence_id", *PIECE])
    yield from out.to_batches(20_000)
    sums = {"part": part[0], "kind": _SUMS, "rank": int((kind == _LEFT).sum()), "sequence_id": int((kind == _GAP).sum())}
    yield pa.RecordBatch.from_pylist([sums], out.schema)


class Run(NamedTuple):
    """``count`` rows of kind ``kind`` of one range, from ``rank`` on: pair numbers (or places in new sequences) from ``number`` on, up or down."""

    part: int
    kind: int
    rank: int
    count: int
    number: int
    step: int
    new: bool


def across(left: dict[int, tuple[int, int]], pairs: int = 0) -> tuple[list[Run], int, int]:
    """Runs of leftover gaps and pieces that match between ranges, and how many pairs and new places there are.

    ``left``: number of leftover pieces and gaps of each range. As in ``nest``, the last gap that is
    still free goes first. Pieces that find none are numbered for new sequences.
    """
    runs, free, new = [], [], 0
    for part in sorted(left):
        pieces_left, gaps_left = left[part]
        at = 0
        while at < pieces_left and free:
            owner, top = free.pop()
            n = min(pieces_left - at, top)
            runs.append(Run(owner, _GAP, top - n, n, pairs + n - 1, -1, False))
            runs.append(Run(part, _LEFT, at, n, pairs, 1, False))
            pairs, at = pairs + n, at + n
            if top > n:
                free.append((owner, top - n))
        if at < pieces_left:
            runs.append(Run(part, _LEFT, at, pieces_left - at, new, 1, True))
            new += pieces_left - at
        if gaps_left:
            free.append((part, gaps_left))
    return runs, pairs, new


def _numbered(left: DataFrame, runs: list[Run]) -> DataFrame:
    """The leftover rows of ``runs``, with their ``number`` and whether it is a ``new`` place."""
    schema = "array<struct<part: int, kind: int, lowest: long, count: long, number: long, step: int, new: boolean>>"
    names = ["part", "kind", "lowest", "count", "number", "step", "new"]
    listed = json.dumps([dict(zip(names, run, strict=True)) for run in runs])
    table = left.sparkSession.range(1).select(F.inline(F.from_json(F.lit(listed), schema)))  # without a Python worker
    table = F.broadcast(table) if len(runs) <= BROADCAST_ROWS else table
    meant = left.join(table, ["part", "kind"]).filter((F.col("rank") >= F.col("lowest")) & (F.col("rank") < F.col("lowest") + F.col("count")))
    return meant.select("kind", "sequence_id", *PIECE, (F.col("number") + F.col("step") * (F.col("rank") - F.col("lowest"))).alias("number"), "new")


def offers(counts: dict[int, int], high: int, n: int) -> dict[int, int]:
    """How many places a gap of each size offers to ``n`` pieces of at most ``high``; none where tighter ones suffice.

    ``counts``: number of gaps of each size. A gap that surely holds several pieces may offer as many; of
    such places ``n`` are enough, so all gaps together offer at most ``n`` more than one each.
    """
    out = {gap: 1 for gap in counts if gap < high}
    for gap in sorted((g for g in counts if g >= high), key=lambda g: (g // (g // high), g)):
        out[gap] = min(gap // high, -(-n // counts[gap]))
        n = max(0, n - out[gap] * counts[gap])
    return out


def _merged(gaps: DataFrame, own: DataFrame, high: int, places: dict[int, int]) -> DataFrame:
    """Gaps and pieces as rows of one kind. A gap is as many rows as it has ``places``, which are those of ``offers``."""
    listed = F.from_json(F.lit(json.dumps([places.get(gap, 0) for gap in range(max(places, default=0) + 1)])), "array<int>")
    number, size = F.get(listed, F.col("gap").cast("int")), F.floor(F.col("gap") / F.greatest(F.lit(1), F.floor(F.col("gap") / high)))
    offered = gaps.withColumn("places", number).filter("places > 0").select("sequence_id", size.alias("size"), F.explode(F.sequence(F.lit(1), F.col("places"))).alias("place"))
    blank = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in PIECE]
    left = offered.select("size", F.lit(False).alias("is_piece"), F.xxhash64("sequence_id", "place").alias("lot"), "sequence_id", *blank)
    right = own.select(F.col("length").alias("size"), F.lit(True).alias("is_piece"), F.xxhash64(*PIECE).alias("lot"), F.lit(None).cast("long").alias("sequence_id"), *PIECE)
    return left.unionByName(right)


def pack(rows: DataFrame, seq_len: int = SEQ_LEN, rows_each: int = ROWS_EACH) -> DataFrame:
    """``rows`` (as ``pieces`` gives them) with sequence_id and offset.

    Each superstep takes the pieces of one class of lengths, range-sorts them together with the
    gaps that are wide enough, sweeps the ranges side by side, matches what they left over by rank,
    lets what found no gap open new sequences, and updates the gaps. The driver gets the number of
    pieces of each length and, in each superstep, of gaps of each size (``seq_len`` rows at most) and, of each superstep, how many rows each range
    left over; a range has about ``rows_each`` rows.
    """
    spark = rows.sparkSession
    kept = stored(rows.select(*PIECE))
    counts = {r["length"]: r["count"] for r in kept.groupBy("length").count().collect()}
    ranges = lambda n: max(1, -(-n // rows_each))
    # sorted files: a superstep reads its own lengths only
    ordered = stored(kept.repartitionByRange(ranges(sum(counts.values())), "length", F.xxhash64(*PIECE)).sortWithinPartitions("length"))
    gaps = spark.range(0).select(F.col("id").alias("sequence_id"), F.col("id").alias("gap"))
    path, opened = new_folder(spark, "placed"), 0
    for number, (low, high, n) in enumerate(classes(counts, seq_len)):
        wide = gaps.filter(F.col("gap") > low)
        places = offers({r["gap"]: r["count"] for r in wide.groupBy("gap").count().collect()}, high, n) if opened else {}
        merged = _merged(wide, ordered.filter((F.col("length") > low) & (F.col("length") <= high)), high, places)
        order = [F.col("size").desc(), "is_piece", "lot"]
        swept = stored(merged.repartitionByRange(ranges(n + opened), *order).sortWithinPartitions(*order, *PIECE).select("sequence_id", *PIECE).mapInArrow(_sweep, _SWEPT))
        found = [swept.filter(F.col("kind") == _FOUND).select("sequence_id", *PIECE, F.lit(False).alias("opens"))]
        rest = swept.filter(F.col("kind").isin(_GAP, _LEFT))
        sums = swept.filter(F.col("kind") == _SUMS).select("part", "rank", "sequence_id").collect()  # a row of each range
        runs, pairs, new = across({r["part"]: (r["rank"], r["sequence_id"]) for r in sums})
        numbered, each = _numbered(rest, runs), seq_len // high
        if pairs:
            free = numbered.filter(F.col("kind") == _GAP).select("number", "sequence_id")
            waiting = numbered.filter((F.col("kind") == _LEFT) & ~F.col("new")).drop("sequence_id")
            found.append(waiting.join(free, "number").select("sequence_id", *PIECE, F.lit(False).alias("opens")))
        if new:
            sequence = F.lit(opened) + F.floor(F.col("number") / each)
            found.append(numbered.filter("new").select(sequence.alias("sequence_id"), *PIECE, (F.col("number") % each == 0).alias("opens")))
        reduce(DataFrame.unionByName, found).coalesce(max(LEAST, ranges(n))).write.parquet(f"{path}/superstep={number}")
        step = spark.read.schema(_STEP).parquet(f"{path}/superstep={number}")
        opened += -(-new // each)
        taken = step.select("sequence_id", (F.when(F.col("opens"), seq_len).otherwise(0) - F.col("length")).alias("gap"))
        updated = wide.unionByName(taken).groupBy("sequence_id").agg(F.sum("gap").alias("gap"))
        gaps = durable(gaps.filter(F.col("gap") <= low).unionByName(updated).filter(F.col("gap") >= min(counts)).coalesce(max(LEAST, ranges(opened))))
    if not counts:
        return kept.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), *PIECE).rowsBetween(Window.unboundedPreceding, -1)
    placed = spark.read.schema(_STEP).parquet(path).select("sequence_id", *PIECE)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Null texts count as empty; repeated rows are packed each for itself; a null id is an id like
    any other; ties go by id, piece and checksum; an empty table gives no rows; other columns are
    ignored. The longest text is held in memory once, in the task that has it.
    """
    return pack(pieces(docs, path, doc_id, text, seq_len, end_id), seq_len).select(*PIECE, "sequence_id", "offset")
