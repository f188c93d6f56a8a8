"""Phrases of two to five words that occur together more often than their parts suggest.

A generalised suffix automaton of a block of texts has a state for each set of end positions that
some substrings share; a state's suffix link leads to the longest suffix of its substrings that
ends in more places. The links form the trie of the reversed texts, so ``Automaton`` gets states, links
and counts of end positions by sorting the reversed contexts of all positions, one word of depth
at a time, to the depth that is wanted; no transition is followed one by one.

Counts of all substrings of a corpus would outgrow it, and most occur once. So there are two turns:

1. Each block sends the distinct hashes of its word pairs, sorted, to ranges of hashes; a range
   adds up the blocks' counts and answers each of them with a bit a pair: often enough or not.
2. A block cuts its pieces where a pair isn't. What is left holds every phrase that occurs often
   enough, since all pairs of such a phrase do. The automaton of those runs lists its substrings
   with their counts, as text, and Spark adds them up over the blocks.

The counts of the second turn are by text and exact; a hash that two pairs share can only let more
through the first. The rest is relational: scores from the counts of both sides of each cut, and
subsumption from the links, because a phrase and one a word longer that holds it have equal counts
just when they are of one state.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import _text
from textloom.llm._spark import durable, if_small, stored
from textloom.llm.lm import from_planes, planes

#: Bytes of text in a block, and bytes of corpus for each range of hashes.
BLOCK_BYTES, RANGE_BYTES = 6_000_000, 6_000_000
UNKNOWN = "und"

_WORD, _BLANK, _CUT = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _CUT
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Stream(NamedTuple):
    """The words of some texts in order: byte range, hash, text, and whether the next word is of the same piece."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    joined: np.ndarray


def stream(data: np.ndarray, offsets: np.ndarray) -> Stream:
    """Words of the rows between ``offsets`` in lower case (A-Z), within pieces."""
    part, bounds = _text.LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    kind = _KIND[part]
    inside = kind == _WORD
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(part))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(bounds, start, "right") - 1
    piece = np.searchsorted(np.flatnonzero(kind == _CUT), start)
    joined = np.zeros(len(start), bool)
    joined[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    return Stream(part, start, end, _text.segment_hash(part, start, end), doc, joined)


def pair_keys(s: Stream, lang: np.ndarray) -> np.ndarray:
    """A hash of each word and the next one with the language of their text, where both are of one piece."""
    at = np.flatnonzero(s.joined)
    with np.errstate(over="ignore"):
        return _text.mix(_text.mix(s.hash[at] * _GOLD + lang[s.doc[at]]) + s.hash[at + 1])


class Level(NamedTuple):
    """Substrings of one length: where each ends first, how often, the one a word shorter at the same ends."""

    end: np.ndarray
    count: np.ndarray
    suffix: np.ndarray


class Automaton:
    """The states of a generalised suffix automaton, to a depth.

    ``words`` are numbers, ``reach`` says how many words before each one belong to the same string.
    ``levels[n]`` are the distinct substrings of n words; one whose count equals that of its
    ``suffix`` is of the suffix's state, otherwise that is where its suffix link leads.
    """

    def __init__(self, words: np.ndarray, reach: np.ndarray, depth: int):
        self.levels: dict[int, Level] = {}
        ends, code = np.arange(len(words)), np.zeros(len(words), np.int64)
        for n in range(1, depth + 1):
            kept = reach[ends] >= n - 1
            ends, code = ends[kept], code[kept]
            if not len(ends):
                break
            width = int(words.max()) + 1
            _, first, now, count = np.unique(code * width + words[ends - n + 1], return_index=True, return_inverse=True, return_counts=True)
            self.levels[n] = Level(ends[first], count, code[first])
            code = now.astype(np.int64)

    def states(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By length, the substrings that are the longest of a state: end, count, length of the state's shortest."""
        shortest = np.zeros(1, np.int64)
        for n, level in self.levels.items():
            above = self.levels[n - 1].count if n > 1 else np.full(1, -1)
            shortest = np.where(level.count == above[level.suffix], shortest[level.suffix], n)
            longest = np.ones(len(level.count), bool)
            if n + 1 in self.levels:
                longer = self.levels[n + 1]
                longest[longer.suffix[longer.count == level.count[longer.suffix]]] = False
            yield n, level.end[longest], level.count[longest], shortest[longest]


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Cuts batches of (lang, text) into pieces of one block each; a block has rows of one task that follow each other."""
    task, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        _, offsets = _text.text_bytes(batch.column(1))
        place = (done + offsets[:-1] - offsets[0]) // most
        done += int(offsets[-1] - offsets[0])
        edges = np.r_[0, np.flatnonzero(np.diff(place)) + 1, batch.num_rows] if batch.num_rows else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield (task << 24) + int(place[a]), batch.slice(a, b - a)


def _langs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The number of each row's language, a hash for each language, their names."""
    coded = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = coded.dictionary_encode()
    data, offsets = _text.text_bytes(coded.dictionary)
    return coded.indices.to_numpy(), _text.segment_hash(data, offsets[:-1], offsets[1:]), coded.dictionary.to_pylist()


def _chunks(texts: pa.Array) -> Iterator[tuple[int, Stream]]:
    data, offsets = _text.text_bytes(texts)
    for lo, hi in _text.chunks(offsets):
        yield lo, stream(data, offsets[lo : hi + 1])


def _asked(batches: Iterator[pa.RecordBatch], ranges: int, most: int) -> Iterator[pa.RecordBatch]:
    """The distinct pair hashes of each block with their counts, one row for each range."""
    width = np.uint64(2**64 // ranges + 1)

    def close(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        owner = (keys // width).astype(np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])[: len(keys)]
        cut = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=False))
        arrays = [pa.array(np.full(len(cut), block)), pa.array(owner[first].astype(np.int32))]
        arrays += [pa.array([planes(x[a:b]) for a, b in cut], pa.binary()) for x in (keys, n.astype("<u4"))]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "range", "keys", "n"])

    open_, held = None, []
    for block, rows in _blocks(batches, most):
        if held and block != open_:
            yield close(open_, held)
            held = []
        lang, hashes, _ = _langs(rows.column(0))
        open_ = block
        held += [pair_keys(s, hashes[lang[lo:]]) for lo, s in _chunks(rows.column(1))]
    if held:
        yield close(open_, held)


def _often(group: pa.Table, least: int) -> pa.Table:
    """Sums one range's counts and tells each block, a bit a key, which occur ``least`` times."""
    keys = [from_planes(x.as_py(), "<u8") for x in group.column("keys")]
    counts = [from_planes(x.as_py(), "<u4") for x in group.column("n")]
    unique, which = np.unique(np.concatenate(keys), return_inverse=True)
    good = np.bincount(which, np.concatenate(counts), len(unique))[which] >= least
    ends = np.cumsum([0, *map(len, keys)])
    bits = [np.packbits(good[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table([group.column("block"), group.column("range"), pa.array(np.diff(ends).astype(np.int32)), pa.array(bits, pa.binary())], names=["block", "range", "size", "bits"])


def _texts_by_block(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for block, rows in _blocks(batches, most):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, block)), *rows.columns], names=["block", "lang", "text"])


def _phrases(s: Stream, ends: np.ndarray, n: int) -> pa.Array:
    """The ``n`` words that end at each of ``ends``, joined by a space."""
    columns = []
    for back in range(n - 1, -1, -1):
        start, end = s.start[ends - back], s.end[ends - back]
        size = end - start
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
        columns.append(pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(s.data[at]))))
    return columns[0] if n == 1 else pc.binary_join_element_wise(*columns, " ")


def _whole(rows: pa.Table) -> Stream:
    """One stream for all texts of a block."""
    data, offsets = _text.text_bytes(rows.column("text").combine_chunks())
    parts = []
    for lo, hi in _text.chunks(offsets):
        s = stream(data, offsets[lo : hi + 1])
        base = offsets[lo] - offsets[0]
        parts.append((s.data, s.start + base, s.end + base, s.hash, s.doc + lo, s.joined))
    return Stream(*map(np.concatenate, zip(*parts, strict=True)))


_COUNTED = "lang string, phrase string, shortest int, words int, n long"


def _substrings(texts: pa.Table, answers: pa.Table, longest: int) -> pa.Table:
    """All words of a block, and the states of its runs of frequent pairs: longest substring, length of the shortest, count."""
    fields = [("lang", pa.string()), ("phrase", pa.string()), ("shortest", pa.int32()), ("words", pa.int32()), ("n", pa.int64())]
    none = pa.table([pa.array([], t) for _, t in fields], names=[n for n, _ in fields])
    if not texts.num_rows:
        return none
    lang, hashes, names = _langs(texts.column("lang"))
    s = _whole(texts)
    if not len(s.start):
        return none
    answers = answers.sort_by("range")
    good = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n.as_py()) for b, n in zip(answers.column("bits"), answers.column("size"), strict=True)]
    good = np.concatenate(good).astype(bool) if good else np.zeros(0, bool)
    pairs, which = np.unique(pair_keys(s, hashes[lang]), return_inverse=True)
    if len(pairs) != len(good):
        raise ValueError("a block's documents have changed since its pairs were counted")
    own = lang[s.doc]
    with np.errstate(over="ignore"):
        _, first, word, count = np.unique(_text.mix(s.hash * _GOLD + hashes[own]), return_index=True, return_inverse=True, return_counts=True)
    linked = np.zeros(len(s.start), bool)
    linked[np.flatnonzero(s.joined)] = good[which]
    before = np.r_[False, linked[:-1]]
    index = np.arange(len(linked))
    reach = index - np.maximum.accumulate(np.where(before, -1, index))
    kept = np.flatnonzero(linked | before)
    out = [(first, 1, np.ones(len(first)), count)]
    for n, end, counts, shortest in Automaton(word[kept], reach[kept], longest).states():
        if n > 1:  # words are there already, also those outside the runs
            out.append((kept[end], n, np.maximum(shortest, 2), counts))
    tables = []
    for ends, n, shortest, counts in out:
        columns = [pa.array(names, pa.string()).take(pa.array(own[ends])), _phrases(s, ends, n), pa.array(shortest.astype(np.int32)), pa.array(np.full(len(ends), n, np.int32)), pa.array(counts.astype(np.int64))]
        tables.append(pa.table(columns, names=none.column_names))
    return pa.concat_tables(tables)


def phrase_counts(docs: DataFrame, least: int, longest: int, lang: str = "lang", text: str = "text", block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """lang, phrase, words, n: every word, and every phrase of up to ``longest`` words that occurs ``least`` times.

    Rarer phrases are left out; words are kept however rare, as their counts add up to the number of words.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    asked = rows.mapInArrow(partial(_asked, ranges=max(16, size // range_bytes), most=block_bytes), "block long, range int, keys binary, n binary")

    def often(group: pa.Table) -> pa.Table:
        return _often(group, least)

    answers = asked.groupBy("range").applyInArrow(often, "block long, range int, size int, bits binary")
    blocks = rows.mapInArrow(partial(_texts_by_block, most=block_bytes), "block long, lang string, text string")

    def substrings(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _substrings(left, right, longest)

    found = blocks.groupBy("block").cogroup(stored(answers).groupBy("block")).applyInArrow(substrings, _COUNTED)
    length = F.explode(F.sequence("shortest", "words")).alias("length")
    suffix = F.when(F.col("length") == F.col("words"), F.col("phrase")).otherwise(F.array_join(F.slice(F.split("phrase", " "), -F.col("length"), F.col("length")), " "))
    each = found.select("lang", "phrase", "words", "n", length).select("lang", suffix.alias("phrase"), F.col("length").alias("words"), "n")
    counted = each.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("words") == 1) | (F.col("n") >= least))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang: str = "lang", text: str = "text",
                 block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases of two words or more.

    Words are lower-cased (A-Z) runs without space or tab, in pieces between ``.,;:!?`` and line
    ends. Of a phrase that occurs a times, each cut into a first part (l times) and a rest (r
    times) has the score floor(1000 a n / (l r)), n being the language's words; the lowest counts,
    of equals the one after the fewest words. Phrases that occur only within one longer phrase of
    at most ``longest`` words are dropped. Counts are exact, and so is the arithmetic (38 digits).

    A null language is ``und``; null and empty texts have no words; a repeated row counts again; an
    empty table gives no rows; other columns are ignored; texts may be of any length. Words of one
    block are told apart by 64-bit hashes (two of a block's million share one with a chance of
    3e-8). ``docs`` is read three times and must give the same rows in the same tasks each time, as
    a table that is scanned does; if it doesn't, ValueError is raised.
    """
    counts = stored(phrase_counts(docs, least, longest, lang, text, block_bytes, range_bytes))
    totals = durable(counts.filter("words = 1").groupBy("lang").agg(F.sum("n").alias("total")))
    frequent = counts.filter(F.col("n") >= least)
    split = F.split("phrase", " ")
    cuts = frequent.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), split.alias("w"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    part = frequent.select("lang", F.col("phrase").alias("part"), "n")
    sides = cuts.join(part.withColumnsRenamed({"part": "left", "n": "l"}), ["lang", "left"]).join(part.withColumnsRenamed({"part": "right", "n": "r"}), ["lang", "right"])
    scored = stored(sides.select("lang", "phrase", "words", "left", "right", "k", "a", "l", "r"))

    # A part of one word less that occurs as often as the whole lies within it.
    inner = scored.filter((F.col("words") > 2) & (F.col("k") == F.col("words") - 1) & (F.col("l") == F.col("a"))).select("lang", F.col("left").alias("phrase"))
    inner = inner.unionByName(scored.filter((F.col("words") > 2) & (F.col("k") == 1) & (F.col("r") == F.col("a"))).select("lang", F.col("right").alias("phrase")))
    exact = "1000bd * cast(a as decimal(18,0)) * cast(total as decimal(16,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    value = scored.join(if_small(totals), "lang").withColumn("score", F.expr(exact))
    worst = value.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = worst.join(inner, ["lang", "phrase"], "left_anti")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
