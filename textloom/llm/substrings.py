"""Repeated passages: shared k-mer seeds, collinear chains, alignment.

Seeds are the minimizers of each text's word k-mers: of every ``window`` successive k-mers the one
with the least hash. Texts that share a run of k + window - 1 words share a seed in it. Each seed is
matched with its first occurrence in the corpus only (least doc_id, then position), so the matches
grow with the corpus and not with the square of a passage's frequency. The matches between two
documents are chained in order with gap costs, by a Fenwick tree of prefix maxima; chains of two seeds
or more are aligned word by word, also beyond their ends, and kept if they are long and similar
enough.

Where parts of a passage stood in several earlier documents, its seeds' first occurrences are not
in one of them. So each window of ``min_words`` words whose seeds are all repeated, and which is in
no exact run of seeds with one document, is a key of its own, with its own first occurrence: every
exact run of ``min_words`` words is matched with a document that holds the whole of it (but for about
one in a million, see ``_dealt``).

For fuzzy passages, turns do the same. Where successive matches of a text lead to two documents, the two
and how they are offset are a key, whatever words were edited; its first holder has the parts in the same
order. The matches around a turn that both texts have with the same places of the same documents are
matches between the two texts, and are chained as others are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.llm import _text
from textloom.llm._spark import durable, if_small

#: WINDOW is at most K, so that the seeds of a shared run leave no word between them out.
K, WINDOW = 5, 4
#: In an exact run, words between the anchors that are chained.
STRIDE = 16
#: Bytes of text for each range of keys; a task holds one range.
RANGE_BYTES = 8_000_000
#: Seeds from which on a task deals out what it holds.
MOST_DEALT = 500_000
MIN_WORDS = 50
MIN_IDENTITY = 0.8
#: A chain is cut where neighbouring seeds are further apart than this, in words.
MAX_GAP = 40
#: Words between two matches that make a turn, words around it whose matches count, steps of its offset.
NEAR, AROUND, TURN_STEP = 64, 160, 16
#: Matches with a document from which on it counts as chained with the text.
CHAINED = 5
#: Turns with the matches around them (some 3 kB each) up to which they are broadcast.
LEADING_ROWS = 10_000
#: What each word between two seeds costs a chain; a seed gains K.
GAP_COST = 0.1
#: Words around a chain that alignment may take in.
MARGIN = 64
#: Chains whose windows are cut out of one copy of a text.
MOST_CHAINS = 1000
#: Alignment goes on beyond a chain until it is this much below its best (match 2, mismatch -1).
DROP = 16


def minimizers(hashes: np.ndarray, doc: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word index of the seeds; ``hashes`` and ``doc`` are of words in order."""
    grams, at = _text.windows(hashes, doc, k)
    n = len(grams)
    if n < window:
        return grams[:0], at[:0]
    full = n - window + 1
    least, where = grams[:full], np.arange(full)
    for j in range(1, window):
        other = grams[j : j + full]
        where = np.where(other < least, np.arange(j, j + full), where)
        least = np.minimum(least, other)
    own = doc[at]
    chosen = np.zeros(n, bool)
    chosen[where[own[:full] == own[window - 1 :]]] = True
    return grams[chosen], at[chosen]


_CODEC = pa.Codec("zstd", 1)


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on, compressed after their size; ids (int64) as differences."""
    if values.dtype == np.int64:
        values = np.diff(values, prepend=0)
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    return len(raw).to_bytes(4, "little") + _CODEC.compress(raw, asbytes=True)


def _values(planes: pa.ChunkedArray, kind: type, width: int = 0) -> np.ndarray:
    """The values of all rows of a column of planes; with ``width`` they have so many bytes, padded with zeros."""
    size = np.dtype(kind).itemsize
    parts = [np.zeros(0, kind)]
    for p in planes:
        closed = p.as_buffer()
        raw = np.frombuffer(_CODEC.decompress(closed[4:], int.from_bytes(closed[:4].to_pybytes(), "little")), np.uint8).reshape(width or size, -1)
        own = np.zeros((raw.shape[1], size), np.uint8)
        own[:, : width or size] = raw.T
        own = own.view(kind).ravel()
        parts.append(np.cumsum(own) if kind is np.int64 else own)
    return np.concatenate(parts)


def _rows_by_part(part: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """One row for each part, with the planes of its values; ``part`` is sorted."""
    bounds = _bounds(part[1:] != part[:-1]) if len(part) else np.zeros(1, np.int64)
    kept = {name: pa.array([_planes(c[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for name, c in columns.items()}
    return pa.table({"part": part[bounds[:-1]].astype(np.int32), **kept})


def _dealt(keys: np.ndarray, ids: np.ndarray, at: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """One row for each range of keys, with the upper 40 bits of its keys.

    The range tells the rest apart: it has about a million keys, however large the corpus is, so
    one in a million of them takes another key for its own, and alignment looks at the words anyway.
    """
    part = (keys % np.uint64(ranges)).astype(np.uint16 if ranges < 2**16 else np.int64)
    order = np.argsort(part, kind="stable")
    rows = _rows_by_part(part[order], keys=keys[order].view(np.uint8).reshape(-1, 8)[:, 3:], ids=ids[order].astype(np.int64), at=at[order].astype(np.int32))
    yield from rows.to_batches()


_GOLD = np.uint64(0x9E3779B97F4A7C15)
DEALT = "part int, keys binary, ids binary, at binary"
#: Matches as planes, by a hash of doc_id; and as lists by document.
MATCHES = "part int, doc_id binary, at binary, other_id binary, other_at binary"
LISTS = "doc_id long, at array<int>, other_id array<long>, other_at array<int>"


@_text.frugal
def _seed_rows(batches: Iterator[pa.RecordBatch], k: int, window: int, ranges: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _text.text_bytes(batch.column(1))
        ids = batch.column(0).to_numpy()
        found: list[tuple[np.ndarray, ...]] = []
        for lo, hi in _text.chunks(offsets):
            w = _text.words(data, offsets[lo : hi + 1])
            seeds, at = minimizers(w.hash, w.doc, k, window)
            heads = np.searchsorted(w.doc, np.arange(hi - lo))
            doc = w.doc[at]
            # a seed that a text repeats stands for itself and for its n-th turn, so that periodic
            # texts match period by period
            with np.errstate(over="ignore"):
                own = _text.mix(seeds + doc.astype(np.uint64) * _GOLD)
            order = np.argsort(own, kind="stable")
            new = np.ones(len(own), bool)
            new[1:] = own[order][1:] != own[order][:-1]
            turn = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
            later, turn = order[~new], turn[~new]
            with np.errstate(over="ignore"):
                seeds = np.r_[seeds, _text.mix(seeds[later] + turn.astype(np.uint64))]
            at, doc = np.r_[at, at[later]], np.r_[doc, doc[later]]
            found.append((seeds, ids[lo:hi][doc], (at - heads[doc]).astype(np.int32)))
            # what many chunks have for a range goes out as one row
            if sum(len(f[0]) for f in found) > MOST_DEALT:
                yield from _dealt(*map(np.concatenate, zip(*found, strict=True)), ranges)
                found = []
        if found:
            yield from _dealt(*map(np.concatenate, zip(*found, strict=True)), ranges)


def _first_rows(table: pa.Table, ranges: int) -> pa.Table:
    """doc_id, at, other_id, other_at of the keys that two documents have, packed by documents."""
    keys, ids, at = _values(table.column("keys"), np.uint64, 5), _values(table.column("ids"), np.int64), _values(table.column("at"), np.int32)
    # most keys stand alone and need no order by document
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    order = order[np.unique(np.r_[same, same + 1])]
    order = order[np.lexsort((at[order], ids[order], keys[order]))]
    keys, ids, at = keys[order], ids[order], at[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[heads, len(keys)])
    first = np.repeat(heads, sizes)
    kept = np.repeat(ids[heads] != ids[heads + sizes - 1], sizes)
    ids, at, other, other_at = ids[kept], at[kept], ids[first][kept], at[first][kept]
    part = (_text.mix(ids) % np.uint64(ranges)).astype(np.int64)
    order = np.lexsort((at, ids, part))
    return _rows_by_part(part[order], doc_id=ids[order], at=at[order], other_id=other[order], other_at=other_at[order])


def _list_rows(table: pa.Table) -> pa.Table:
    """The matches of each document."""
    ids, at, other, other_at = (_values(table.column(c), k) for c, k in (("doc_id", np.int64), ("at", np.int32), ("other_id", np.int64), ("other_at", np.int32)))
    order = np.lexsort((at, ids))
    ids = ids[order]
    bounds = _bounds(ids[1:] != ids[:-1]) if len(ids) else np.zeros(1, np.int64)
    lists = (pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(c[order])) for c in (at, other, other_at))
    return pa.table(dict(zip(("doc_id", "at", "other_id", "other_at"), (ids[bounds[:-1]], *lists), strict=True)))


def first_occurrences(dealt: DataFrame, ranges: int) -> DataFrame:
    """Each document's keys that another one has, and their first occurrences, as ``LISTS``.

    The first document's own rows are among them. Keys travel once, as packed arrays by range, and so do
    the matches, by document.
    """

    def packed(table: pa.Table) -> pa.Table:
        return _first_rows(table, ranges)

    matches = dealt.groupBy("part").applyInArrow(packed, MATCHES)
    # what is done with the lists takes far longer than their few bytes tell, so their number of tasks is given
    return matches.repartition(ranges, "part").groupBy("part").applyInArrow(_list_rows, LISTS)


def _bounds(new: np.ndarray) -> np.ndarray:
    """Where stretches of a list of items begin, and its end; ``new`` tells for each item but the first."""
    edges = np.ones(len(new) + 2, bool)
    edges[1:-1] = new
    return np.flatnonzero(edges)


def _diagonals(at: np.ndarray, other: np.ndarray, other_at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the anchors of a document, and where in it each unbroken exact run begins (and the end)."""
    shift = at.astype(np.int64) - other_at
    order = np.lexsort((at, shift, other))
    o, s, x = other[order], shift[order], at[order]
    new = (o[1:] != o[:-1]) | (s[1:] != s[:-1]) | (x[1:] - x[:-1] > length)
    return order, _bounds(new) if len(at) else np.zeros(1, np.int64)


def chain(anchors: list[tuple[int, int]], k: int = K, gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[list[tuple[int, int]]]:
    """Collinear chains of (at, other_at), best first; each anchor is in one chain at most."""
    anchors = sorted(set(anchors), key=lambda p: (p[1], -p[0]))
    places = sorted({p[0] for p in anchors})
    rank = {x: i + 1 for i, x in enumerate(places)}
    size = len(places)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)
    score, back = [0.0] * len(anchors), [-1] * len(anchors)
    for i, (x, y) in enumerate(anchors):
        best, j = (float("-inf"), -1), rank[x] - 1
        while j > 0:  # the best chain that ends before x; anchors come by other_at, so also before y
            best = max(best, tree[j])
            j -= j & -j
        gain = best[0] - gap_cost * (x + y)
        prior = best[1]
        if prior >= 0 and anchors[prior][1] == y:
            prior = -1
        if prior >= 0 and gain > 0:
            # seeds that overlap count their new words only
            score[i], back[i] = gain + min(k, x - anchors[prior][0], y - anchors[prior][1]), prior
        else:
            score[i] = k
        entry, j = (score[i] + gap_cost * (x + y), i), rank[x]
        while j <= size:
            if entry > tree[j]:
                tree[j] = entry
            j += j & -j
    used, out = [False] * len(anchors), []
    for end in sorted(range(len(anchors)), key=lambda i: -score[i]):
        links, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            links.append(anchors[i])
            i = back[i]
        links.reverse()
        part: list[tuple[int, int]] = []
        for p in links:
            if part and max(p[0] - part[-1][0], p[1] - part[-1][1]) > max_gap:
                out.append(part)
                part = []
            part.append(p)
        if part:
            out.append(part)
    return out


def _lists(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_id, at, other_id and other_at of each row."""
    at, other, other_at = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "other_id", "other_at"))
    bounds = np.r_[0, np.cumsum(batch.column("at").value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    for i, doc in enumerate(batch.column("doc_id").to_pylist()):
        cut = slice(bounds[i], bounds[i + 1])
        yield doc, at[cut], other[cut], other_at[cut]


def _unsettled(at: np.ndarray, runs: list[tuple[int, int]], k: int, window: int, min_words: int) -> tuple[list[int], list[int]]:
    """First and last start of the windows of ``min_words`` words that may stand elsewhere but are in no exact run.

    All seeds in such a window are repeated, so it is in a stretch of them; ``runs`` are the exact
    runs (start, end) with single documents.
    """
    at = np.sort(at).astype(np.int64)
    edges = _bounds(at[1:] - at[:-1] > window)
    low, high = np.maximum(0, at[edges[:-1]] - window + 1), at[edges[1:] - 1] + k + window - 1
    long = high - low >= min_words
    if not long.any():
        return [], []
    count = np.zeros(int(high.max()) + 2, np.int64)
    np.add.at(count, low[long], 1)
    np.add.at(count, high[long] - min_words + 1, -1)
    settled = np.zeros(len(count), np.int64)
    for start, end in runs:
        settled[start] += 1
        settled[end - min_words + 1] -= 1
    left = np.r_[False, (np.cumsum(count) > 0) & (np.cumsum(settled) == 0), False]
    edges = np.flatnonzero(left[1:] != left[:-1])
    return edges[::2].tolist(), (edges[1::2] - 1).tolist()


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.int32())
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), kind, kind), strict=True)], names=["doc_id", "other_id", "at", "other_at"])


def _turns(at: np.ndarray, other: np.ndarray, other_at: np.ndarray, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the places where successive matches lead to two documents, the word there, and the two (-1 for one with few matches).

    A key is of the two documents and of their offset in steps of TURN_STEP, rounded down and up, so
    that words left out or put in don't part two texts. A turn within a stretch that one document
    covers densely (such are aligned anyway), or with hardly a match around it, isn't one.
    """
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    order = np.lexsort((other_at, other, at))  # whatever order they came in
    x, o, shift = at[order].astype(np.int64), other[order], at[order].astype(np.int64) - other_at[order]
    here = np.flatnonzero((o[1:] != o[:-1]) & (x[1:] - x[:-1] <= NEAR))
    here = here[np.searchsorted(x, x[here] + min_words // 2, "right") - np.searchsorted(x, x[here] - min_words // 2) >= 3]
    if not len(here):
        return (np.zeros(0, np.int64),) * 4
    order = np.argsort(o, kind="stable")
    y, known = x[order], o[order]
    edges = _bounds((known[1:] != known[:-1]) | (y[1:] - y[:-1] > MAX_GAP))
    begin, end, sizes = y[edges[:-1]], y[edges[1:] - 1], edges[1:] - edges[:-1]
    long = (end + k - begin >= min_words) & (sizes * TURN_STEP >= end - begin)
    # covered: more dense stretches have begun at a word than have ended
    starts, stops = np.sort(begin[long]), np.sort(end[long])
    here = here[np.searchsorted(starts, x[here], "right") == np.searchsorted(stops, x[here], "right")]
    if not len(here):
        return (np.zeros(0, np.int64),) * 4
    step = np.floor((shift[here + 1] - shift[here]) / TURN_STEP).astype(np.int64)
    left, right = o[here], o[here + 1]
    with np.errstate(over="ignore"):
        pair = _text.mix(left.astype(np.uint64) * _GOLD + right.astype(np.uint64))
        keys = _text.mix(np.concatenate([pair + step.astype(np.uint64), pair + (step + 1).astype(np.uint64)]))
    chained = [np.where(np.searchsorted(known, side, "right") - np.searchsorted(known, side) >= CHAINED, side, -1) for side in (left, right)]
    return keys.view(np.int64), np.tile(x[here], 2), np.tile(chained[0], 2), np.tile(chained[1], 2)


@_text.frugal
def _turn_rows(batches: Iterator[pa.RecordBatch], k: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """The keys of each document's turns, each at its first place."""
    for batch in batches:
        found: list[tuple[np.ndarray, ...]] = []
        for doc, at, other, other_at in _lists(batch):
            key, place, before, after = _turns(at, other, other_at, k, min_words)
            key, first = np.unique(key, return_index=True)
            found.append((key, np.full(len(key), doc, np.int64), place[first].astype(np.int32), before[first], after[first]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["key", "doc_id", "place", "before", "after"])


@_text.frugal
def _around_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches around each wanted turn: (key, doc_id, leads, at, other_id, other_at)."""
    for batch in batches:
        rows: list[tuple] = []
        for (doc, at, other, other_at), wanted in zip(_lists(batch), batch.column("wanted").to_pylist(), strict=True):
            order = np.argsort(at, kind="stable")
            at, other, other_at = at[order], other[order], other_at[order]
            for turn in wanted:
                lo, hi = np.searchsorted(at, [turn["place"] - AROUND, turn["place"] + AROUND])
                rows.append((turn["key"], doc, turn["leads"], at[lo:hi], other[lo:hi], other_at[lo:hi]))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "doc_id", "leads", "at", "other", "other_at"])


@_text.frugal
def _turn_chains(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Chains of two texts with the same turn, from the matches that both have with the same places."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            first: dict[tuple[int, int], list[int]] = {}
            for y, o, z in zip(r["first_at"], r["first_other"], r["first_other_at"], strict=True):
                first.setdefault((o, z), []).append(y)
            links = [(x, y) for x, o, z in zip(r["at"], r["other"], r["other_at"], strict=True) for y in first.get((o, z), ())[:1]]
            for part in chain(links, k):
                # within a run the words between two anchors are the same, so one in STRIDE words will do
                ends = [i in (0, len(part) - 1) or part[i - 1][0] - part[i - 1][1] != p[0] - p[1] or part[i + 1][0] - part[i + 1][1] != p[0] - p[1] or p[0] - part[i - 1][0] > k or part[i + 1][0] - p[0] > k or p[0] // STRIDE != part[i - 1][0] // STRIDE for i, p in enumerate(part)]
                if len(part) > 1:
                    rows.append((r["doc_id"], r["other_id"], [p[0] for p, e in zip(part, ends, strict=True) if e], [p[1] for p, e in zip(part, ends, strict=True) if e]))
        yield _batch_of(rows)


def chains_by_turns(lists: DataFrame, k: int, min_words: int) -> DataFrame:
    """Chains (as ``CHAINS``) between each text and the first text that has one of its turns.

    ``lists`` are as ``LISTS``. Keys are reduced to their first holder before anything else moves; of
    the turns that lead a stretch of words to one text, one sends the matches around it, and so
    does the first holder for each turn that is asked for.
    """
    turns = durable(lists.mapInArrow(partial(_turn_rows, k=k, min_words=min_words), "key long, doc_id long, place int, before long, after long"))
    first = F.min(F.struct("doc_id", "place"))
    shared = turns.groupBy("key").agg(first.alias("first"), F.max("doc_id").alias("_last")).filter(F.col("first.doc_id") != F.col("_last")).drop("_last")
    # if one of the two is the holder itself and chained with the text, its alignment goes on past the turn
    asked = turns.join(shared, "key").filter(~F.col("first.doc_id").isin(F.col("doc_id"), F.col("before"), F.col("after")))
    asked = durable(asked.groupBy(F.col("doc_id").alias("_doc"), F.col("first.doc_id").alias("_first"), F.floor(F.col("place") / AROUND).alias("_at")).agg(F.min(F.struct("key", "place", "first")).alias("t")).select("t.key", F.col("_doc").alias("doc_id"), "t.place", "t.first"))
    leads = asked.groupBy("key").agg(F.first("first").alias("first")).select("key", "first.doc_id", "first.place", F.lit(True).alias("leads"))
    wanted = asked.select("key", "doc_id", "place", F.lit(False).alias("leads")).unionByName(leads)
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "place", "leads")).alias("wanted"))
    around = durable(lists.join(wanted, "doc_id").mapInArrow(_around_rows, "key long, doc_id long, leads boolean, at array<int>, other array<long>, other_at array<int>"))
    names = {"doc_id": "other_id", "at": "first_at", "other": "first_other", "other_at": "first_other_at"}
    leading = if_small(around.filter("leads").drop("leads").withColumnsRenamed(names), LEADING_ROWS)
    pairs = around.filter("NOT leads").drop("leads").join(leading, "key")
    return pairs.mapInArrow(partial(_turn_chains, k=k), CHAINS).distinct()


CHAINS = "doc_id long, other_id long, at array<int>, other_at array<int>"


@_text.frugal
def _chain_rows(batches: Iterator[pa.RecordBatch], k: int, window: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """The chains of each document; a row without other_id has the starts of its unsettled windows."""
    for batch in batches:
        rows = []
        for doc, at, other, other_at in _lists(batch):
            mine = other != doc
            x, o, y = at[mine], other[mine], other_at[mine]
            order, bounds = _diagonals(x, o, y, k)
            x, o, y = x[order], o[order], y[order]
            heads, tails = bounds[:-1], bounds[1:] - 1
            runs = [(s, e) for s, e in zip(x[heads].tolist(), (x[tails] + k).tolist(), strict=True) if e - s >= min_words]
            first, last = _unsettled(at, runs, k, window, min_words)
            if first:
                rows.append((doc, None, first, last))
            # one seed alone is mostly chance: with another document a text must share two
            if len(o) < 2:
                continue
            same = o[1:] == o[:-1]
            # within a run the words between two anchors are the same, so one in STRIDE words will do
            strides = x // STRIDE
            kept = np.ones(len(x), bool)
            kept[1:] = strides[1:] != strides[:-1]
            kept[heads] = kept[tails] = True
            kept[1:-1] &= same[1:] | same[:-1]
            kept[0] &= same[0]
            kept[-1] &= same[-1]
            x, o, y = x[kept], o[kept], y[kept]
            if not len(o):
                continue
            ends = _bounds(o[1:] != o[:-1])
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                for links in chain(list(zip(x[lo:hi].tolist(), y[lo:hi].tolist(), strict=True)), k):
                    if len(links) > 1:
                        rows.append((doc, int(o[lo]), [p[0] for p in links], [p[1] for p in links]))
        yield _batch_of(rows)


def _word_lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    data, offsets = _text.text_bytes(column)
    for lo, hi in _text.chunks(offsets):
        w = _text.words(data, offsets[lo : hi + 1])
        yield from np.split(w.hash, np.searchsorted(w.doc, np.arange(1, hi - lo)))


@_text.frugal
def _whole_rows(batches: Iterator[pa.RecordBatch], min_words: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Keys of the unsettled windows."""
    for batch in batches:
        keys, ids, at = [], [], []
        for doc, known, firsts, lasts in zip(batch.column("doc_id").to_pylist(), _word_lists(batch.column("text")), batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True):
            for first, last in zip(firsts, lasts, strict=True):
                part = known[first : last + min_words]
                grams, where = _text.windows(part, np.zeros(len(part), np.int64), min_words)
                keys.append(grams)
                at.append(where + first)
                ids.append(np.full(len(grams), doc, np.int64))
        if keys:
            yield from _dealt(np.concatenate(keys), np.concatenate(ids), np.concatenate(at), ranges)


@_text.frugal
def _run_rows(batches: Iterator[pa.RecordBatch], k: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """A chain for each run of windows on one diagonal."""
    for batch in batches:
        rows = []
        for doc, at, other, other_at in _lists(batch):
            mine = other != doc
            at, other, other_at = at[mine], other[mine], other_at[mine]
            order, bounds = _diagonals(at, other, other_at, min_words)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                start, end, shift = int(at[order[lo]]), int(at[order[hi - 1]]) + min_words - k, int(other_at[order[lo]]) - int(at[order[lo]])
                links = sorted({*range(start, end, STRIDE), end})
                rows.append((doc, int(other[order[lo]]), links, [p + shift for p in links]))
        yield _batch_of(rows)


@_text.frugal
def _closed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text compressed, with its size; Spark's own codec leaves a text half as large again."""
    for batch in batches:
        data, offsets = _text.text_bytes(batch.column("text"))
        closed = [_CODEC.compress(data[lo:hi], asbytes=True) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(closed, pa.binary())], names=["doc_id", "size", "closed"])


def _opened(sizes: np.ndarray, closed: pa.Array) -> Iterator[pa.Array]:
    """The texts again, some at a time."""
    for lo, hi in _text.chunks(np.r_[0, np.cumsum(sizes)]):
        yield pa.array([_CODEC.decompress(closed[i].as_buffer(), int(sizes[i]), asbytes=True) for i in range(lo, hi)], pa.large_binary())


@_text.frugal
def _window_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Cuts the words around each chain out of its texts, as 32-bit hashes."""
    for batch in batches:
        wanted = batch.column("wanted")
        chains, side, low, high = wanted.flatten().flatten()
        texts = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
        lists = enumerate(known for part in _opened(batch.column("size").to_numpy(), batch.column("closed")) for known in _word_lists(part))
        row, known = -1, np.zeros(0, np.uint32)
        cut, begins = [], []
        for text, x, y in zip(texts.tolist(), low.to_pylist(), high.to_pylist(), strict=True):
            while row < text:
                row, known = next(lists)
                known = known.astype(np.uint32) if row == text else known
            begin = max(0, x - MARGIN)
            begins.append(begin)
            cut.append(known[begin : y + k + MARGIN].tobytes())
        yield pa.RecordBatch.from_arrays([chains, side, pa.array(begins, pa.int32()), pa.array(cut, pa.binary())], names=["chain", "side", "begin", "words"])


def _extend(same: np.ndarray) -> int:
    """How many words to go on from a chain's end."""
    score = top = best = 0
    for i, equal in enumerate(same.tolist(), 1):
        score += 2 if equal else -1
        if score > top:
            top, best = score, i
        elif top - score > DROP:
            break
    return best


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The most words that two stretches have in common, in order."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and (same := int((a == b).sum())) >= len(a) - 1:
        return same
    # a bit for each word of b; those that are off count what is in common so far
    places: dict[int, int] = {}
    for j, y in enumerate(b.tolist()):
        places[y] = places.get(y, 0) | 1 << j
    whole = open_ = (1 << len(b)) - 1
    for x in a.tolist():
        hit = open_ & places.get(x, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & whole
    return len(b) - open_.bit_count()


def _extend_with_gaps(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many words of each side to go on from a chain's end, if words may be left out or put in."""
    columns = np.arange(len(b) + 1)
    row, best, where = -columns, 0, (0, 0)
    for i, x in enumerate(a, 1):
        new = row - 1
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == x, 2, -1))
        row = np.maximum.accumulate(new + columns) - columns
        j = int(np.argmax(row))
        if row[j] > best:
            best, where = int(row[j]), (i, j)
        elif row[j] < best - DROP:
            break
    return where


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two lists have in common, in any order."""
    return (Counter(a.tolist()) & Counter(b.tolist())).total()


def align(a: np.ndarray, b: np.ndarray, at: list[int], other_at: list[int], k: int = K, gaps: bool = False) -> tuple[int, int, int, int, int]:
    """start, end, other_start, other_end and matched words of a chain between two word lists.

    Beyond its ends a chain goes on word by word, with ``gaps`` also over words that one side lacks. A
    seed that doesn't stand where it should (its hash was another's) is passed over as a gap.
    """
    if gaps:
        before, other_before = _extend_with_gaps(a[: at[0]][-MARGIN:][::-1], b[: other_at[0]][-MARGIN:][::-1])
    else:
        left = min(at[0], other_at[0])
        before = other_before = _extend((a[at[0] - left : at[0]] == b[other_at[0] - left : other_at[0]])[::-1])
    x, y = at[0] - before, other_at[0] - other_before
    start, other_start, matched = x, y, 0
    places, other_places = np.asarray(at), np.asarray(other_at)
    if before == other_before and (places - other_places == places[0] - other_places[0]).all():
        # on one diagonal: words at the same distance, and between two seeds the most in common
        x, y = at[-1] + k, other_at[-1] + k
        same = a[start:x] == b[other_start:y]
        missed = np.flatnonzero(~same)
        matched = len(same) - len(missed)
        if len(missed) > 1:
            seeds = places - start
            for i in np.flatnonzero(np.bincount(np.searchsorted(seeds, missed, "right")) > 1).tolist():
                lo, hi = int(seeds[i - 1]) + k if i else 0, int(seeds[i]) if i < len(seeds) else len(same)
                if hi > lo:
                    matched += _common(a[start + lo : start + hi], b[other_start + lo : other_start + hi]) - int(same[lo:hi].sum())
        at = other_at = []
    for p, q in zip(at, other_at, strict=True):
        shift = max(0, x - p, y - q)  # the words that seeds before it have already
        if shift >= k:
            continue
        p, q, n = p + shift, q + shift, k - shift
        matched += _common(a[x:p], b[y:q])
        matched += int((a[p : p + n] == b[q : q + n]).sum()) if len(a[p : p + n]) == len(b[q : q + n]) else 0
        x, y = p + n, q + n
    if gaps:
        after, other_after = _extend_with_gaps(a[x : x + MARGIN], b[y : y + MARGIN])
    else:
        room = max(0, min(len(a) - x, len(b) - y))
        after = other_after = _extend(a[x : x + room] == b[y : y + room])
    matched += _common(a[x : x + after], b[y : y + other_after])
    return start, x + after, other_start, y + other_after, matched


@_text.frugal
def _align_rows(batches: Iterator[pa.RecordBatch], k: int, min_words: int, min_identity: float) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "other_id", "start", "end", "other_start", "other_end", "matched", "identity"]
    kinds = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.float64()]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["words"] is None or r["other_words"] is None:
                continue
            a, b = np.frombuffer(r["words"], np.uint32), np.frombuffer(r["other_words"], np.uint32)
            at, other_at = [p - r["begin"] for p in r["at"]], [p - r["other_begin"] for p in r["other_at"]]
            if at[-1] + k > len(a) or other_at[-1] + k > len(b):
                continue  # a text of another row with the same id
            for gaps in (False, True):
                start, end, other_start, other_end, matched = align(a, b, at, other_at, k, gaps)
                identity = matched / max(1, end - start, other_end - other_start)
                if min(end - start, other_end - other_start) >= min_words and identity >= min_identity:
                    rows.append((r["doc_id"], r["other_id"], start + r["begin"], end + r["begin"], other_start + r["other_begin"], other_end + r["other_begin"], matched, identity))
                    break
                if not gaps and _shared(a, b) < min_identity * min_words:
                    break  # too few words in common, however they are aligned
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY
) -> DataFrame:
    """doc_id, other_id, start, end, other_start, other_end, matched, identity: one row per repeated passage.

    Words ``start`` to ``end`` (from 0, end excluded) of doc_id repeat those of other_id, which has
    the smaller id; ``matched`` of them are the same, in order, in lower case. Whole copies are
    passages too. Null and empty texts and rows with a null id have none; rows that share an id
    are one document, whose passages count from the row they are in; an empty table gives no rows;
    other columns are ignored. A text is never cut short; its words go through memory once.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 8 + size // RANGE_BYTES
    lists = durable(first_occurrences(source.mapInArrow(partial(_seed_rows, k=k, window=window, ranges=ranges), DEALT), ranges))
    fuzzy = durable(lists.mapInArrow(partial(_chain_rows, k=k, window=window, min_words=min_words), CHAINS))
    unsettled = fuzzy.filter("other_id IS NULL").select("doc_id", F.col("at").alias("first"), F.col("other_at").alias("last"))
    whole = if_small(unsettled).join(source, "doc_id").mapInArrow(partial(_whole_rows, min_words=min_words, ranges=ranges), DEALT)
    exact = first_occurrences(whole, ranges).mapInArrow(partial(_run_rows, k=k, min_words=min_words), CHAINS)
    name = F.struct("doc_id", "other_id", F.col("at")[0].alias("x"), F.col("other_at")[0].alias("y"), F.element_at("at", -1).alias("z"), F.element_at("other_at", -1).alias("w"))
    chains = durable(fuzzy.filter("other_id IS NOT NULL").unionByName(exact).unionByName(chains_by_turns(lists, k, min_words)).select(name.alias("chain"), "at", "other_at"))

    ends = lambda c: [F.element_at(c, 1).alias("low"), F.element_at(c, -1).alias("high")]
    sides = chains.select("chain", F.col("chain.doc_id").alias("doc_id"), F.lit(0).alias("side"), *ends("at")).unionByName(
        chains.select("chain", F.col("chain.other_id").alias("doc_id"), F.lit(1).alias("side"), *ends("other_at"))
    )
    # a text goes out once for all its chains, or once for each MOST_CHAINS of them
    many = if_small(durable(sides.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / MOST_CHAINS).cast("int").alias("lots")).filter("lots > 1")))
    lots = F.coalesce("lots", F.lit(1))
    listed_sides = sides.join(many, "doc_id", "left").withColumn("lot", F.pmod(F.xxhash64("chain"), lots).cast("int"))
    listed_sides = listed_sides.groupBy("doc_id", "lot").agg(F.collect_list(F.struct("chain", "side", "low", "high")).alias("wanted"))
    closed = source.mapInArrow(_closed_rows, "doc_id long, size long, closed binary")
    texts = closed.join(many, "doc_id", "left").select("doc_id", "size", "closed", F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot"))
    windows = listed_sides.join(texts, ["doc_id", "lot"]).select("wanted", "size", "closed")
    chain_type = "struct<doc_id:long,other_id:long,x:int,y:int,z:int,w:int>"
    windows = windows.mapInArrow(partial(_window_rows, k=k), f"chain {chain_type}, side int, begin int, words binary")
    on = lambda side, c: F.first(F.when(F.col("side") == side, F.col(c)), ignorenulls=True)
    pairs = windows.groupBy("chain").agg(on(0, "begin").alias("begin"), on(0, "words").alias("words"), on(1, "begin").alias("other_begin"), on(1, "words").alias("other_words"))
    given = pairs.join(chains, "chain").select("chain.doc_id", "chain.other_id", "at", "other_at", "begin", "words", "other_begin", "other_words")
    run = partial(_align_rows, k=k, min_words=min_words, min_identity=min_identity)
    aligned = given.mapInArrow(run, "doc_id long, other_id long, start int, end int, other_start int, other_end int, matched int, identity double")
    return aligned.distinct()


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``, which are sorted."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    w = _text.words(raw, np.array([0, len(raw)]), hashed=False)
    kept, at = [], 0
    for start, end in spans:
        start, end = min(start, len(w.start)), min(end, len(w.start))
        begin = int(w.start[start]) if start < len(w.start) else len(raw)
        kept.append(raw[at : max(at, begin)].tobytes())
        at = max(at, int(w.start[end]) if end < len(w.start) else len(raw))
    return (b"".join(kept) + raw[at:].tobytes()).decode().strip(" \t\n\r\v\f")


@F.arrow_udf(StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without their spans; null where there are none."""
    return pa.array([cut_words(t.as_py(), [(x["start"], x["end"]) for x in s.as_py()]) if s.is_valid else None for t, s in zip(texts, spans, strict=True)], pa.string())


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None, **settings) -> DataFrame:
    """``docs`` with each repeated passage cut from all documents but its first.

    ``length`` names a column that holds the text's length in characters and is to follow it. A document of which nothing is left is dropped; one without a repeated passage stays as it is.
    Other columns stay as they are, whatever their names.
    """
    found = repeated_passages(docs, doc_id, text, **settings)
    spans = durable(found.groupBy(F.col("doc_id").alias("_cut_id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_cut_spans")))
    joined = docs.join(spans, docs[doc_id].cast("long") == spans["_cut_id"], "left")
    new = F.when(F.col("_cut_spans").isNull(), docs[text]).otherwise(_cut(F.when(F.col("_cut_spans").isNotNull(), docs[text]), F.col("_cut_spans")))
    columns = [new.alias(c) if c == text else docs[c] for c in docs.columns]
    cut = joined.select(*columns, "_cut_spans").filter(F.col("_cut_spans").isNull() | (F.col(text) != ""))
    if length:
        cut = cut.withColumn(length, F.when(F.col("_cut_spans").isNull(), F.col(length)).otherwise(F.length(text)).cast(docs.schema[length].dataType))
    return cut.drop("_cut_spans")
