"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates: P(w | h) = l2 c(h, w) / c(h) + l1 c(w) / N +
l0 / (V + 1). The weights depend on a bucket of the context's frequency, floor(log2 c(h)) + 1, and
are learned by expectation-maximisation on held-out counts: a fifth of the corpus that learns is
held out, scored with counts of the rest, and its events are counted by bucket and by the two
estimates. The final counts are those of all documents that learn.

A corpus has nearly as many different bigrams as tokens, so counts don't travel as rows. Each task
sorts the distinct keys of a block of documents and sends them as arrays, one for each range of
keys; the range adds up all blocks' counts and answers each array with an array of the same order.
Answers meet their documents again by block. All counts are exact, but for 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import _text
from textloom.llm._spark import stored

FOLDS, TEST_FOLD, WEIGHT_FOLD = 5, 1, 0
#: Bytes of text in a block, and bytes of corpus for each range of keys.
BLOCK_BYTES, RANGE_BYTES = 5_000_000, 5_000_000
BUCKETS = 48
#: Steps of a natural logarithm in which held-out events are told apart while the weights are learned.
STEP, STEPS = 0.1, 400
EM_ROUNDS, EM_PRIOR = 40, 1.0

_END, _START = np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


class Tokens(NamedTuple):
    """Words and ends of texts in order: hash, hash of the one before, index of the text."""

    now: np.ndarray
    before: np.ndarray
    doc: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """The tokens of each row between ``offsets``: its words in lower case (A-Z), then one end."""
    parts = []
    for lo, hi in _text.chunks(offsets):
        w, n = _text.words(data, offsets[lo : hi + 1]), hi - lo
        ends = np.cumsum(np.bincount(w.doc, minlength=n)) + np.arange(n)
        now = np.full(len(w.doc) + n, _END)
        now[np.arange(len(w.doc)) + w.doc] = w.hash
        doc = np.repeat(np.arange(lo, hi), np.diff(np.r_[-1, ends]))
        before = np.r_[_START, now[:-1]]
        before[np.r_[0, ends[:-1] + 1]] = _START
        parts.append(Tokens(now, before, doc))
    if not parts:
        return Tokens(*(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.int64))
    return Tokens(*map(np.concatenate, zip(*parts, strict=True)))


def pair_keys(t: Tokens) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _text.mix(t.before * _GOLD + (t.now ^ (t.now >> np.uint64(29))))


def planes(numbers: np.ndarray) -> bytes:
    """An array byte by byte, all first bytes first: sorted or small numbers then compress well."""
    return numbers.view(np.uint8).reshape(-1, numbers.dtype.itemsize).T.tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _by_block(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Cuts batches of (doc_id, fold, text) into pieces of one block each.

    A block has rows of one task that follow each other, either of the weight fold or of others;
    which rows depends on the task's rows alone, not on how they come in batches.
    """
    task, done = TaskContext.get().partitionId(), [0, 0]
    for batch in batches:
        weighing = np.asarray(batch.column(1)) == WEIGHT_FOLD
        for stream in (0, 1):
            rows = batch.filter(pa.array(weighing if stream == 0 else ~weighing))
            if rows.num_rows:
                _, offsets = _text.text_bytes(rows.column(2))
                place = (done[stream] + offsets[:-1] - offsets[0]) // most
                done[stream] += int(offsets[-1] - offsets[0])
                edges = np.r_[0, np.flatnonzero(np.diff(place)) + 1, rows.num_rows]
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    yield (task * 2 + stream << 24) + int(place[a]), rows.slice(a, b - a)


def _requests(batches: Iterator[pa.RecordBatch], ranges: int, most: int) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each block with their counts, as one row for each order and range."""
    width = np.uint64(2**64 // ranges + 1)
    open_blocks: dict[int, tuple[int, list[tuple[Tokens, np.ndarray]]]] = {}

    def close(block: int, held: list[tuple[Tokens, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        folds = np.concatenate([f for _, f in held])
        for order in (1, 2):
            keys = np.concatenate([t.now if order == 1 else pair_keys(t) for t, _ in held])
            keys, which = np.unique(keys, return_inverse=True)
            learned = np.bincount(which, folds != TEST_FOLD, len(keys)).astype("<u4")
            kept = np.bincount(which, (folds != TEST_FOLD) & (folds != WEIGHT_FOLD), len(keys)).astype("<u4")
            owner = (keys // width).astype(np.int64)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            cut = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))
            arrays = [pa.array(np.full(len(cut), block)), pa.array(np.full(len(cut), order, np.int32)), pa.array(owner[first].astype(np.int32))]
            arrays += [pa.array([planes(x[a:b]) for a, b in cut], pa.binary()) for x in (keys, learned, kept)]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "order", "range", "keys", "learned", "kept"])

    for block, rows in _by_block(batches, most):
        stream = block >> 24 & 1
        if stream in open_blocks and open_blocks[stream][0] != block:
            yield from close(*open_blocks.pop(stream))
        data, offsets = _text.text_bytes(rows.column(2))
        t = tokens(data, offsets)
        open_blocks.setdefault(stream, (block, []))[1].append((t, np.asarray(rows.column(1)).astype(np.int8)[t.doc]))
    for block, held in open_blocks.values():
        yield from close(block, held)


_ANSWER = "block long, order int, range int, learned binary, kept binary, n_learned long, n_kept long, distinct long"


def _answer(group: pa.Table) -> pa.Table:
    """Sums the counts of one range of keys and answers each block's array; adds a row of totals."""
    out = {c: [] for c in ("block", "order", "range", "learned", "kept", "n_learned", "n_kept", "distinct")}
    rows = group.to_pydict()
    for order in (1, 2):
        mine = [i for i, o in enumerate(rows["order"]) if o == order]
        if not mine:
            continue
        keys = [from_planes(rows["keys"][i], "<u8") for i in mine]
        ends = np.cumsum([0, *map(len, keys)])
        unique, which = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for name in ("learned", "kept"):
            counts = np.concatenate([from_planes(rows[name][i], "<u4") for i in mine])
            sums.append(np.bincount(which, counts, len(unique)).astype(np.int64))
        for i, a, b in zip(mine, ends[:-1], ends[1:], strict=True):
            weighing = rows["block"][i] >> 24 & 1 == 0
            parts = [sums[0][which[a:b]].astype("<u8"), sums[1][which[a:b]].astype("<u8") if weighing else None]
            values = [rows["block"][i], order, rows["range"][i], *(None if p is None else planes(p) for p in parts), None, None, None]
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
        if order == 1:
            totals = [None, None, None, None, None, int(sums[0].sum()), int(sums[1].sum()), int((sums[0] > 0).sum())]
            for column, value in zip(out.values(), totals, strict=True):
                column.append(value)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _counts(answers: pa.Table, order: int, name: str) -> np.ndarray:
    """A block's counts in the order of its keys."""
    rows = sorted((r, v) for o, r, v in zip(*(answers.column(c).to_pylist() for c in ("order", "range", name)), strict=True) if o == order)
    return np.concatenate([from_planes(v, "<u8").astype(np.int64) for _, v in rows]) if rows else np.zeros(0, np.int64)


class Known(NamedTuple):
    """Counts that belong to each token of a block: of the token, its context, and the two together."""

    token: np.ndarray
    context: np.ndarray
    pair: np.ndarray


def _known(t: Tokens, answers: pa.Table, name: str, starts: int) -> Known:
    words, which = np.unique(t.now, return_inverse=True)
    pairs, both = np.unique(pair_keys(t), return_inverse=True)
    single, double = _counts(answers, 1, name), _counts(answers, 2, name)
    if len(single) != len(words) or len(double) != len(pairs):
        raise ValueError("a block's documents have changed since its keys were counted")
    token = single[which]
    context = np.full(len(token), starts)
    inner = np.flatnonzero(t.before != _START)
    context[inner] = token[inner - 1]
    return Known(token, context, double[both])


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else floor(log2 of its count) + 1."""
    return np.where(context > 0, np.frexp(context.astype(np.float64))[1], 0)


def _bins(p: np.ndarray) -> np.ndarray:
    """0 for no probability, else the step of its logarithm."""
    return np.where(p > 0, np.clip(np.rint(-np.log(np.where(p > 0, p, 1)) / STEP), 0, STEPS - 1) + 1, 0).astype(np.int64)


def _events(key, docs: pa.Table, answers: pa.Table, starts: int, total: int) -> pa.Table:
    """Held-out events of a block, counted by bucket and by the two estimates from the kept counts."""
    data, offsets = _text.text_bytes(docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string()))
    t = tokens(data, offsets)
    k = _known(t, answers, "kept", starts)
    pair = np.divide(k.pair, k.context, out=np.zeros(len(k.pair)), where=k.context > 0)
    cells, n = np.unique((bucket(k.context) * (STEPS + 1) + _bins(pair)) * (STEPS + 1) + _bins(k.token / max(1, total)), return_counts=True)
    return pa.table([pa.array(cells.astype(np.int64)), pa.array(n)], names=["cell", "n"])


def learn_weights(code: np.ndarray, n: np.ndarray, types: int) -> np.ndarray:
    """BUCKETS x 3 weights of pair, token and uniform estimates, by expectation-maximisation.

    ``code`` and ``n`` are the cells of ``_events`` and their counts; there are at most BUCKETS *
    401 * 401 (123 MB). A pseudo-count for each estimate keeps buckets without events in the middle.
    """
    code, n = code.astype(np.int64), n.astype(np.float64)
    which, pair, token = code // (STEPS + 1) ** 2, code // (STEPS + 1) % (STEPS + 1), code % (STEPS + 1)
    p = np.stack([np.where(x > 0, np.exp(-(x - 1) * STEP), 0.0) for x in (pair, token)] + [np.full(len(code), 1 / (types + 1))], 1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]  # an unseen context has no pair estimate
    for _ in range(EM_ROUNDS):
        share = weights[which] * p
        share *= (n / share.sum(1))[:, None]
        sums = np.stack([np.bincount(which, share[:, j], BUCKETS) for j in range(3)], 1) + EM_PRIOR
        sums[0, 0] = 0
        weights = sums / sums.sum(1, keepdims=True)
    return weights


def _scores(key, docs: pa.Table, answers: pa.Table, starts: int, total: int, types: int, weights: np.ndarray) -> pa.Table:
    n = docs.num_rows
    data, offsets = _text.text_bytes(docs.column("text").combine_chunks() if n else pa.array([], pa.string()))
    t = tokens(data, offsets)
    k = _known(t, answers, "learned", starts)
    base = np.log10((k.token + 0.5) / (total + 0.5 * (types + 1)))
    mixed = weights[bucket(k.context)]
    pair = np.divide(k.pair, k.context, out=np.zeros(len(k.pair)), where=k.context > 0)
    score = np.log10(mixed[:, 0] * pair + mixed[:, 1] * k.token / max(1, total) + mixed[:, 2] / (types + 1))
    counts = np.bincount(t.doc, minlength=n)
    columns = [
        docs.column("doc_id"),
        pa.array(np.asarray(docs.column("fold")) == TEST_FOLD),
        pa.array(counts.astype(np.int64)),
        pa.array(np.bincount(t.doc, k.token > 0, n).astype(np.int64)),
        pa.array(np.full(n, total, np.int64)),
        pa.array(np.bincount(t.doc, base, n)),
        pa.array(np.bincount(t.doc, score, n)),
    ]
    return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _blocked(batches: Iterator[pa.RecordBatch], most: int, weighing: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows with their block; only those of the weight fold with ``weighing``.

    The choice is made here and not by a filter, which Spark would push down to where it may change
    the tasks' rows and so the blocks.
    """
    for block, rows in _by_block(batches, most):
        if weighing and block >> 24 & 1:
            continue
        yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, block)), *rows.columns], names=["block", "doc_id", "fold", "text"])


def interpolation_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    ``docs`` is read three times and must give the same rows in the same tasks each time, as a
    table that is scanned does; if it doesn't, ValueError is raised. Null texts count as empty and
    have one token, the end; a null id falls into the fold of an empty text; repeated rows learn
    and are scored each for itself; an empty table gives no rows; other columns are ignored. The
    driver gets three totals and the cells of the held-out events, whose number is bounded.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), fold(F.col(doc_id)).alias("fold"), F.col(text).alias("text"))
    size = rows.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
        F.count_if(F.col("fold") != TEST_FOLD).alias("learned"),
        F.count_if((F.col("fold") != TEST_FOLD) & (F.col("fold") != WEIGHT_FOLD)).alias("kept"),
    ).first()
    ranges = max(16, size["bytes"] // range_bytes)
    asked = rows.mapInArrow(partial(_requests, ranges=ranges, most=block_bytes), "block long, order int, range int, keys binary, learned binary, kept binary")
    answers = stored(asked.groupBy("range").applyInArrow(_answer, _ANSWER))
    totals = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_learned", "n_kept", "distinct"))).first()
    replies = answers.filter("block IS NOT NULL").select("block", "order", "range", "learned", "kept")

    weighing = rows.mapInArrow(partial(_blocked, most=block_bytes, weighing=True), "block long, doc_id long, fold int, text string")

    def events(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _events(key, left, right, size["kept"], totals["n_kept"])

    own = replies.filter(F.shiftright("block", 24).bitwiseAND(F.lit(1)) == 0)
    cells = weighing.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(events, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = cells.toArrow()
    weights = learn_weights(found.column("cell").to_numpy(), found.column("n").to_numpy(), totals["distinct"])

    def scores(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _scores(key, left, right, size["learned"], totals["n_learned"], totals["distinct"], weights)

    blocks = rows.mapInArrow(partial(_blocked, most=block_bytes), "block long, doc_id long, fold int, text string")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(scores, schema)
