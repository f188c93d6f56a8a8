"""Near-duplicate documents with DartMinHash signatures.

A text is the weighted set of its five-word shingles. Each shingle and unit of weight is a region
at which hashed darts arrive, at random ranks, the same for every text; a dart counts if it lands
below the shingle's weight. Each dart aims at one of ``k`` coordinates, and a coordinate keeps
its earliest dart. Only ranks below about (k ln k + 2 k) / (total weight) are looked at, so a
signature takes time in proportion to the text plus k log k, not to their product. Two texts agree in a
coordinate with the probability of their weighted Jaccard similarity.

Signatures are cut into bands; texts that share a band are candidates, and a candidate pair is a
link if its exact similarity reaches the threshold. Classes are the connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import _text
from textloom.llm._spark import durable, if_small, sized, stored
from textloom.llm.components import components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: At similarity 0.8 two texts share no band with a probability of (1 - 0.8 ** 5) ** 30 = 7e-6.
BANDS, ROWS = 30, 5
#: In buckets in which more pairs than this could stand, rare shingles tell which texts to compare.
SPLIT_PAIRS = 16
#: Turns of comparing with leaders at most; what they leave is compared pair by pair.
MAX_TURNS = 8
#: Turns end when fewer than one in so many of a turn's pairs were links: what is left is mostly unlike.
USEFUL_SHARE = 8
#: Bytes of text that are signed at once (whole rows at least), and elements whose darts fly at once.
SIGN_BYTES, ELEMENTS = 250_000, 30_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_AIM, _WEIGHT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """k dart ids for each weighted set; 0 throughout for an empty one.

    ``elements`` are hashes, distinct within a set; ``weights`` are positive; ``doc`` is in order.
    """
    best = np.full(n_docs * k, np.inf)
    ids = np.zeros(n_docs * k, np.uint64)
    total = np.bincount(doc, weights, n_docs)
    limit = np.divide(k * math.log(k) + 2 * k, total, out=np.zeros(n_docs), where=total > 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        pick = np.flatnonzero(np.isin(doc, todo)) if len(todo) < n_docs else np.arange(len(doc))
        for own in (pick[lo : lo + ELEMENTS] for lo in range(0, len(pick), ELEMENTS)):
            _throw(elements[own], weights[own], doc[own], limit, k, best, ids)
        empty = np.isinf(best.reshape(n_docs, k)[todo]).any(1)
        todo = todo[empty]
        limit[todo] *= 2  # later darts, until every coordinate has one
    return ids.reshape(n_docs, k)


def _throw(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, limit: np.ndarray, k: int, best: np.ndarray, ids: np.ndarray) -> None:
    """Throws all darts of rank below ``limit`` and keeps the earliest of each coordinate."""
    # weight axis in cells [0, 1), [1, 2), [2, 4), ...: a cell's darts arrive at the rate of its width
    cells = np.where(weights > 1, 1 + np.ceil(np.log2(np.maximum(weights, 1))), 1).astype(np.int64)
    of = np.repeat(np.arange(len(elements)), cells)
    cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell > 0, 2.0 ** (cell - 1), 0.0)
    width = np.where(cell > 0, low, 1.0)
    with np.errstate(over="ignore"):
        seed = _text.mix(elements[of] + cell.astype(np.uint64) * _GOLD)
    top, owner, rank = weights[of], doc[of], np.zeros(len(of))
    step = np.uint64(1)
    while len(seed):
        n = int(min(64, max(1, 65_536 // len(seed))))  # arrivals at a time
        with np.errstate(over="ignore"):
            darts = _text.mix(seed[:, None] + (step + np.arange(n, dtype=np.uint64)) * _GOLD)
        gaps = -np.log(_unit(darts)) / width[:, None]
        gaps[:, 0] += rank
        ranks = np.add.accumulate(gaps, 1)
        hit = (ranks < limit[owner][:, None]) & (low[:, None] + width[:, None] * _unit(_text.mix(darts ^ _WEIGHT)) <= top[:, None])
        row, column = np.nonzero(hit)
        dart, at = darts[row, column], ranks[row, column]
        slot = owner[row] * k + (_text.mix(dart ^ _AIM) % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, slot, at)
        first = best[slot] == at
        ids[slot[first]] = dart[first]
        rank = ranks[:, -1]
        alive = rank < limit[owner]
        seed, top, owner, rank, low, width = seed[alive], top[alive], owner[alive], rank[alive], low[alive], width[alive]
        step += np.uint64(n)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, how often the text has each, and the text's index; sorted within a text.

    Words are compared in lower case (A-Z). A text of fewer words than ``size`` is one shingle.
    """
    w = _text.words(data, offsets)
    grams, at = _text.windows(w.hash, w.doc, size, short=True)
    doc = w.doc[at]
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return grams[first], np.diff(np.r_[first, len(grams)]), doc[first]


def _fingerprints(grams: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """64 bits that stand for each text's set of shingles (two sets share them with a chance of 2^-64)."""
    sums = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(sums, doc, _text.mix(grams ^ _AIM))
    return _text.mix(sums).view(np.int64)


@_text.frugal
def _sign(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int, counted: bool) -> Iterator[pa.RecordBatch]:
    powers = _text.powers(rows)
    for batch in batches:
        data, offsets = _text.text_bytes(batch.column(1))
        for lo, hi in _text.chunks(offsets, SIGN_BYTES):
            n = hi - lo
            grams, times, doc = shingle_sets(data, offsets[lo : hi + 1], size)
            prints = _fingerprints(grams, doc, n)
            weights = times.astype(np.float64) if counted else np.ones(len(times))
            signature = dart_signatures(grams, weights, doc, n, bands * rows).reshape(n, bands, rows)
            with np.errstate(over="ignore"):
                keys = _text.mix((signature * powers).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)
            sizes = np.bincount(doc, minlength=n)
            keys = [k if s else [] for k, s in zip(keys, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), pa.array(prints), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "node", "n_shingles", "bands"],
            )


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, weights: str = "set") -> DataFrame:
    """doc_id, node (fingerprint of the shingle set), n_shingles and the band keys of each row.

    A band key is a hash of the band's number and coordinates.

    ``weights``: "set" gives every distinct shingle weight 1, for which the similarity is plain
    Jaccard; "count" weighs it by its number of occurrences.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    run = partial(_sign, size=size, bands=bands, rows=rows, counted=weights == "count")
    return source.mapInArrow(run, "doc_id long, node long, n_shingles long, bands array<long>")


@_text.frugal
def _pack_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _text.text_bytes(batch.column(1))
        for lo, hi in _text.chunks(offsets, SIGN_BYTES):
            grams, times, doc = shingle_sets(data, offsets[lo : hi + 1], size)
            ends = np.searchsorted(doc, np.arange(hi - lo + 1))
            packed = [(grams[a:b].tobytes(), times[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            prints = _fingerprints(grams, doc, hi - lo)
            columns = [pa.array(prints), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=["node", "found", "grams", "times"])


def _similarity(a: bytes, b: bytes, times_a: bytes | None = None, times_b: bytes | None = None) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
    same = y[at] == x if len(y) else np.zeros(len(x), bool)
    if times_a is None:
        common = int(same.sum())
        return common / max(1, len(x) + len(y) - common)
    m, n = np.frombuffer(times_a, "<u4").astype(np.int64), np.frombuffer(times_b, "<u4").astype(np.int64)
    common = int(np.minimum(m[same], n[at[same]]).sum())
    return common / max(1, int(m.sum() + n.sum()) - common)


@_text.frugal
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_similarity(*(x.as_py() for x in row)) for row in zip(*batch.columns[2:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])


def shingle_tables(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node, grams, times: the packed shingle sets of ``nodes`` (node, doc_id), one row each."""
    texts = docs.join(nodes, docs["doc_id"].eqNullSafe(nodes["doc_id"])).select("node", "text")
    # a doc_id may stand on rows of several texts: the fingerprint tells which is meant
    sets = texts.mapInArrow(partial(_pack_sets, size=size), "node long, found long, grams binary, times binary").filter("node = found")
    return sets.groupBy("node").agg(F.first("grams").alias("grams"), F.first("times").alias("times"))


def _verified(pairs: DataFrame, n_pairs: int, sets: DataFrame, threshold: float, weights: str) -> DataFrame:
    """a, b: the ``pairs`` of nodes whose similarity reaches the threshold."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    some = sets.join(if_small(durable(wanted)), "node", "left_semi")
    given = ["grams", "times"] if weights == "count" else ["grams"]
    left, right = (some.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in given)) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", *(f"{c}_{x}" for c in given for x in "ab")).coalesce(max(6, n_pairs // 10_000))
    compared = both.mapInArrow(_compare, "a long, b long, similarity double")
    return compared.filter(F.col("similarity") >= threshold).select("a", "b")


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(rows: DataFrame, keys: list[str]) -> DataFrame:
    """a, b: the pairs that share ``keys`` but aren't connected yet."""
    left = rows.select(*keys, F.col("node").alias("a"), F.col("root").alias("root_a"))
    right = rows.select(*keys, F.col("node").alias("b"), F.col("root").alias("root_b"))
    return _ordered(left.join(right, keys).filter("root_a < root_b"))


def _to_leaders(rows: DataFrame, turn: int) -> DataFrame:
    """a, b: each member with its bucket's leader of this turn, where they aren't connected yet."""
    lot = F.xxhash64("key", "node", F.lit(turn))
    leaders = rows.groupBy("key").agg(F.min_by(F.struct("node", "root"), lot).alias("leader"))
    joined = rows.join(leaders, "key").filter(F.col("root") != F.col("leader.root"))
    return _ordered(joined.select(F.col("node").alias("a"), F.col("leader.node").alias("b")))


def _mixed(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """key, node, root, n, roots of the members of buckets where several classes meet."""
    rows = members.withColumn("root", F.col("node")) if roots is None else _labelled(members, roots)
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.approx_count_distinct("root").alias("roots")).filter("low < high")
    return rows.join(met.select("key", "n", "roots"), "key")


@_text.frugal
def _elements(batches: Iterator[pa.RecordBatch], counted: bool) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a set; with ``counted`` one for each of its occurrences."""
    for batch in batches:
        for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
            sets = []
            for raw, times in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                grams = np.frombuffer(raw, np.uint64)
                if counted:
                    often = np.frombuffer(times, "<u4").astype(np.int64)
                    nth = np.arange(int(often.sum())) - np.repeat(np.cumsum(often) - often, often)
                    with np.errstate(over="ignore"):
                        grams = _text.mix(np.repeat(grams, often) + nth.astype(np.uint64) * _GOLD)
                sets.append(grams)
            sizes = [len(x) for x in sets]
            columns = [np.repeat(np.asarray(part.column(i)), sizes) for i in (0, 1)]
            key = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(key)], names=["node", "root", "size", "key"])


def _rare(sets: DataFrame, wanted: DataFrame, threshold: float, weights: str) -> DataFrame:
    """a, b: the pairs of the ``wanted`` (node, root) that may be alike, of different classes.

    Put the shingles of all in one order, from rare to frequent. If the first that two sets share has
    ``rest_a`` and ``rest_b`` of them at or after it, they have at most the lesser in common, which
    must reach threshold / (1 + threshold) of both sizes together. So only the first shingles of a
    set matter, fewer still where it is the smaller one, and a passage that stands in thousands of
    texts makes no pairs of them. No pair at the threshold is lost.
    """
    given = sets.join(wanted, "node").select("node", "root", "grams", "times")
    rows = durable(given.mapInArrow(partial(_elements, counted=weights == "count"), "node long, root long, size int, key long"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = Window.partitionBy("node")
    rest = F.count(F.lit(1)).over(own) - F.row_number().over(own.orderBy("n", "key")) + 1  # shingles of one text come first
    share = threshold / (1 + threshold)
    rare = rows.join(shared, "key").withColumn("rest", rest).filter(F.col("rest") >= threshold * F.col("size") - 1e-6)
    rare = durable(rare.select("key", "node", "root", "size", "rest"))
    left = rare.filter(F.col("rest") >= 2 * share * F.col("size") - 1e-6)
    left = left.select("key", *(F.col(c).alias(f"{c}_a") for c in ("node", "root", "size", "rest")))
    right = rare.select("key", *(F.col(c).alias(f"{c}_b") for c in ("node", "root", "size", "rest")))
    enough = F.least("rest_a", "rest_b") >= share * (F.col("size_a") + F.col("size_b")) - 1e-6
    both = left.join(right, "key").filter((F.col("root_a") != F.col("root_b")) & (F.col("size_a") <= F.col("size_b")) & enough)
    return _ordered(both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    size: int = SHINGLE_WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    weights: str = "set",
    split_pairs: int = SPLIT_PAIRS,
) -> DataFrame:
    """doc_id, class_id, class_size: one row per row of ``docs``; class_id is the least doc_id of the class.

    Texts with equal shingle sets count once, so copies cost nothing. In each bucket the texts are
    compared with a leader only, drawn anew each turn, and links join classes; connected pairs are
    never looked at again. So a bucket of thousands of near copies costs thousands of pairs a turn,
    not millions. When few pairs of different classes are left in the buckets, or turns no longer
    help, all of those are compared. Where a bucket has many left, their rarest shingles tell which
    may reach the threshold, and no pair that does is lost.

    Null and empty texts have no shingles and form one class, as copies of each other; texts of one
    to four words match equal texts only; repeated rows are copies; a class of null ids alone has a
    null class_id; an empty table gives no rows; other columns are ignored. Texts are taken whole, however long;
    one longer than what is signed at once is signed alone.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = durable(signatures(source, size=size, bands=bands, rows=rows, weights=weights))
    nodes = durable(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members, n_members = sized(banded.join(buckets, "key").select("key", "node"))
    sets = stored(shingle_tables(nodes.select("node", "doc_id").join(members.select("node").distinct(), "node"), source, size))

    roots, tested, links, useful = None, None, [], True
    for turn in range(MAX_TURNS):
        apart, n_rows = sized(_mixed(members, roots).select("key", "node", "root", "n", "roots"))
        cross = apart.groupBy("key").agg(F.first("n").alias("n"), F.first("roots").alias("r")).agg(F.sum(F.col("n") * (F.col("r") - 1))).first()[0] or 0
        if cross <= 2 * n_members and turn or not useful:
            break
        fresh = _to_leaders(apart, turn)
        pairs, n_pairs = sized(fresh if tested is None else fresh.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        found, n_found = sized(_verified(pairs, n_pairs, sets, threshold, weights))
        links.append(found)
        if n_found:
            roots = durable(components(reduce(DataFrame.unionByName, links)))
        useful = not turn or n_found * USEFUL_SHARE >= n_pairs
        members = apart.select("key", "node")
    else:
        apart, n_rows = sized(_mixed(members, roots).select("key", "node", "root", "n", "roots"))
    if n_rows:
        large = F.col("n") * F.col("roots") > split_pairs
        few = _apart(apart.filter(~large), ["key"])
        many = durable(apart.filter(large).select("node", "root").distinct())
        rest = few.unionByName(_rare(sets, many, threshold, weights)).distinct()
        pairs, n_pairs = sized(rest.join(tested, ["a", "b"], "left_anti"))
        found, n_found = sized(_verified(pairs, n_pairs, sets, threshold, weights))
        if n_found:
            roots = durable(components(reduce(DataFrame.unionByName, [*links, found])))
    if roots is None:
        roots = members.select("node", F.col("node").alias("root")).limit(0)

    classed = _labelled(signed.select("doc_id", "node"), roots)
    classes = classed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return classed.join(classes, "root").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the least doc_id stays.

    Of rows that share an id and a text one stays, the first by their columns as JSON; rows that share
    an id and have different texts are kept or dropped together. A row with a null id stays only where
    its class has no other.
    """
    classes = near_duplicates(docs, doc_id, text, **settings)
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(F.col("doc_id").alias("_kept_id")).agg(F.count(F.lit(1)).alias("_rows"))
    rows = docs.join(kept, docs[doc_id].cast("long").eqNullSafe(kept["_kept_id"]), "inner")
    once, several = rows.filter("_rows = 1").select(docs.columns), rows.filter("_rows > 1").select(docs.columns)
    # an id that several kept rows share is rare: those rows are told apart by their texts
    least = Window.partitionBy(doc_id, text).orderBy(F.to_json(F.struct(*docs.columns)))
    alone = several.withColumn("_nth", F.row_number().over(least)).filter("_nth = 1").drop("_nth")
    return once.unionByName(alone)
