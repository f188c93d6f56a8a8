"""Nearest neighbours by cosine, from vantage-point trees over shards of the vectors.

Distances are those of unit vectors, d^2 = 2 - 2 cos, which obey the triangle inequality and order
vectors as the cosine does. A tree's node holds a vantage point and the median distance of its
vectors to it: the near half lies inside that radius, the other outside. A query at distance d,
whose k-th nearest so far is at distance t, needs the inside only if d - radius <= t and the
outside only if radius - d <= t. ``factor`` relaxes that: a side is skipped once the bound times
the factor is over t. With factor 1 nothing nearer is ever skipped and the search is exact.

The same rule chooses shards. Pivots from a bounded sample cut space into cells of vectors that
are nearest to one pivot; a large cell is cut into parts of bounded size by hash, with a tree
each. A query first searches its own cell, which gives it a distance t to start from, and then
those other cells whose bounds the factor doesn't rule out. Equal vectors are one entry of a tree, with
as many of their ids as an answer can need, so a vector with very many copies costs nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._spark import stored

#: How far bounds are relaxed; recall at this factor is in the README.
FACTOR = 4.0
#: Rows from which the pivots come, and the largest number of pivots; both are bounds on the driver.
SAMPLE_ROWS, MAX_PIVOTS = 8192, 4096
#: Vectors of a tree, of a leaf, and queries that meet a tree in one task.
TREE_ROWS, LEAF_ROWS, QUERY_ROWS = 8192, 32, 8192
#: Rounding of a distance that was taken from a cosine.
SLACK = 1e-7


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of doubles; shorter lists are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) == len(sizes) * width:
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def units(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length one; the largest component is taken out first, so squares stay in range."""
    scaled = vectors / np.abs(vectors).max(1, initial=1e-300, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed from the first component to the last."""
    a = a / np.abs(a).max(1, initial=1e-300, keepdims=True) if np.abs(a).max(initial=0) > 1e100 else a
    b = b / np.abs(b).max(1, initial=1e-300, keepdims=True) if np.abs(b).max(initial=0) > 1e100 else b
    dot, left, right = (np.cumsum(x, 1)[:, -1] for x in (a * b, a * a, b * b))
    return np.clip(dot / (np.sqrt(left) * np.sqrt(right)), -1.0, 1.0)


def distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


class VantageTree:
    """A vantage-point tree over unit vectors; ``ids`` break ties of the same cosine."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS):
        self.vectors, self.ids, self.leaf = vectors, ids, leaf
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple] = []  # (lo, hi, radius, inside, outside); the vantage point is at order[lo]
        self.visited = 0
        self._build(0, len(vectors))

    def _build(self, lo: int, hi: int) -> int:
        here = len(self.nodes)
        self.nodes.append((lo, hi, None, None, None))
        if hi - lo > self.leaf:
            rows = self.order[lo:hi]
            away = distance(self.vectors[rows] @ self.vectors[rows[0]])
            best = int(np.argmax(away))  # a vantage point at the edge tells more than one in the middle
            away = distance(self.vectors[rows] @ self.vectors[rows[best]])
            away[best] = -1.0
            half = (len(rows) + 1) // 2
            split = np.argpartition(away, half)
            vantage = int(np.flatnonzero(split == best)[0])
            split[[0, vantage]] = split[[vantage, 0]]
            self.order[lo:hi] = rows[split]
            radius = float(away[split[half]])
            inside = self._build(lo + 1, lo + half)
            self.nodes[here] = (lo, hi, radius, inside, self._build(lo + half, hi))
        return here

    def search(self, queries: np.ndarray, k: int, factor: float = FACTOR, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the ``k`` nearest and their cosines; row -1 where there are fewer.

        ``within`` gives each query a distance beyond which nothing is wanted.
        """
        n = len(queries)
        self.queries, self.k = queries, k
        self.row, self.cos = np.full((n, k), -1), np.full((n, k), -np.inf)
        self.within = np.full(n, np.inf) if within is None else within
        home = np.full(n, -1)
        self._descend(0, np.arange(n), home)
        self._visit(0, np.arange(n), home, factor)
        return self.row, self.cos

    def _reach(self, who: np.ndarray) -> np.ndarray:
        return np.minimum(self.within[who], distance(np.maximum(self.cos[who, -1], -1.0)) + np.where(self.row[who, -1] < 0, np.inf, 0.0)) + SLACK

    def _take(self, who: np.ndarray, lo: int, hi: int) -> None:
        rows = self.order[lo:hi]
        self.visited += len(who) * len(rows)
        cos = self.queries[who] @ self.vectors[rows].T
        better = np.flatnonzero(cos.max(1, initial=-np.inf) >= self.cos[who, -1])
        who, cos = who[better], cos[better]
        cos = np.concatenate([self.cos[who], cos], 1)
        row = np.concatenate([self.row[who], np.broadcast_to(rows, (len(who), len(rows)))], 1)
        best = np.lexsort((self.ids[row], -cos), axis=-1)[:, : self.k]
        self.cos[who], self.row[who] = np.take_along_axis(cos, best, 1), np.take_along_axis(row, best, 1)

    def _descend(self, node: int, who: np.ndarray, home: np.ndarray) -> None:
        """Each query takes the vectors of the leaf that it would itself lie in."""
        lo, hi, radius, inside, outside = self.nodes[node]
        if radius is None:
            home[who] = node
            return self._take(who, lo, hi)
        near = distance(self.queries[who] @ self.vectors[self.order[lo]]) < radius
        for child, part in ((inside, who[near]), (outside, who[~near])):
            if len(part):
                self._descend(child, part, home)

    def _visit(self, node: int, who: np.ndarray, home: np.ndarray, factor: float) -> None:
        lo, hi, radius, inside, outside = self.nodes[node]
        if radius is None:
            return self._take(who[home[who] != node], lo, hi)
        self._take(who, lo, lo + 1)
        away = distance(self.queries[who] @ self.vectors[self.order[lo]])
        for child, bound in ((inside, away - radius), (outside, radius - away)):
            part = who[bound * factor <= self._reach(who)]
            if len(part):
                self._visit(child, part, home, factor)


def _usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries of one vector become one row of a batch, with all their ids."""
    for batch in batches:
        lists = batch.column(1).to_pylist()
        asked: dict[tuple, list[int]] = {}
        for i, vector in zip(batch.column(0).to_pylist(), lists, strict=True):
            asked.setdefault(tuple(vector), []).append(i)
        yield pa.RecordBatch.from_arrays([pa.array(list(asked.values()), pa.list_(pa.int64())), pa.array(list(map(list, asked)), batch.column(1).type)], names=["askers", "vector"])


def _homes(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the nearest pivot of each vector and its distance."""
    for batch in batches:
        names, width = batch.schema.names, pivots.shape[1]
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            away = distance(units(matrix(part.column(names.index("vector")), width)) @ pivots.T)
            cell = away.argmin(1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])], names=[*names, "cell", "away"])


def _routes(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, inner: np.ndarray, outer: np.ndarray, factor: float) -> Iterator[pa.RecordBatch]:
    """A row for each other cell whose bounds don't rule it out: (request, within, vector, cell).

    The vectors of a cell lie from ``inner`` to ``outer`` away from its pivot, and nearer to it
    than to the query's own pivot.
    """
    for batch in batches:
        request, within, vector, home = (batch.column(i) for i in range(4))
        for lo in range(0, batch.num_rows, 1024):
            mine = home.slice(lo, 1024).to_numpy()
            away = distance(units(matrix(vector.slice(lo, 1024), pivots.shape[1])) @ pivots.T)
            bound = np.maximum(np.maximum(away - outer, inner - away), (away - away[np.arange(len(mine)), mine][:, None]) / 2)
            reach = within.slice(lo, 1024).to_numpy()[:, None] + SLACK
            open_ = (bound * factor <= reach) & (outer >= 0)
            open_[np.arange(len(mine)), mine] = False
            row, cell = np.nonzero(open_)
            at = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays([request.take(at), within.take(at), vector.take(at), pa.array(cell.astype(np.int32))], names=["request", "within", "vector", "cell"])


def _matches(shard: pa.Table, asked: pa.Table, width: int, k: int, factor: float) -> pa.Table:
    """Searches one tree for the queries that reached it; a row for each id that may be in an answer."""
    kinds = [("request", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
    if not shard.num_rows or not asked.num_rows:
        return pa.table([pa.array([], t) for _, t in kinds], names=[n for n, _ in kinds])
    shard = shard.sort_by("first_id")
    vectors, queries = matrix(shard.column("vector"), width), matrix(asked.column("vector"), width)
    tree = VantageTree(units(vectors), shard.column("first_id").to_numpy())
    row, _ = tree.search(units(queries), k, factor, asked.column("within").to_numpy())
    who, place = np.nonzero(row >= 0)
    found = row[who, place]
    score = cosine(queries[who], vectors[found])
    ids = shard.column("ids").combine_chunks()
    sizes, starts = ids.value_lengths().to_numpy(), ids.offsets.to_numpy()
    n = sizes[found]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    members = ids.values.take(pa.array(np.repeat(starts[found], n) + inside))
    request = asked.column("request").to_numpy()[who]
    return pa.table([pa.array(np.repeat(request, n)), members, pa.array(np.repeat(score, n))], names=[n for n, _ in kinds])


def _shards(entries: DataFrame, parts: Column, blocks: Column) -> DataFrame:
    """Entries with the part of their cell, once for each block of queries that will meet it."""
    part = F.pmod(F.xxhash64("first_id"), parts).cast("int")
    return entries.select("cell", part.alias("part"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "first_id", "ids", "vector")


def _by_cell(numbers: np.ndarray) -> Column:
    """The number of the row's cell."""
    return F.element_at(F.array(*(F.lit(int(x)) for x in numbers)) if len(numbers) < 500 else F.from_json(F.lit(str(numbers.tolist())), "array<int>"), F.col("cell") + 1)


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 5, factor: float = FACTOR, vec_id: str = "vec_id", vector: str = "embedding",
                       tree_rows: int = TREE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row that ``queries`` marks, among all rows.

    Nearness is the cosine in double precision; ties go to the smaller id, and a query's own id is
    never its neighbour. Vectors null, empty, zero, or holding null or non-finite components take
    no part, nor do rows without an id; vectors shorter than the longest count as filled up with
    zeros. Repeated rows count once. A query with fewer than ``k`` candidates gets all of them,
    one with none no rows; an empty table gives no rows; other columns are ignored.

    The driver holds at most SAMPLE_ROWS vectors, and three numbers a cell for MAX_PIVOTS cells.
    What a task holds is a tree of about ``tree_rows`` entries and ``query_rows`` queries.
    """
    marked = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = marked.filter(F.col("id").isNotNull() & _usable(F.col("vector")))
    same = Window.partitionBy("vector").orderBy("id")
    few = rows.select("id", "vector").withColumn("n", F.dense_rank().over(same)).filter(F.col("n") <= k + 1)
    entries = few.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("first_id", F.col("ids")[0])
    entries = stored(entries)
    size = entries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("width")).first()
    width = size["width"]

    # Pivots: those of a bounded sample, drawn by a hash of the id, that come first.
    n_cells = max(1, min(MAX_PIVOTS, size["n"] // tree_rows))
    drawn = entries.select("vector").orderBy(F.xxhash64("first_id"), "first_id").limit(min(SAMPLE_ROWS, n_cells)).toArrow()
    pivots = units(matrix(drawn.column("vector"), width)) if drawn.num_rows else np.ones((1, width)) / np.sqrt(width)
    kind = entries.schema["vector"].dataType.simpleString()
    homed = stored(entries.mapInArrow(partial(_homes, pivots=pivots), f"vector {kind}, ids array<bigint>, first_id long, cell int, away double"))
    bounds = homed.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("inner"), F.max("away").alias("outer")).collect()
    held, inner, outer = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -1.0)
    for b in bounds:
        held[b["cell"]], inner[b["cell"]], outer[b["cell"]] = b["n"], b["inner"], b["outer"]
    parts = np.maximum(1, -(-held // tree_rows))

    asked = rows.filter("asks").select("id", "vector").distinct().mapInArrow(_requests, f"askers array<bigint>, vector {kind}")
    asked = asked.mapInArrow(partial(_homes, pivots=pivots), f"askers array<bigint>, vector {kind}, cell int, away double")
    requests = stored(asked.select(F.monotonically_increasing_id().alias("request"), "askers", "vector", "cell"))

    def searched(pairs: DataFrame) -> DataFrame:
        waiting = np.zeros(len(pivots), np.int64)
        for b in pairs.groupBy("cell").count().collect():
            waiting[b["cell"]] = b["count"]
        blocks = _by_cell(np.maximum(1, -(-waiting // query_rows)))
        every = F.explode(F.sequence(F.lit(0), _by_cell(parts) - 1)).alias("part")
        asking = pairs.select("cell", every, F.pmod(F.xxhash64("request"), blocks).cast("int").alias("block"), "request", "within", "vector")
        shards = _shards(homed, _by_cell(parts), blocks)

        def matches(key, left: pa.Table, right: pa.Table) -> pa.Table:
            return _matches(left, right, width, k + 1, factor)

        keys = ["cell", "part", "block"]
        return stored(shards.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(matches, "request long, vec_id long, score double"))

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("request").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)

    first = searched(requests.select("cell", "request", F.lit(float("inf")).alias("within"), "vector"))
    reach = best(first).filter(F.col("place") == k + 1).select("request", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("within"))
    known = requests.join(reach, "request", "left").select("request", F.coalesce("within", F.lit(float("inf"))).alias("within"), "vector", "cell")
    routes = partial(_routes, pivots=pivots, inner=inner, outer=outer, factor=factor)
    found = first
    if len(pivots) > 1:
        found = first.unionByName(searched(stored(known.mapInArrow(routes, f"request long, within double, vector {kind}, cell int"))))
    answers = best(found).groupBy("request").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    each = requests.select("request", F.explode("askers").alias("query_id")).join(answers, "request")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = each.select("query_id", F.posexplode(others).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
