"""Which tokens of two tokenizers cover the same text, and how often in a corpus.

Byte offsets where a token of each ends cut both sequences into groups; the tokens of a group are
linked with each other. DuckDB does that for a chunk of texts at a time, inside the task that
reads them: two tables of token intervals, joined on equal ends for the cuts, a window sum over
the cuts for group numbers, an ASOF join that takes each token to the first cut at or after its
end, a range join with the groups' byte ranges, and grouping for pairs. Pair counts of a chunk are
partial sums; Spark merges them.

Texts are aligned by units: a unit ends before a single space between two characters that are
surely none. The first tokenizer splits there before it looks for merges; the second can't merge
across it, since no piece of its vocabulary holds a space after another character (which is
checked). So both end a token there, a unit has the same tokens in every text, and a chunk's
distinct units are all that has to be encoded and aligned.

A chunk is kept as one row: its pairs with their partial counts, which pairs its units have, which
units its documents have. Counts are summed over chunks and joined back to each chunk's pairs,
some ten thousand rows a chunk; then every document's links are known without aligning it again.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain
from typing import NamedTuple

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import _text
from textloom.llm._spark import stored
from textloom.llm.lm import from_planes, planes

#: Bytes of text that are aligned at once, whole rows at least.
CHUNK_BYTES = 2_000_000
#: Bytes of units that are encoded as one string.
JOINED_BYTES = 50_000

class Vocabulary(NamedTuple):
    """The bytes of all tokens in one array, and where each token's begin and end."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        size = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of tokens."""
        size = self.size[ids]
        return self.data[np.arange(int(size.sum())) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)]


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


@lru_cache(maxsize=2)
def byte_level(path: str):
    """A byte-level tokenizer and its vocabulary; strings of special tokens are plain text to it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path)
    encoder.encode_special_tokens = True
    letters, ids = _byte_of_letter(), encoder.get_vocab()
    tokens = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return encoder, Vocabulary.of(tokens)


@lru_cache(maxsize=2)
def pieces(path: str):
    """A piece tokenizer and its vocabulary."""
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [encoder.id_to_piece(i) for i in range(encoder.get_piece_size())]
    if any("▁" in n.lstrip("▁") for n in names):
        raise ValueError("a piece holds a space after another character, so texts can't be aligned by units")
    return encoder, Vocabulary.of([bytes([int(n[3:5], 16)]) if encoder.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])


class Units(NamedTuple):
    """The distinct units of some texts, which of them always lie between cuts; by occurrence the number and the text."""

    units: pa.Array
    safe: np.ndarray
    which: np.ndarray
    doc: np.ndarray


def units(texts: pa.Array) -> Units:
    """Cuts a space and each text into units; null and empty texts have none."""
    texts = texts.cast(pa.large_string())
    space, nothing = pa.scalar(" ", texts.type), pa.scalar("", texts.type)
    spaced = pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise(space, texts, nothing), None)
    data, offsets = _text.text_bytes(spaced.combine_chunks() if isinstance(spaced, pa.ChunkedArray) else spaced)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(data)
    # Printable ASCII, or a character of two bytes from U+00C0 on: no white space among them.
    ascii_, lead, trail = (data > 0x20) & (data < 0x7F), (data >= 0xC3) & (data < 0xE0), (data >= 0x80) & (data < 0xC0)
    cut = np.zeros(n, bool)
    if n > 2:
        after, before = ascii_ | lead, ascii_.copy()
        before[1:] |= trail[1:] & lead[:-1]
        cut[1:-1] = (data[1:-1] == 0x20) & before[:-2] & after[2:]
    filled = np.flatnonzero(np.diff(offsets))
    cut[offsets[filled]] = True
    start = np.flatnonzero(cut)
    flat = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.r_[start, n].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    coded = flat.dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    # A first unit may begin otherwise than after a cut, and a last one end otherwise.
    odd = np.zeros(len(start), bool)
    first = np.searchsorted(start, offsets[filled])
    odd[first] = odd[np.r_[first[1:], len(start)][: len(first)] - 1] = True
    safe = np.ones(len(coded.dictionary), bool)
    safe[which[odd]] = False
    return Units(coded.dictionary, safe, which, np.searchsorted(offsets, start, "right") - 1)


class Tokens(NamedTuple):
    """Tokens of the distinct units in order: id, unit, byte offset of the end; and which units they spell."""

    id: np.ndarray
    unit: np.ndarray
    end: np.ndarray
    spells: np.ndarray


def _tokens(flat: np.ndarray, unit: np.ndarray, vocabulary: Vocabulary, strings: pa.Array) -> Tokens:
    data, offsets = _text.text_bytes(strings)
    size = np.diff(offsets)
    own = np.bincount(unit, vocabulary.size[flat], len(size)).astype(np.int64)
    spells = own == size
    mine, theirs = vocabulary.spelled(flat)[np.repeat(spells, own)], data[offsets[0] : offsets[-1]][np.repeat(spells, size)]
    wrong = np.repeat(np.arange(len(size)), np.where(spells, size, 0))[mine != theirs]
    spells[wrong] = False
    return Tokens(flat, unit, np.cumsum(vocabulary.size[flat]), spells)


def _encoded(encode, strings: list[str], sizes: np.ndarray, safe: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each unit in order, and the unit of each: ``safe`` units many at a time, others one by one.

    Units that begin and end as cuts do have the same tokens in a row; byte lengths tell whose they are.
    That is quicker where an encoder has much to do for each string.
    """
    rows, odd = np.flatnonzero(safe), np.flatnonzero(~safe)
    place = np.cumsum(sizes[rows]) // JOINED_BYTES if len(rows) else rows
    edges = np.r_[0, np.flatnonzero(np.diff(place)) + 1, len(rows)] if len(rows) else np.zeros(1, int)
    parts = [rows[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    ids = encode(["".join([strings[i] for i in part]) for part in parts] + [strings[i] for i in odd])
    flat = [np.fromiter(chain.from_iterable(ids[: len(parts)]), np.int64), np.fromiter(chain.from_iterable(ids[len(parts) :]), np.int64)]
    end = np.cumsum(vocabulary.size[flat[0]])
    unit = rows[np.minimum(np.searchsorted(np.cumsum(sizes[rows]), end), len(rows) - 1)] if len(rows) else rows
    unit = np.r_[unit, np.repeat(odd, [len(x) for x in ids[len(parts) :]])]
    order = np.argsort(unit, kind="stable")
    return np.concatenate(flat)[order], unit[order]


class Aligner:
    """Aligns chunks of texts in one DuckDB connection."""

    #: A token of b that begins and ends at cuts is a group's only one; the others are found by their group's range.
    GROUPS = """
        CREATE OR REPLACE TEMP TABLE groups AS
        SELECT unit, ends, coalesce(lag(ends) OVER (ORDER BY ends), 0)::INTEGER AS begins,
          sum(1) OVER (ORDER BY ends ROWS UNBOUNDED PRECEDING)::INTEGER AS grp
        FROM (SELECT a.unit, ends FROM a JOIN b USING (ends));
        CREATE OR REPLACE TEMP TABLE grouped_a AS SELECT g.unit, g.grp, a.id, a.ends FROM a ASOF JOIN groups AS g ON a.ends <= g.ends;
        CREATE OR REPLACE TEMP TABLE grouped_b AS SELECT g.unit, g.grp, b.id, b.ends FROM b JOIN groups AS g USING (begins, ends);
        INSERT INTO grouped_b SELECT g.unit, g.grp, b.id, b.ends
        FROM (SELECT * FROM b ANTI JOIN grouped_b USING (ends)) AS b
        JOIN (SELECT * FROM groups ANTI JOIN grouped_b USING (grp)) AS g ON b.ends > g.begins AND b.ends <= g.ends;
        CREATE OR REPLACE TEMP TABLE pairs AS
        SELECT x.unit, x.id AS a, y.id AS b, sum(x.n * y.n)::BIGINT AS n
        FROM (SELECT unit, grp, id, count(*) AS n FROM grouped_a GROUP BY ALL) AS x
        JOIN (SELECT grp, id, count(*) AS n FROM grouped_b GROUP BY ALL) AS y USING (grp) GROUP BY ALL"""
    HELD = """
        SELECT a, b, count(*)::BIGINT AS held
        FROM (SELECT DISTINCT doc, a, b FROM occurs JOIN pairs USING (unit)) GROUP BY ALL ORDER BY a, b"""

    def __init__(self, a_path: str, b_path: str):
        (self.a, self.a_words), (self.b, self.b_words) = byte_level(a_path), pieces(b_path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        self.numbers = pa.array(map(str, range(max(len(self.a_words.size), len(self.b_words.size)))), pa.large_string())

    def ask(self, sql: str) -> dict[str, np.ndarray]:
        return {k: np.asarray(v, np.int64) for k, v in self.db.execute(sql).fetchnumpy().items()}

    def load(self, texts: pa.Array) -> tuple[Units, np.ndarray, dict[str, np.ndarray]]:
        """Makes the tables of a chunk's units; gives them, which texts have tokens, and (doc, unit, times) of these."""
        found = units(texts)
        strings = found.units.to_pylist()
        sizes = np.asarray(pc.binary_length(found.units))
        encode_a = lambda x: [e.ids for e in self.a.encode_batch_fast(x, add_special_tokens=False)]
        encode_b = lambda x: self.b.encode([s[1:] for s in x], num_threads=1)
        a = _tokens(*_encoded(encode_a, strings, sizes, found.safe, self.a_words), self.a_words, found.units)
        b = _tokens(*_encoded(encode_b, strings, sizes, np.zeros(len(strings), bool), self.b_words), self.b_words, found.units)
        good = a.spells & b.spells
        has = np.zeros(len(texts), bool)
        has[found.doc] = True
        has[found.doc[~good[found.which]]] = False
        whole, n = has[found.doc], max(1, len(strings))
        wanted = np.zeros(n, bool)
        wanted[found.which[whole]] = True
        for name, t in (("a", a), ("b", b)):
            kept = wanted[t.unit]  # ends count the bytes of these units alone, so that both tables agree
            ends = np.cumsum(np.diff(np.r_[0, t.end])[kept])
            columns = {"unit": t.unit[kept], "id": t.id[kept], "begins": np.r_[0, ends[:-1]][: len(ends)], "ends": ends}
            self.db.register(name, pa.table({k: pa.array(v.astype(np.int32)) for k, v in columns.items()}))
        key, times = np.unique(found.doc[whole] * n + found.which[whole], return_counts=True)
        occurs = {"doc": key // n, "unit": key % n, "times": times}
        self.db.register("occurs", pa.table({k: pa.array(v.astype(np.int32)) for k, v in occurs.items()}))
        self.db.execute(self.GROUPS)
        return found, has, occurs

    def spelled(self, n: int) -> pa.Array:
        """The groups of each of ``n`` units as text: ids joined by commas, then the other side's, groups by semicolons."""
        sides = [self.ask(f"SELECT unit, grp, id, ends FROM grouped_{x}") for x in "ab"]
        unit, group, ids, ends = (np.concatenate([x[c] for x in sides]) for c in ("unit", "grp", "id", "ends"))
        side = np.repeat([0, 1], [len(x["id"]) for x in sides])
        order = np.lexsort((ends, group * 2 + side))
        unit, group, ids, side = unit[order], group[order], ids[order], side[order]
        after = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])  # what follows each token
        after = np.where(unit[1:] != unit[:-1], 3, after)
        after = pa.array([",", "|", ";", ""], pa.large_string()).take(pa.array(np.r_[after, np.full(min(1, len(unit)), 3)].astype(np.int64)))
        text = pc.binary_join_element_wise(self.numbers.take(pa.array(ids)), after, pa.scalar("", pa.large_string()))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(unit, np.arange(n + 1)).astype(np.int32)), text), pa.scalar("", text.type))

    def by_unit(self, n: int, sql: str) -> np.ndarray:
        """A number for each unit, from (unit, n)."""
        got, out = self.ask(sql), np.zeros(n, np.int64)
        out[got["unit"]] = got["n"]
        return out


#: Of a chunk's pairs: ids and partial counts. Of its documents: what the result has.
_CHUNK = [
    *((x, pa.int32()) for x in ("a", "b", "held")),
    *((x, pa.int64()) for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links")),
    ("groups_sha256", pa.string()),
]
#: Packed: of its units' pairs the unit, place of the pair, links; of its documents' units document, unit, times.
_PACKED = ("unit", "pair", "links", "doc", "used", "times")
_NAMES = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string"}
_CHUNK_SCHEMA = ", ".join([*(f"{name} array<{_NAMES[kind]}>" for name, kind in _CHUNK), "packed binary"])


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Integers of half a billion at most, steps of the sorted ones, byte by byte and compressed."""
    steps = [np.diff(x, prepend=0) if i in (0, 3) else x for i, x in enumerate(arrays)]
    sizes = np.array([len(x) for x in arrays], "<i4")
    return np.r_[sizes, [sum(map(len, arrays))]].astype("<i8").tobytes() + pa.compress(b"".join(planes(x.astype("<i4")) for x in steps), "zstd", asbytes=True)


def _unpacked(raw: bytes) -> list[np.ndarray]:
    head = np.frombuffer(raw, "<i8", len(_PACKED) + 1)
    body, at, out = pa.decompress(raw[head.nbytes :], int(head[-1]) * 4, "zstd", asbytes=True), 0, []
    for i, n in enumerate(head[:-1].tolist()):
        x = from_planes(body[at : at + 4 * n], "<i4").astype(np.int64)
        out.append(np.cumsum(x) if i in (0, 3) else x)
        at += 4 * n
    return out


def _aligned(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, most: int) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of texts."""
    aligner = None
    for batch in batches:
        aligner = aligner or Aligner(a_path, b_path)
        for lo, hi in _text.chunks(_text.text_bytes(batch.column(1))[1], most):
            rows = batch.slice(lo, hi - lo)
            found, has, occurs = aligner.load(rows.column(1))
            n, u = rows.num_rows, len(found.units)
            held, links = aligner.ask(aligner.HELD), aligner.ask("SELECT unit, a, b, n FROM pairs ORDER BY unit, a, b")
            keys = held["a"] << 32 | held["b"]
            out = held | {"unit": links["unit"], "pair": np.searchsorted(keys, links["a"] << 32 | links["b"]), "links": links["n"]}
            out |= {"doc": occurs["doc"], "used": occurs["unit"], "times": occurs["times"], "doc_id": rows.column(0)}
            for name, sql in (("n_a", "count(*) AS n FROM a"), ("n_b", "count(*) AS n FROM b"), ("n_groups", "count(*) AS n FROM groups"), ("n_links", "sum(n)::BIGINT AS n FROM pairs")):
                out[name] = np.zeros(n, np.int64)
                np.add.at(out[name], occurs["doc"], occurs["times"] * aligner.by_unit(u, f"SELECT unit, {sql} GROUP BY unit")[occurs["unit"]])
            own = np.flatnonzero(has[found.doc])
            parts = aligner.spelled(u).take(pa.array(found.which[own]))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(found.doc[own], np.arange(n + 1)).astype(np.int32)), parts)
            joined = pc.binary_join(lists, pa.scalar(";", parts.type))
            out["groups_sha256"] = [hashlib.sha256(joined[i].as_buffer()).hexdigest() if has[i] else "" for i in range(n)]
            lists = [x if isinstance(x := out[name], pa.Array) else pa.array(x).cast(kind) for name, kind in _CHUNK]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([_packed([out[c] for c in _PACKED])], pa.binary())], names=[*(name for name, _ in _CHUNK), "packed"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each chunk, with the sums over their links of the corpus's counts of the chunk's pairs."""
    kept = [name for name, _ in _CHUNK[-6:]]
    for batch in batches:
        for row in range(batch.num_rows):
            of = {name: batch.column(i)[row].values for i, name in enumerate(batch.schema.names) if name != "packed"}
            unit, pair, links, doc, used, times = _unpacked(batch.column("packed")[row].as_py())
            sums = []
            for name in ("best", "count"):
                each = of[name].to_numpy().astype(np.int64) if of[name] is not None else np.zeros(0, np.int64)
                by_unit, by_doc = np.zeros(max(unit.max(initial=0), used.max(initial=0)) + 1, np.int64), np.zeros(len(of["doc_id"]), np.int64)
                np.add.at(by_unit, unit, links * each[pair])
                np.add.at(by_doc, doc, times * by_unit[used])
                sums.append(pa.array(by_doc))
            yield pa.RecordBatch.from_arrays([*(of[c] for c in kept[:-1]), *sums, of[kept[-1]]], names=[*kept[:-1], "n_best", "count_sum", kept[-1]])


def aligned_chunks(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The texts of ``docs`` aligned, as numbered chunks of a task's rows; see ``_CHUNK`` for what a chunk holds."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = rows.mapInArrow(partial(_aligned, a_path=a_path, b_path=b_path, most=chunk_bytes), _CHUNK_SCHEMA)
    return stored(chunks.withColumn("chunk", F.monotonically_increasing_id()))


def _pairs(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "held")).alias("place", "pair")).select("chunk", "place", "pair.*")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """a, b, count, best: how many documents of ``aligned_chunks`` link two tokens; whether no other b has more with this a."""
    counts = _pairs(chunks).groupBy("a", "b").agg(F.sum("held").alias("count"))
    return counts.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("a"))).cast("int"))


def alignment(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    ``a_path`` is a byte-level tokenizer's file, which gets a space and the text; ``b_path`` a piece
    tokenizer's, which adds the space itself. A pair's count is the number of rows that hold it
    linked; ``n_best`` are the links whose count is the highest of their first id, ties included.
    Null and empty texts, and texts that either tokenizer doesn't spell byte for byte, have no
    tokens: zeros and an empty digest. A null id stays null; a repeated row counts again; texts
    are aligned whole, however long; an empty table gives no rows; other columns are ignored.
    """
    chunks = aligned_chunks(docs, a_path, b_path, doc_id, text, chunk_bytes)
    known = _pairs(chunks).join(stored(pair_counts(chunks)), ["a", "b"]).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", "count", "best"))).alias("known"))
    known = known.select("chunk", F.col("known.count").alias("count"), F.col("known.best").alias("best"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return chunks.drop("a", "b", "held").join(known, "chunk", "left").drop("chunk").mapInArrow(_summed, schema)
