"""Arrow text columns as byte arrays: words, lines and their 64-bit hashes for a whole batch at once.

A word is a run of characters other than space and 0x09-0x0D. UTF-8 keeps those six bytes out of
longer characters, so words can be cut from the bytes. Hashes are 64 bits wide; two different
words in one corpus share one with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that the kernels take at once, whole rows at least.
CHUNK_BYTES = 500_000
#: Bytes that are hashed at once, also within a longer row, word or line; each takes some 40 bytes of arrays.
PIECE_BYTES = 200_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD6E8FEB86659FD93)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_NEWLINE = np.zeros(256, bool)
IS_NEWLINE[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of splitmix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base."""
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)])


_POWERS = powers(PIECE_BYTES)


def frugal(work: Callable) -> Callable:
    """``work``, a generator over batches that gives what it has freed back to the system when it ends.

    Spark's Python workers live on from task to task; without this each keeps the most that it ever held.
    """

    @wraps(work)
    def run(*args, **settings):
        pa.set_memory_pool(pa.system_memory_pool())  # one allocator, whose memory goes back
        try:
            yield from work(*args, **settings)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return run


class Segments(NamedTuple):
    """Words or lines of several texts, in order: byte ranges, the text each is in, its hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null row may still own bytes
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.where(valid, np.diff(offsets), 0)
        if sizes.sum() != offsets[-1] - offsets[0]:
            kept = np.repeat(valid, np.diff(offsets))
            data, offsets = data[offsets[0] : offsets[-1]][kept], np.r_[0, np.cumsum(sizes)]
    return data, offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _long_hash(data: np.ndarray, start: int, end: int) -> np.uint64:
    """The sum of a long range's terms, piece by piece."""
    total = 0
    for at in range(start, end, PIECE_BYTES):
        part = data[at : min(end, at + PIECE_BYTES)]
        with np.errstate(over="ignore"):
            own = int(np.sum(_BYTE[part] * _POWERS[: len(part)], dtype=np.uint64))
        total += own * pow(int(_BASE), at - start, 2**64)
    return np.uint64(total % 2**64)


def segment_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each byte range; the ranges are in order and don't overlap."""
    size = end - start
    out = np.zeros(len(start), np.uint64)
    full = np.flatnonzero(size > 0)
    ends = np.cumsum(size[full])
    lo, done = 0, 0
    while lo < len(full):
        hi = max(lo + 1, int(np.searchsorted(ends, done + PIECE_BYTES, "right")))
        s, n = start[full[lo:hi]], size[full[lo:hi]]
        if n[0] > PIECE_BYTES:
            out[full[lo]] = _long_hash(data, int(s[0]), int(s[0] + n[0]))
        else:
            first = np.cumsum(n) - n
            inside = np.arange(int(n.sum())) - np.repeat(first, n)
            with np.errstate(over="ignore"):
                out[full[lo:hi]] = np.add.reduceat(_BYTE[data[inside + np.repeat(s, n)]] * _POWERS[inside], first)
        lo, done = hi, int(ends[hi - 1])
    with np.errstate(over="ignore"):
        return mix(out + size.astype(np.uint64) * _GOLD)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, hashed: bool = True) -> Segments:
    """The words of the rows between ``offsets``; byte positions count from ``offsets[0]``."""
    part, bounds = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = ~IS_SPACE[part]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(part))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(bounds, start, "right") - 1
    return Segments(start, end, doc, segment_hash(LOWER[part] if lower else part, start, end) if hashed else start[:0])


def lines(data: np.ndarray, offsets: np.ndarray) -> Segments:
    """The lines of the rows, cut at each newline; a text of k newlines has k + 1 lines."""
    part, bounds = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    cut = np.flatnonzero(IS_NEWLINE[part])
    cut_doc = np.searchsorted(bounds, cut, "right") - 1
    doc = np.concatenate([np.arange(len(bounds) - 1), cut_doc])
    start, end = np.concatenate([bounds[:-1], cut + 1]), np.concatenate([bounds[1:], cut])
    by_start, by_end = np.lexsort((start, doc)), np.lexsort((end, doc))
    start, end = start[by_start], end[by_end]
    return Segments(start, end, doc[by_start], segment_hash(part, start, end))


def windows(hashes: np.ndarray, doc: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``size`` words of one text, and the index of its first word.

    With ``short``, a text of fewer words has one window, of all its words.
    """
    n = len(hashes)
    at = np.flatnonzero(doc[: max(0, n - size + 1)] == doc[size - 1 :]) if n >= size else np.zeros(0, np.int64)
    total = np.zeros(len(at), np.uint64)
    weights = powers(size)
    with np.errstate(over="ignore"):
        for j in range(size):
            total += hashes[at + j] * weights[size - 1 - j]
    total = mix(total + np.uint64(size))
    if short and n:
        heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        counts = np.diff(np.r_[heads, n])
        for head, count in zip(heads[counts < size].tolist(), counts[counts < size].tolist(), strict=True):
            value = np.zeros(1, np.uint64)
            with np.errstate(over="ignore"):
                for j in range(count):
                    value = value * _BASE + hashes[head + j]
            at, total = np.append(at, head), np.append(total, mix(value + np.uint64(count)))
        order = np.argsort(at, kind="stable")
        at, total = at[order], total[order]
    return total, at


def counts_by(doc: np.ndarray, n_docs: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How many entries (or what weight) each text has."""
    return np.bincount(doc, weights, n_docs).astype(np.int64)
