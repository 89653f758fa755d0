"""Words and shingles of whole texts, computed with numpy on the UTF-8 bytes of Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D. Words get 64-bit hashes from running sums over the bytes:
byte b at place i adds TABLE[b] * BASE**i (mod 2**64), so the difference of two running sums, moved back by BASE**-start,
depends on the word alone. No Python code runs per word. Texts are worked through in pieces that end between words, so
memory is bounded by the piece (or the longest single word), not by the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
TABLE = _rng.integers(0, 2**64, 256, U64) | U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TABLE_LOWER = TABLE[LOWER]
BASE = int(_rng.integers(0, 2**61, dtype=U64)) * 8 + 5
INVERSE = pow(BASE, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        n = max(n, PIECE + 4096)
        p = np.full(n, base, U64)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of some rows: byte range in data, hash; of row r they are first[r] to first[r + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def row_slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer text stands alone."""
    _, ends = string_buffers(column)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi
        lo = hi


def regroup(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many bytes, the last one excepted."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= limit:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def words(column: pa.Array, lower: bool = False) -> Words:
    """The words of each row of a string column."""
    data, ends = string_buffers(column)
    table = TABLE_LOWER if lower else TABLE
    starts, stops, hashes = [], [], []
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + PIECE)
        if to < n:  # go back to the end of a word or row, or else on to the next
            cut_ = data[at:to]
            spaces = np.flatnonzero(IS_SPACE[cut_[-4096:]])
            if len(spaces):
                to = at + max(0, len(cut_) - 4096) + int(spaces[-1]) + 1
            else:
                to = _next_break(data, ends, to)
        piece = data[at:to]
        solid = ~IS_SPACE[piece]
        begins, finishes = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        finishes[:-1] &= ~solid[1:]
        borders = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, to, "left")] - at
        borders = borders[(borders > 0) & (borders < len(piece))]
        begins[borders] = solid[borders]
        finishes[borders - 1] = solid[borders - 1]
        b, e = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        sums = np.zeros(len(piece) + 1, U64)
        np.cumsum(table[piece] * powers(BASE, len(piece))[: len(piece)], out=sums[1:])
        hashes.append(mix64((sums[e] - sums[b]) * powers(INVERSE, len(piece) + 1)[b] + (e - b).astype(U64)))
        starts.append(b + at)
        stops.append(e + at)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    stop = np.concatenate(stops) if stops else np.zeros(0, np.int64)
    found = np.concatenate(hashes) if hashes else np.zeros(0, U64)
    return Words(data, start, stop, found, np.searchsorted(start, ends, "left"))


def _next_break(data: np.ndarray, ends: np.ndarray, at: int) -> int:
    """The next place from at on where a word or row ends."""
    row_end = int(ends[np.searchsorted(ends, at, "left")])
    while at < row_end:
        spaces = np.flatnonzero(IS_SPACE[data[at : min(row_end, at + PIECE)]])
        if len(spaces):
            return at + int(spaces[0])
        at = min(row_end, at + PIECE)
    return row_end


_coef = mix64(np.arange(1, 65, dtype=U64)) | U64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words; runs over row borders are the caller's to drop."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U64)
    total = np.zeros(count, U64)
    for i in range(n):
        total += hashes[i : i + count] * _coef[i]
    return mix64(total)


def row_counts(first: np.ndarray, n: int) -> np.ndarray:
    """How many runs of n words each row has."""
    return np.maximum(np.diff(first) - n + 1, 0)


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): sorted distinct hashes of each row's n-word shingles; of a shorter row its whole sequence as one."""
    lengths = np.diff(w.first)
    g = grams(w.hash, n)
    row = w.row
    inside = np.zeros(len(g), bool)
    if len(g):
        inside = row[: len(g)] == row[n - 1 :]
    value, of = g[inside], row[: len(g)][inside]
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    if len(short):
        extra = np.zeros(len(short), U64)
        for i in range(n - 1):
            there = lengths[short] > i
            extra[there] += w.hash[w.first[short[there]] + i] * _coef[i + 32]
        extra = mix64(extra + lengths[short].astype(U64))
        value, of = np.concatenate([value, extra]), np.concatenate([of, short])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[fresh], of[fresh]
    return value, np.searchsorted(of, np.arange(len(w.first)), "left")
