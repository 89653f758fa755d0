"""Adapters at the ends of reads.

An overlap of a read's end with an adapter's start counts from 8 bases with at most 15 % mismatches. Reads come as Arrow
batches; their ends stand in one matrix, aligned to the right, and each start of each adapter is one comparison of columns
of the whole batch. Nothing is joined or shuffled, and the adapters travel with the function.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINIMUM = 8
SEARCH = 28


def ends(sequences: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the last bases of each read as bytes, right-aligned and 0 where a read is shorter; lengths)."""
    column = sequences.combine_chunks() if isinstance(sequences, pa.ChunkedArray) else sequences
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    stop = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    size = np.diff(stop)
    at = stop[1:, None] + np.arange(-width, 0)
    inside = at >= stop[:-1, None]
    return np.where(inside, raw[np.where(inside, at, 0)], 0).astype(np.uint8), size


def overlaps(tails: np.ndarray, size: np.ndarray, adapter: bytes):
    """For each possible overhang, longest first: (overhang, overlap, matches of each read, whether it counts)."""
    width = tails.shape[1]
    for over in range(max(len(adapter), SEARCH), MINIMUM - 1, -1):
        n = min(over, len(adapter))
        matches = (tails[:, width - over : width - over + n] == np.frombuffer(adapter[:n], np.uint8)).sum(1)
        yield over, n, matches, (size >= over) & ((n - matches) * 100 <= n * 15)


def _usable(adapters: list[tuple[str, str, int]]) -> list[tuple[int, bytes, int]]:
    return [(i, s.upper().encode(), n) for i, (_, s, n) in enumerate(adapters) if len(s) >= MINIMUM]


def tail_support(sequence: Column, adapter: str) -> Column:
    """Whether a read ends in the adapter's start."""
    if len(adapter) < MINIMUM:
        return F.lit(False)
    raw = adapter.upper().encode()

    @F.arrow_udf("boolean")
    def supported(sequences: pa.Array) -> pa.Array:
        tails, size = ends(sequences, max(len(raw), SEARCH))
        found = np.zeros(len(size), bool)
        for _, _, _, good in overlaps(tails, size, raw):
            found |= good
        return pa.array(found)

    return supported(sequence)


def best_hit(reads: DataFrame, adapters: list[tuple[str, str, int]]) -> DataFrame:
    """reads with adapter_name, adapter_start (from 0) and adapter_score of the best overlap; null without one.

    Score: 4 a match, -3 a mismatch, 1 a base of overlap, and the adapter's support. Ties go to the smaller start, then to
    the earlier adapter.
    """
    usable = _usable(adapters)
    if not usable:
        return reads.withColumns({"adapter_name": F.lit(None).cast("string"), "adapter_start": F.lit(None).cast("int"), "adapter_score": F.lit(None).cast("long")})
    names = np.array([a[0] for a in adapters], dtype=object)
    width = max(SEARCH, *(len(s) for _, s, _ in usable))

    @F.arrow_udf("struct<name: string, start: int, score: bigint>")
    def best(sequences: pa.Array) -> pa.Array:
        tails, size = ends(sequences, width)
        n = len(size)
        score, over, which = np.full(n, np.iinfo(np.int64).min), np.zeros(n, np.int64), np.full(n, -1)
        for i, raw, support in usable:
            for o, ov, matches, good in overlaps(tails, size, raw):
                value = matches * 7 - 3 * ov + ov + support
                better = good & ((value > score) | ((value == score) & (o > over)))
                score[better], over[better], which[better] = value[better], o, i
        none = which < 0
        fields = [pa.array(names[np.maximum(which, 0)], pa.string(), mask=none), pa.array((size - over).astype(np.int32), mask=none), pa.array(score, mask=none)]
        return pa.StructArray.from_arrays(fields, ["name", "start", "score"])

    found = reads.withColumn("__best", best(F.col("sequence")))
    return found.withColumns({"adapter_name": F.col("__best.name"), "adapter_start": F.col("__best.start"), "adapter_score": F.col("__best.score")}).drop("__best")
