"""Sums by integer key, and look-ups of many keys at once, by shuffles of packed keys.

Keys under 2**width are mixed by an odd factor, which spreads them evenly, and go to buckets by their high bits. What one
task has for one bucket is one row: its distinct keys in order, as gaps of 7 bits a byte, and their values alike. That is
two to three bytes a key where a row of two longs takes sixteen. Rows that ask for keys are named by a block; a block gets
its answers in the order of its own distinct mixed keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64, I64 = np.uint64, np.int64
ODD = 0x9E3779B97F4A7C15
#: Keys that a task holds before it packs them.
CHUNK = 1 << 21
PACKED, ASKED, ANSWERED = "bucket int, keys binary, n binary", "block long, bucket int, keys binary", "block long, bucket int, n binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
_ANSWERED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.binary())])


def bucket_bits(spark: SparkSession, width: int) -> int:
    """Bits of a bucket's name: some four buckets for each partition of a shuffle."""
    return min((4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length(), 14, width)


def mixed(keys: np.ndarray, width: int) -> np.ndarray:
    return keys.astype(U64) * U64(ODD) & U64((1 << width) - 1)


def unmixed(keys: np.ndarray, width: int) -> np.ndarray:
    return (keys * U64(pow(ODD, -1, 1 << width)) & U64((1 << width) - 1)).astype(I64)


def squeeze(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of 7 bits each, low ones first, where each value begins and the last one ends)."""
    values = values.astype(U64)
    size, top = np.ones(len(values), np.uint8), int(values.max(initial=0))
    longest = max(1, -(-top.bit_length() // 7))
    for i in range(1, longest):
        size += values >= U64(1 << 7 * i)
    ends = np.concatenate([[0], np.cumsum(size, dtype=I64)])
    out = np.empty(ends[-1], np.uint8)
    for i in range(longest):
        some = slice(None) if i == 0 else np.flatnonzero(size > i)
        more = (size[some] > i + 1).astype(np.uint8) << 7
        out[ends[:-1][some] + i] = (values[some] >> U64(7 * i) & U64(127)).astype(np.uint8) | more
    return out, ends


def unsqueeze(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    last = data < 128
    if last.all():
        return data.astype(U64)
    end = np.flatnonzero(last)
    begin = np.concatenate([[0], end[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(begin, end - begin + 1)
    return np.add.reduceat((data & 127).astype(U64) << (7 * place).astype(U64), begin) if len(end) else np.zeros(0, U64)


def _cut(raw: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(ends[edges].astype(I64)), pa.py_buffer(raw)]).cast(pa.binary())


def split(keys: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(buckets, where each one's keys begin, the keys as gaps) of sorted distinct mixed keys."""
    rest = U64(width - bits)
    bucket = (keys >> rest).astype(I64)
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, I64)
    gaps = np.diff(keys, prepend=U64(0))
    gaps[start] = keys[start] - (bucket[start].astype(U64) << rest)
    edges = np.append(start, len(keys))
    return bucket[start].astype(np.int32), edges, _cut(*squeeze(gaps), edges)


def joined(bucket: int, raw: bytes, width: int, bits: int) -> np.ndarray:
    """The mixed keys of a row."""
    return np.cumsum(unsqueeze(raw), dtype=U64) + (U64(bucket) << U64(width - bits))


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their n."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, I64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n[:0]


def packing(found: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray | None]], width: int, bits: int):
    """For mapInArrow: what found makes of a batch, keys and their n (None: one each), packed."""

    def packed(held: list[tuple[np.ndarray, np.ndarray | None]]) -> pa.RecordBatch:
        every = mixed(np.concatenate([k for k, _ in held]), width)
        if held[0][1] is None:
            keys, n = np.unique(every, return_counts=True)
        else:
            keys, n = added(every, np.concatenate([n for _, n in held]))
        bucket, edges, gaps = split(keys, width, bits)
        return pa.RecordBatch.from_arrays([pa.array(bucket), gaps, _cut(*squeeze(n), edges)], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(found(batch))
            size += len(held[-1][0])
            if size >= CHUNK:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return run


def _merged(rows: pa.Table, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [(joined(b, k, width, bits), unsqueeze(n).astype(I64)) for b, k, n in zip(*(rows[c].to_pylist() for c in ("bucket", "keys", "n")), strict=True)]
    if not parts:
        return np.zeros(0, U64), np.zeros(0, I64)
    return parts[0] if len(parts) == 1 else added(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))


def summed(packed: DataFrame, width: int, bits: int, key: str, value: str, most: int | None = None) -> DataFrame:
    """(key, value): the sum of each key's n, no more than most."""
    schema = pa.schema([(key, pa.int64()), (value, pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        keys, n = _merged(rows, width, bits)
        return pa.Table.from_arrays([pa.array(unmixed(keys, width)), pa.array(n if most is None else np.minimum(n, most))], schema=schema)

    return packed.groupBy("bucket").applyInArrow(run, f"{key} long, {value} long")


def merged(packed: DataFrame, width: int, bits: int) -> DataFrame:
    """packed with one row for each bucket: some three bytes a key, to be kept and read by rows_of() several times."""

    def run(rows: pa.Table) -> pa.Table:
        keys, n = _merged(rows, width, bits)
        return pa.Table.from_arrays([rows["bucket"][:1].combine_chunks(), split(keys, width, bits)[2], pa.array([squeeze(n)[0].tobytes()], pa.binary())], schema=_PACKED)

    return packed.groupBy("bucket").applyInArrow(run, PACKED)


def rows_of(packed: DataFrame, width: int, bits: int, key: str, value: str) -> DataFrame:
    """(key, value) of merged()."""
    schema = pa.schema([(key, pa.int64()), (value, pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, keys, n in (row for b in batches for row in zip(*(b[c] for c in ("bucket", "keys", "n")), strict=True)):
            every = unmixed(joined(bucket.as_py(), keys.as_py(), width, bits), width)
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(unsqueeze(n.as_py()).astype(I64))], schema=schema)

    return packed.mapInArrow(run, f"{key} long, {value} long")


def table(counts: DataFrame, key: str, value: str, width: int, bits: int) -> DataFrame:
    """A table of keys and values, packed for look-ups."""
    return counts.select(key, value).mapInArrow(packing(lambda b: (b[key].to_numpy(), b[value].to_numpy().astype(I64)), width, bits), PACKED)


def asked(block: int, keys: np.ndarray, width: int, bits: int) -> pa.Table:
    """What a block asks for: its distinct keys, of those that are not negative."""
    bucket, _, gaps = split(np.unique(mixed(keys[keys >= 0], width)), width, bits)
    return pa.Table.from_arrays([pa.array(np.full(len(bucket), block, I64)), pa.array(bucket), gaps], names=["block", "bucket", "keys"])


def answers(asked_: DataFrame, table_: DataFrame, width: int, bits: int) -> DataFrame:
    """(block, bucket, n) for rows of asked(): the value of each key, 0 for those that aren't in the table."""

    def run(wanted: pa.Table, rows: pa.Table) -> pa.Table:
        have, n = _merged(rows, width, bits)
        out = []
        for bucket, raw in zip(wanted["bucket"].to_pylist(), wanted["keys"].to_pylist(), strict=True):
            keys = joined(bucket, raw, width, bits)
            at = np.minimum(np.searchsorted(have, keys), max(len(have) - 1, 0))
            out.append(squeeze(np.where(have[at] == keys, n[at], 0) if len(have) else np.zeros(len(keys), I64))[0].tobytes())
        return pa.Table.from_arrays([wanted["block"], wanted["bucket"], pa.array(out, pa.binary())], schema=_ANSWERED)

    return asked_.groupBy("bucket").cogroup(table_.groupBy("bucket")).applyInArrow(run, ANSWERED)


def told(keys: np.ndarray, rows: pa.Table, width: int) -> np.ndarray:
    """The value of each of a block's keys from the block's answers; 0 for negative ones."""
    out, some = np.zeros(len(keys), I64), np.flatnonzero(keys >= 0)
    _, of = np.unique(mixed(keys[some], width), return_inverse=True)
    order = np.argsort(rows["bucket"].to_numpy())
    raw = rows["n"].to_pylist()
    if len(some):
        out[some] = unsqueeze(b"".join(raw[i] for i in order)).astype(I64)[of]
    return out
