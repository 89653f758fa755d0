"""Characters and k-mer codes of Arrow string columns, with numpy and without Python code per read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

I64 = np.int64


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(character codes, offsets) of a string column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, I64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    if not (raw > 127).any():
        return raw, ends - ends[0]
    texts = column.to_pylist()
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(I64)


def places(offsets: np.ndarray) -> np.ndarray:
    """The place of each character in its row, from 0."""
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def aligned(codes: np.ndarray, offsets: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The characters of another column's rows, place by place of rows with these offsets; 0 where they have none."""
    if len(offsets) == len(to) and (offsets == to).all():
        return codes
    row, at = np.repeat(np.arange(len(to) - 1), np.diff(to)), places(to)
    there = at < np.diff(offsets)[row]
    out = np.zeros(to[-1], codes.dtype)
    out[there] = codes[(offsets[row] + at)[there]]
    return out


def window_starts(bad: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Where windows of k characters start that stay in their row and hold nothing bad."""
    if len(bad) < k:
        return np.zeros(0, I64)
    upto = np.concatenate([[0], np.cumsum(bad)])
    clean = upto[k:] == upto[:-k]
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return np.flatnonzero(clean & (np.arange(len(clean)) + k <= ends[: len(clean)]))


def forward_codes(symbols: np.ndarray, k: int, bits: int = 2) -> np.ndarray:
    """The code of the window at every place, the first symbol highest; windows are put together from halves."""
    return _codes(symbols.astype(I64), k, bits, False)


def backward_codes(symbols: np.ndarray, k: int) -> np.ndarray:
    """The code of each window's reverse complement, two bits a base."""
    return _codes(3 - symbols.astype(I64), k, 2, True)


def _codes(one: np.ndarray, k: int, bits: int, turned: bool) -> np.ndarray:
    n = len(one) - k + 1
    if n <= 0:
        return np.zeros(0, I64)
    have, size, done, length = one, 1, None, 0
    while True:  # k is the sum of powers of two; the parts so far stand in front of the next one
        if k & size:
            if done is None:
                done, length = have, size
            else:
                more = have[length : length + len(done)]
                done = done[: len(more)]
                done, length = (done | more << bits * length if turned else done << bits * size | more), length + size
        if 2 * size > k:
            return done[:n]
        part = have[size:]
        have = have[: len(part)]
        have, size = (have | part << bits * size if turned else have << bits * size | part), 2 * size
