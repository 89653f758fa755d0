"""Per-read correction against the trusted part of a spectrum; the one operator whose steps depend on each other.

Every edit is seen by later positions of the same read, which no join expresses, so reads pass through one Arrow function
with the spectrum as broadcast arrays. Reads without a poor quality never enter it. Within it the reads of a batch stand in
one matrix and take each step together: a position, a round of indels, or a region is one step, and all windows that it
asks about are looked up at once. No Python code runs per base.

Substitutions go left to right. Insertions and deletions of 1 to 5 bases follow, at most one in 50 positions, on stronger
evidence. Regions of 2 to 10 low qualities are then replaced by the best path of the De Bruijn graph between their anchors.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import InitVar, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readprep.functions.packed import characters
from readprep.operators import keyed
from readprep.operators import spectrum as S
from readprep.operators.shared import Long, Store, Writer, release

GRACE = 5
LONGEST_INDEL, INDEL_BUCKET, INSERTED_QUALITY = 5, 50, 30
REGION = (2, 10)
POPS, BRANCHES, BRANCHES_OTHER = 1000, 4, 3
#: Bytes of a piece of the counting filter, of two counters each; a k-mer has some 10 counters.
PIECE = 1 << 26
#: Bytes of it that are packed at once; entries of a piece of the table of trusted k-mers; bits that name a file of its spool.
PACKED, ENTRIES, FILES = 1 << 22, 1 << 22, 7
#: K-mers that come to the driver at once.
PORTION = 1 << 19
#: Bases of the matrix that is worked through at once, and places of an indel that are tried at once.
CELLS, PLACES = 1 << 20, 1 << 15
U64, I64 = np.uint64, np.int64
UNKNOWN, BEYOND = 4, 5
HUGE = np.iinfo(np.int64).max // 4
_CODE = np.full(256, UNKNOWN, np.uint8)
_CODE[[65, 67, 71, 84]] = [0, 1, 2, 3]
_CODE[[97, 99, 103, 116]] = [0, 1, 2, 3]
_LETTER = np.frombuffer(b"ACGTNN", np.uint8)


class Table:
    """Values of distinct keys (0 or more) under 2**width, looked up many at a time.

    Keys are mixed by an odd factor modulo 2**width and sorted; the high bits of a mixed key name a bucket of one or two
    entries, and of the rest only the low bits are kept. Made from a spool, it never is in memory as a whole.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, width: int):
        self._laid(Store(None), [(keyed.mixed(keys, width), values)], len(keys), int(values.max(initial=0)), width, 0)

    @classmethod
    def of(cls, spool: Spool, store: Store) -> Table:
        """The same from a spool, one of its files after another."""
        table = cls.__new__(cls)
        table._laid(store, spool.read(), spool.n, spool.most, spool.width, spool.high)
        return table

    def _laid(self, store: Store, parts: Iterable[tuple[np.ndarray, np.ndarray]], n: int, most: int, width: int, high: int) -> None:
        """parts: the mixed keys and values, by the high bits of mixed keys if there are any."""
        bits = min(max(n.bit_length() - 1, high, 1), width)
        self.width, self.rest = width, width - bits
        small = np.uint8 if self.rest <= 8 else np.uint16 if self.rest <= 16 else np.uint32 if self.rest <= 32 else U64
        kinds = {"first": np.uint32 if n < 1 << 32 else I64, "low": small, "values": np.uint32 if most < 1 << 32 else I64}
        columns = {c: Long(store, c, kind, (1 << bits) + 1 if c == "first" else n, ENTRIES) for c, kind in kinds.items()}
        self.first, self.low, self.values = columns.values()
        first, low, value = (Writer(store, x) for x in columns.values())
        done, each = 0, 1 << bits - high
        for i, (mixed, values) in enumerate(parts):
            order = np.argsort(mixed)
            mixed = mixed[order]
            first.add(np.searchsorted(mixed, np.arange(i * each, (i + 1) * each, dtype=U64) << U64(self.rest)) + done)
            low.add((mixed & U64((1 << self.rest) - 1)).astype(small))
            value.add(values[order])
            done += len(mixed)
        first.add(np.array([done]))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for those that aren't there."""
        out, mixed = np.full(len(keys), -1, I64), keyed.mixed(keys, self.width)
        bucket = (mixed >> U64(self.rest)).astype(I64)
        at, end, wanted = self.first.at(bucket).astype(I64), self.first.at(bucket + 1).astype(I64), (mixed & U64((1 << self.rest) - 1)).astype(self.low.kind)
        rest = np.flatnonzero((at < end) & (keys >= 0))
        at, end, wanted = at[rest], end[rest], wanted[rest]
        while len(rest):
            here = self.low.at(at)
            same = here == wanted
            out[rest[same]] = self.values.at(at[same])
            at += 1
            more = (here < wanted) & (at < end)
            rest, at, end, wanted = rest[more], at[more], end[more], wanted[more]
        return out


class Spool:
    """Mixed keys and values that are added in any order, in files by the high bits of a mixed key."""

    def __init__(self, folder: str, width: int):
        self.width, self.high, self.n, self.most = width, min(FILES, width), 0, 0
        self.kind = np.dtype(np.uint32 if width - self.high <= 32 else U64)
        self.paths = [os.path.join(folder, f"keys-{i}") for i in range(1 << self.high)]

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        mixed, rest = keyed.mixed(keys, self.width), U64(self.width - self.high)
        order = np.argsort(mixed)
        mixed, values = mixed[order], values[order]
        low, edges = (mixed & (U64(1) << rest) - U64(1)).astype(self.kind), np.searchsorted(mixed, np.arange(1 << self.high, dtype=U64) << rest)
        for path, lo, hi in zip(self.paths, edges.tolist(), [*edges[1:].tolist(), len(mixed)], strict=True):
            if lo < hi:
                with open(path, "ab") as f, open(f"{path}-n", "ab") as g:
                    low[lo:hi].tofile(f)
                    keyed.squeeze(values[lo:hi])[0].tofile(g)
        self.n, self.most = self.n + len(mixed), max(self.most, int(values.max(initial=0)))

    def read(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What each file has, which is deleted then."""
        for i, path in enumerate(self.paths):
            if not os.path.exists(path):
                yield np.zeros(0, U64), np.zeros(0, I64)
                continue
            with open(f"{path}-n", "rb") as f:
                low, values = np.fromfile(path, self.kind), keyed.unsqueeze(f.read()).astype(I64)
            os.remove(path)
            os.remove(f"{path}-n")
            yield low.astype(U64) + (U64(i) << U64(self.width - self.high)), values


class Filter:
    """The counters of S.bloom(), two to a byte, in pieces."""

    def __init__(self, path: str, slots: int, store: Store):
        """path: a file of a byte for each counter, which is used up: it shrinks from its end as the pieces are made."""
        self.slots = slots
        self.bytes = Long(store, "filter", np.uint8, (slots + 1) // 2, PIECE)
        for i in reversed(range(len(self.bytes.parts))):
            lo, size = i * PIECE, min(PIECE, self.bytes.size - i * PIECE)
            packed = np.empty(size, np.uint8)
            for at in range(0, size, PACKED):
                part = np.fromfile(path, np.uint8, 2 * min(PACKED, size - at), offset=2 * (lo + at))
                low, high = part[0::2], part[1::2]
                packed[at : at + len(low)] = low
                packed[at : at + len(high)] |= high << 4
            self.bytes.put(store, i, packed)
            os.truncate(path, 2 * lo)

    @property
    def parts(self) -> list:
        return self.bytes.parts

    def at(self, slot: np.ndarray) -> np.ndarray:
        return self.bytes.at(slot >> 1) >> ((slot & 1) << 2).astype(np.uint8) & 15


@dataclass
class Spectrum:
    """Trusted counts by key, a counting filter for all others (or none); the trusted are the De Bruijn graph's edges.

    An edge leads from the first k - 1 bases of a k-mer to the last. Made for a session, its arrays are mapped from shared
    files or broadcasts, so it travels within the functions that use it and must not be broadcast itself. keys and counts
    are those of a table that isn't made yet.
    """

    k: int
    floor: int
    keys: InitVar[np.ndarray | None]
    counts: InitVar[np.ndarray | None]
    counters: Filter | None = None
    hashes: int = 0
    graph: bool = False
    table: Table | None = field(default=None, repr=False)

    def __post_init__(self, keys: np.ndarray | None, counts: np.ndarray | None):
        self.table = self.table or Table(keys, counts, 2 * self.k)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Counts of canonical codes: exact if trusted, else the filter's, else 0; -1 (an unknown base) counts 0."""
        found = self.table.find(keys)
        if self.counters is not None:
            rest = np.flatnonzero((found < 0) & (keys >= 0))
            raw, least = keys[rest].astype(U64), np.full(len(rest), S.CEILING, I64)
            for seed in range(self.hashes):  # most absent keys meet an empty counter soon
                least = np.minimum(least, self.counters.at(S.slots_of(raw, seed, self.counters.slots)))
                there = least > 0
                rest, raw, least = rest[there], raw[there], least[there]
                if not len(rest):
                    break
            found[rest] = least
        return np.maximum(found, 0)

    def edges(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many, labels, counts) of the edges of nodes, four columns, of which the strongest edges come first."""
        strength = self.table.find((nodes[:, None] << 2 | np.arange(4)).reshape(-1)).reshape(-1, 4)
        label = np.argsort(-strength, 1, kind="stable")
        return (strength >= 0).sum(1), label, np.take_along_axis(strength, label, 1)

    def target(self, nodes: np.ndarray, label: np.ndarray) -> np.ndarray:
        return (nodes << 2 | label) & (1 << 2 * (self.k - 1)) - 1

    def edges_from(self, node: int) -> list[tuple[int, int, int]]:
        """(target, label, count) of a node's edges, the strongest first."""
        many, label, strength = (x[0] for x in self.edges(np.array([node], I64)))
        return [(int(self.target(node, x)), x, n) for x, n in zip(label[:many].tolist(), strength[:many].tolist(), strict=True)]


@dataclass
class Reads:
    """Reads side by side: base codes and qualities (0 where a read has none), lengths, and the edits so far."""

    bases: np.ndarray
    quality: np.ndarray
    length: np.ndarray
    q_length: np.ndarray
    #: rows and positions of changed bases, in the order of the changes
    changed: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    indels: dict[int, list[dict]] = field(default_factory=dict)

    def room(self, width: int) -> None:
        """At least so many columns."""
        more = width - self.bases.shape[1]
        if more > 0:
            self.bases = np.pad(self.bases, ((0, 0), (0, more)), constant_values=BEYOND)
            self.quality = np.pad(self.quality, ((0, 0), (0, more)))

    def within(self) -> np.ndarray:
        return np.arange(self.bases.shape[1]) < self.length[:, None]


def window_codes(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all windows of the rows, read forward and as their reverse complement, and their unknown bases."""
    n = bases.shape[1] - k + 1
    plain, odd = (bases & 3).astype(I64), bases > 3
    forward, backward, unknown = np.zeros((len(bases), n), I64), np.zeros((len(bases), n), I64), np.zeros((len(bases), n), np.int16)
    for j in range(k):
        part = plain[:, j : j + n]
        forward <<= 2
        forward |= part
        backward |= 3 - part << 2 * j
        unknown += odd[:, j : j + n]
    return forward, backward, unknown


def _better(least: np.ndarray, total: np.ndarray, than_least: np.ndarray, than_total: np.ndarray) -> np.ndarray:
    return (least > than_least) | (least == than_least) & (total > than_total)


def _covering(counts: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, total) over the last axis; without a valid window 0 and 0."""
    least = np.where(valid, counts, HUGE).min(-1)
    return np.where(least == HUGE, 0, least), np.where(valid, counts, 0).sum(-1)


def substitute(reads: Reads, limit: np.ndarray, min_quality: int, s: Spectrum) -> None:
    """Tries the three other bases wherever quality or support is poor, from left to right in all reads together."""
    k, width = s.k, reads.bases.shape[1]
    if width < k:
        return
    forward, backward, unknown = window_codes(reads.bases, k)
    last = reads.length - k
    known = (unknown == 0) & (np.arange(width - k + 1) <= last[:, None])
    counts = s.count(np.where(known, np.minimum(forward, backward), -1).reshape(-1)).reshape(forward.shape)
    poor = (reads.quality <= min_quality + GRACE) & (np.arange(width) < np.minimum(limit, reads.length)[:, None])
    for at in np.flatnonzero(poor.any(0)).tolist():
        lo, hi = max(0, at - k + 1), min(at, width - k)
        over = slice(lo, hi + 1)
        starts = np.arange(lo, hi + 1)
        rows = np.flatnonzero(poor[:, at] & (last >= lo))
        valid = starts <= last[rows, None]
        least, total = _covering(counts[rows, over], valid)
        tried = (reads.quality[rows, at] < min_quality) | (least < s.floor)
        if not tried.any():
            continue
        rows, valid, least, total = rows[tried], valid[tried], least[tried], total[tried]
        own = reads.bases[rows, at].astype(I64)
        stored = (own & 3)[:, None]
        usable = valid & (unknown[rows, over] - (own > 3)[:, None] == 0)
        f, r, up, down = forward[rows, over], backward[rows, over], 2 * (k - 1 - at + starts), 2 * (at - starts)
        keys = np.stack([np.where(usable & (own != b)[:, None], np.minimum(f + (b - stored << up), r + (stored - b << down)), -1) for b in range(4)])
        got = s.count(keys.reshape(-1)).reshape(keys.shape)
        all_least, all_total = _covering(got, valid)
        best_least, best_total, chosen = least.copy(), total.copy(), own.copy()
        for b in range(4):
            better = (own != b) & _better(all_least[b], all_total[b], best_least, best_total)
            best_least[better], best_total[better], chosen[better] = all_least[b][better], all_total[b][better], b
        gained = best_total >= total + max(s.floor, 1) * valid.sum(1)
        edit = np.flatnonzero((chosen != own) & ((best_least >= s.floor) & (best_least > least) | gained))
        if not len(edit):
            continue
        where, base, before = rows[edit], chosen[edit], stored[edit]
        forward[where, over] += base[:, None] - before << up
        backward[where, over] += before - base[:, None] << down
        unknown[where, over] -= (own[edit] > 3)[:, None]
        counts[where, over] = got[base, edit]
        reads.bases[where, at] = base
        reads.changed.append((where, np.full(len(where), at)))


def _around(context: np.ndarray, s: Spectrum) -> tuple[np.ndarray, np.ndarray]:
    """(least, total) over the windows that cover the middle of contexts (2k - 1, places); 0 and 0 if there is none."""
    k = s.k
    plain, odd, there = (context & 3).astype(I64), context == UNKNOWN, context != BEYOND
    forward, backward, unknown = np.zeros(context.shape[1], I64), np.zeros(context.shape[1], I64), odd[:k].sum(0)
    for j in range(k):
        forward = forward << 2 | plain[j]
        backward |= 3 - plain[j] << 2 * j
    keys, valid, mask, top = np.empty((k, context.shape[1]), I64), there[:k] & there[k - 1 :], (1 << 2 * k) - 1, 2 * (k - 1)
    for j in range(k):
        keys[j] = np.where(valid[j] & (unknown == 0), np.minimum(forward, backward), -1)
        if j < k - 1:
            forward = (forward << 2 | plain[j + k]) & mask
            backward = backward >> 2 | 3 - plain[j + k] << top
            unknown = unknown + odd[j + k] - odd[j]
    least, total = _covering(s.count(keys.reshape(-1)).reshape(keys.shape).T, valid.T)
    return least, total


@dataclass
class Indels:
    """The best indel of each place: least support, kind (0 none, 1 deletion, 2 insertion), size, inserted bases."""

    least: np.ndarray
    total: np.ndarray
    kind: np.ndarray
    size: np.ndarray
    inserted: np.ndarray

    def offer(self, places: np.ndarray, got: tuple[np.ndarray, np.ndarray], kind: int, size: int, inserted: np.ndarray | None = None) -> np.ndarray:
        """Takes over what is better than the best so far; which places it was."""
        better = _better(*got, self.least[places], self.total[places])
        at = places[better]
        self.least[at], self.total[at], self.kind[at], self.size[at] = got[0][better], got[1][better], kind, size
        if inserted is not None:
            self.inserted[at] = inserted[better]
        return at


def best_indels(padded: np.ndarray, pad: int, length: np.ndarray, row: np.ndarray, at: np.ndarray, least: np.ndarray, total: np.ndarray, s: Spectrum) -> Indels:
    """The indel of each place (row, at) that raises (least, total) the most, tried in a fixed order.

    padded holds the reads' bases from column pad on, with BEYOND on both sides.
    """
    k, n = s.k, len(row)
    found = Indels(least.copy(), total.copy(), np.zeros(n, np.int8), np.zeros(n, np.int8), np.zeros((n, LONGEST_INDEL), np.uint8))
    around = np.arange(-k + 1, k)[:, None]
    for size in range(1, LONGEST_INDEL + 1):
        own = length[row]
        places = np.flatnonzero((at + size <= own) & (own > k + (size if size > 1 else 0)))
        if not len(places):
            break
        left = np.minimum(at[places], own[places] - size - 1) + around
        source = left + size * (left >= at[places])
        found.offer(places, _around(padded[row[places], source + pad], s), 1, size)

    def insert(places: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        """Tries the inserted bases start and each base behind them; the places that gained by it."""
        behind = at[places] + around
        context = padded[row[places], np.where(around < 0, behind, np.where(around < size, 0, behind - size)) + pad]
        stop = min(k - 1 + size, 2 * k - 1)
        gained = []
        for base in range(4):
            more = start.copy()
            more[:, size - 1] = base
            context[k - 1 : stop] = more[:, : stop - k + 1].T
            gained.append(found.offer(places, _around(context, s), 2, size, more))
        return np.unique(np.concatenate(gained))

    places = insert(np.arange(n), np.zeros((n, LONGEST_INDEL), np.uint8), 1)
    for size in range(2, LONGEST_INDEL + 1):
        if not len(places):
            break
        places = insert(places, found.inserted[places], size)
    return found


def mend_indels(reads: Reads, limit: np.ndarray, min_quality: int, s: Spectrum) -> None:
    """Inserts or deletes where quality and support are still poor; one edit in each stretch of 50 positions.

    A round finds the first edit of every read; reads that have one go on behind it in the next round.
    """
    k, rows = s.k, np.flatnonzero(reads.length >= s.k)
    begin, used = np.zeros(len(reads.length), I64), np.full(len(reads.length), -1, I64)
    while len(rows):
        reads.room(int(reads.length[rows].max()) + LONGEST_INDEL + 1)
        length, width = reads.length[rows], reads.bases.shape[1]
        bases = np.where(np.arange(width) < length[:, None], reads.bases[rows], BEYOND).astype(np.uint8)
        forward, backward, unknown = window_codes(bases, k)
        starts, places = np.arange(width - k + 1), np.arange(width)
        valid = starts <= (length - k)[:, None]
        counts = s.count(np.where(valid & (unknown == 0), np.minimum(forward, backward), -1).reshape(-1)).reshape(forward.shape)
        lows, sums = np.full((len(rows), width + k - 1), HUGE, I64), np.zeros((len(rows), width + k - 1), I64)
        lows[:, k - 1 : width][valid], sums[:, k - 1 : width][valid] = counts[valid], counts[valid]
        least, total = np.full((len(rows), width), HUGE, I64), np.zeros((len(rows), width), I64)
        for j in range(k):
            np.minimum(least, lows[:, j : j + width], out=least)
            total += sums[:, j : j + width]
        open_ = (places >= begin[rows, None]) & (places < np.minimum(limit[rows], length)[:, None]) & (reads.quality[rows] < min_quality)
        row, at = np.nonzero(open_ & (least < s.floor) & (used[rows, None] != places // INDEL_BUCKET))
        pad = k + LONGEST_INDEL + 1
        padded = np.pad(bases, ((0, 0), (pad, pad)), constant_values=BEYOND)
        edited = []
        for i in range(0, len(row), PLACES):
            r, a = row[i : i + PLACES], at[i : i + PLACES]
            found = best_indels(padded, pad, length, r, a, least[r, a], total[r, a], s)
            good = np.flatnonzero((found.kind > 0) & (found.least >= 2 * s.floor))
            for j in good[np.unique(r[good], return_index=True)[1]].tolist():
                if edited and edited[-1] == rows[r[j]]:
                    continue  # a read whose places fill two portions: the first edit was in the one before
                edited.append(int(rows[r[j]]))
                _apply(reads, edited[-1], int(a[j]), int(found.kind[j]), found.inserted[j, : found.size[j]] if found.kind[j] == 2 else int(found.size[j]), begin)
                used[edited[-1]] = a[j] // INDEL_BUCKET
        rows = np.array(edited, I64)


def _apply(reads: Reads, row: int, at: int, kind: int, what: np.ndarray | int, begin: np.ndarray) -> None:
    """One indel in one read."""
    bases, quality, n, q = reads.bases[row], reads.quality[row], int(reads.length[row]), int(reads.q_length[row])
    if kind == 1:
        text = bases[at : at + what].copy()
        bases[at : n - what], bases[n - what : n] = bases[at + what : n].copy(), BEYOND
        gone = max(0, min(at + what, q) - at)
        quality[at : max(at, q - gone)], quality[max(at, q - gone) : max(at, q)] = quality[at + gone : max(at + gone, q)].copy(), 0
        reads.length[row], reads.q_length[row], begin[row] = n - what, q - gone, at
    else:
        text, size = what, len(what)
        bases[at + size : n + size] = bases[at:n].copy()
        bases[at : at + size] = what
        place = min(at, q)
        quality[place + size : q + size] = quality[place:q].copy()
        quality[place : place + size] = INSERTED_QUALITY
        reads.length[row], reads.q_length[row], begin[row] = n + size, q + size, at + size + 1
    reads.indels.setdefault(row, []).append({"position": at, "kind": "deletion" if kind == 1 else "insertion", "bases": _LETTER[text].tobytes().decode()})


def best_path(edges_from: Callable, start: int, end: int, length: int, branches: int) -> tuple[list[int], int] | None:
    """The path of so many edges whose weakest edge is strongest; the search is cut after POPS states, the first best wins."""
    best, stack, known = None, [(start, (), math.inf)], {}
    for _ in range(POPS):
        if not stack:
            break
        node, labels, least = stack.pop()
        if len(labels) == length:
            if node == end and (best is None or least > best[1]):
                best = (list(labels), least)
            continue
        if node not in known:
            known[node] = edges_from(node)[:branches]
        stack.extend((dst, (*labels, label), min(least, cnt)) for dst, label, cnt in known[node])
    return best


def best_paths(s: Spectrum, start: np.ndarray, end: np.ndarray, wanted: np.ndarray, branches: int) -> tuple[np.ndarray, np.ndarray]:
    """best_path for many pairs of nodes and several lengths of each: wanted[i, n] asks for n edges.

    Returns (least, labels) of wanted's shape, two bits a label, and least 0 where there is no path. All searches go on
    edge by edge together. The last edge of a node is explored first, so of equal paths the one with the greatest ranks of
    edges wins. A search of more than POPS states is left to best_path, which cuts it.
    """
    n, longest = len(start), wanted.shape[1] - 1
    least, labels = np.zeros(wanted.shape, I64), np.zeros(wanted.shape, I64)
    states = np.ones(n, I64)
    of, node, weak, code, rank = np.arange(n), start, np.full(n, HUGE, I64), np.zeros(n, I64), np.zeros(n, I64)
    for level in range(1, longest + 1):
        many, label, strength = s.edges(node)
        many = np.minimum(many, branches)
        up = np.repeat(np.arange(len(of)), many)
        child = np.arange(len(up)) - np.repeat(np.cumsum(many) - many, many)
        label = label[up, child]
        of, node, weak = of[up], s.target(node[up], label), np.minimum(weak[up], strength[up, child])
        code, rank = code[up] << 2 | label, rank[up] << 2 | child
        states += np.bincount(of, minlength=n)
        for i in np.flatnonzero((states > POPS) & wanted[:, level]).tolist():
            path = best_path(s.edges_from, int(start[i]), int(end[i]), level, branches)
            if path:
                least[i, level], labels[i, level] = path[1], sum(x << 2 * j for j, x in enumerate(reversed(path[0])))
        keep = (states[of] <= POPS) & wanted[of, level:].any(1)
        of, node, weak, code, rank = of[keep], node[keep], weak[keep], code[keep], rank[keep]
        hit = np.flatnonzero((node == end[of]) & wanted[of, level])
        order = hit[np.lexsort((rank[hit], weak[hit], of[hit]))]
        winner = order[np.append(of[order][1:] != of[order][:-1], True)] if len(order) else order
        least[of[winner], level], labels[of[winner], level] = weak[winner], code[winner]
        if not len(of) and not (wanted[:, level + 1 :].any(1) & (states > POPS)).any():
            break
    return least, labels


def better_regions(reads: Reads, row: np.ndarray, start: np.ndarray, size: np.ndarray, s: Spectrum) -> tuple[np.ndarray, np.ndarray]:
    """(length, labels) of other bases for regions between two anchors of k - 1 bases, length 0 for none.

    They are of the region's length or up to five shorter or longer; of equal ones the nearest in length, shorter first.
    """
    k, n = s.k, len(row)
    fits = (start >= k - 1) & (start + size + k - 1 <= reads.length[row])
    sides = np.arange(k - 1)
    anchors = [np.where(fits[:, None], reads.bases[row[:, None], np.where(fits, at, 0)[:, None] + sides], UNKNOWN) for at in (start - k + 1, start + size)]
    fits &= ~(anchors[0] > 3).any(1) & ~(anchors[1] > 3).any(1)
    weights = 1 << 2 * sides[::-1].astype(I64)
    before, after = ((a.astype(I64) * weights).sum(1) for a in anchors)
    lengths = np.arange(REGION[1] + LONGEST_INDEL + 1)
    off = np.abs(lengths - size[:, None])
    same = (off == 0) & fits[:, None]
    other = (off > 0) & (off <= np.minimum(LONGEST_INDEL, size - 1)[:, None]) & fits[:, None]
    least, labels = best_paths(s, before, after, same, BRANCHES)
    more_least, more_labels = best_paths(s, before, after, other, BRANCHES_OTHER)
    least, labels = np.where(other, more_least, least), np.where(other, more_labels, labels)
    best, chosen, every = np.zeros(n, I64), np.zeros(n, I64), np.arange(n)
    for delta in range(LONGEST_INDEL + 1):
        for length in (size - delta, size + delta):
            inside = (length >= 0) & (length < len(lengths))
            value = np.where(inside, least[every, np.where(inside, length, 0)], 0)
            better = value > best
            best[better], chosen[better] = value[better], length[better]
    return chosen, labels[every, chosen]


def mend_regions(reads: Reads, min_quality: int, s: Spectrum, parity: bool) -> None:
    """Runs of low quality are replaced by paths of the graph; the first run of every read, then the second, and so on.

    A replacement of another length leaves the qualities alone if parity is asked for, as tools did that this one is
    compared with; else qualities of new bases are inserted, and of lost bases dropped, so that both stay of one length.
    """
    low = np.pad((reads.quality < min_quality) & reads.within(), ((0, 0), (1, 1)))
    row, edge = np.nonzero(low[:, 1:] != low[:, :-1])
    row, start, size = row[0::2], edge[0::2], edge[1::2] - edge[0::2]
    fits = (size >= REGION[0]) & (size <= REGION[1])
    row, start, size = row[fits], start[fits], size[fits]
    turn = np.arange(len(row)) - np.searchsorted(row, row, "left")
    shift, quality = np.zeros(len(reads.length), I64), reads.quality.copy()
    wide = 1 << 32
    have = np.sort(np.concatenate([r.astype(I64) * wide + p for r, p in reads.changed])) if reads.changed else np.zeros(0, I64)
    for t in range(int(turn.max(initial=-1)) + 1):
        now = np.flatnonzero(turn == t)
        r, n = row[now], size[now]
        at = start[now] if parity else start[now] + shift[r]
        inside = at + n <= reads.length[r]
        now, r, n, at = now[inside], r[inside], n[inside], at[inside]
        if not len(now):
            continue
        length, labels = better_regions(reads, r, at, n, s)
        places = np.arange(REGION[1] + LONGEST_INDEL)
        new = labels[:, None] >> 2 * np.maximum(length[:, None] - 1 - places, 0) & 3
        old = reads.bases[r[:, None], np.minimum(at[:, None] + places, reads.bases.shape[1] - 1)]
        differs = (places < length[:, None]) & ((places >= n[:, None]) | (new != old))
        changed = (length > 0) & (differs.any(1) | (length != n))
        i, j = np.nonzero(differs & changed[:, None])
        keys = r[i].astype(I64) * wide + at[i] + j
        keys = keys[~np.isin(keys, have)]
        if len(keys):
            reads.changed.append((keys // wide, keys % wide))
            have = np.concatenate([have, keys])
        alike = np.flatnonzero(changed & (length == n))
        for p in range(REGION[1]):
            some = alike[n[alike] > p]
            reads.bases[r[some], at[some] + p] = new[some, p]
        for i in np.flatnonzero(changed & (length != n)).tolist():
            _replace(reads, int(r[i]), int(at[i]), int(n[i]), new[i, : length[i]], None if parity else quality[r[i], start[now[i]] : start[now[i]] + n[i]])
            if not parity:
                shift[r[i]] += length[i] - n[i]


def _replace(reads: Reads, row: int, at: int, n: int, new: np.ndarray, quality: np.ndarray | None) -> None:
    """Bases of one read by others of another length, with the qualities given for the old ones, or with qualities as they are."""
    more, length, q = len(new) - n, int(reads.length[row]), int(reads.q_length[row])
    reads.room(max(length, q) + max(more, 0))
    bases = reads.bases[row]
    rest = bases[at + n : length].copy()
    bases[at : at + len(new)], bases[at + len(new) : length + more] = new, rest
    bases[length + more : max(length, length + more)] = BEYOND
    reads.length[row] = length + more
    if quality is not None:
        own = reads.quality[row]
        kept = np.concatenate([own[:at], quality[: len(new)], np.full(max(more, 0), INSERTED_QUALITY, own.dtype), own[at + n : q]])
        own[: len(kept)], own[len(kept) :] = kept, 0
        reads.q_length[row] = len(kept)


def _matrix(codes: np.ndarray, offsets: np.ndarray, rows: np.ndarray, width: int, fill: int, kind: type) -> np.ndarray:
    """The characters of some rows side by side."""
    size = np.diff(offsets)[rows]
    out = np.full((len(rows), width), fill, kind)
    inside = np.arange(width) < size[:, None]
    out[inside] = codes[np.repeat(offsets[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    return out


def _strings(matrix: np.ndarray, length: np.ndarray) -> pa.Array:
    """Rows of characters as strings."""
    values = matrix[np.arange(matrix.shape[1]) < length[:, None]]
    ends = np.concatenate([[0], np.cumsum(length)]).astype(I64)
    if values.max(initial=0) > 127:
        text = "".join(map(chr, values.tolist()))
        return pa.array([text[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())
    return pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(ends), pa.py_buffer(values.astype(np.uint8))).cast(pa.string())


def process(sequences: pa.Array, qualities: pa.Array, adapter_start: np.ndarray, min_quality: int, s: Spectrum, parity: bool = False, indels: bool = True) -> list[pa.Array]:
    """Sequences, qualities, changed positions, indels and trimmed bases of reads whose adapter starts there, -1 for none."""
    codes, ends = characters(sequences)
    codes, (marks, q_ends) = _CODE[np.minimum(codes, 255)], characters(qualities)
    marks = np.maximum(marks.astype(np.int32) - 33, 0)
    sizes = np.diff(ends)
    order, out = np.argsort(sizes, kind="stable"), []
    i = 0
    while i < len(order):  # reads of like length together
        j = i + 1
        while j < len(order) and (j - i + 1) * (sizes[order[min(2 * j - i, len(order) - 1)]] + 16) <= CELLS:
            j = min(2 * j - i, len(order))
        rows = order[i:j]
        out.append(_process(codes, ends, marks, q_ends, rows, adapter_start[rows], min_quality, s, parity, indels))
        i = j
    back = pa.array(np.argsort(order, kind="stable"))
    return [pa.concat_arrays([part[c] for part in out]).take(back) for c in range(5)]


_INDEL = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("bases", pa.string())])


def _process(codes, ends, marks, q_ends, rows, start, min_quality, s, parity, indels) -> list[pa.Array]:
    size, q_size = np.diff(ends)[rows].astype(I64), np.diff(q_ends)[rows].astype(I64)
    width = int(max(size.max(initial=0), q_size.max(initial=0))) + 1
    reads = Reads(_matrix(codes, ends, rows, width, BEYOND, np.uint8), _matrix(marks, q_ends, rows, width, 0, np.int32), size.copy(), q_size.copy())
    fixed = np.where(start < 0, size, start)
    substitute(reads, fixed, min_quality, s)
    if indels:
        mend_indels(reads, fixed, min_quality, s)
    if not parity:
        fixed = np.where(start < 0, reads.length, fixed)  # a read that gained bases keeps them
    stop = np.minimum(fixed, reads.q_length)
    sound = (reads.quality + 2 >= min_quality) & (np.arange(reads.quality.shape[1]) < stop[:, None])
    end = np.where(sound.any(1), reads.quality.shape[1] - np.argmax(sound[:, ::-1], 1), 0)
    cut = np.where(stop - end >= 3, end, fixed)
    trimmed = np.maximum(reads.length - cut, 0)
    reads.length, reads.q_length = np.minimum(reads.length, cut), np.minimum(reads.q_length, cut)
    reads.quality[np.arange(reads.quality.shape[1]) >= reads.q_length[:, None]] = 0
    if s.graph:
        mend_regions(reads, min_quality, s, parity)
    row, at = (np.concatenate(x) for x in zip(*reads.changed, strict=True)) if reads.changed else (np.zeros(0, I64), np.zeros(0, I64))
    by_row = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))]).astype(np.int32)
    return [
        _strings(_LETTER[np.minimum(reads.bases, BEYOND)], reads.length), _strings(reads.quality + 33, reads.q_length),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[by_row].astype(np.int32))),
        pa.array([reads.indels.get(i, []) for i in range(len(rows))], pa.list_(_INDEL)), pa.array(trimmed, pa.int64()),
    ]


_OUT = "read_ix long, header string, sequence string, qualities string, corrected_positions array<int>, indels array<struct<position: int, kind: string, bases: string>>, trimmed_bases long, trimmed_adapter string"


def _run(s: Spectrum, min_quality: int, parity: bool, indels: bool):
    schema = pa.schema([("read_ix", pa.int64()), *((n, pa.string()) for n in ("header", "sequence", "qualities")), ("corrected_positions", pa.list_(pa.int32())), ("indels", pa.list_(_INDEL)), ("trimmed_bases", pa.int64()), ("trimmed_adapter", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            start = batch["adapter_start"].fill_null(-1).to_numpy(zero_copy_only=False).astype(I64)
            done = process(batch["sequence"], batch["qualities"], start, min_quality, s, parity, indels)
            yield pa.RecordBatch.from_arrays([batch["read_ix"], batch["header"], *done, batch["adapter_name"]], schema=schema)

    return run


def _portions(most: int, width: int):
    """Rows (kmer, cnt) to rows of up to so many k-mers: codes of four or eight bytes, and counts of 7 bits a byte."""
    schema, kind = pa.schema([("kmers", pa.binary()), ("counts", pa.binary())]), _code_kind(width)

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        kmer, cnt = (np.concatenate([b[c].to_numpy() for b in held]).astype(I64) for c in ("kmer", "cnt"))
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in (kmer.astype(kind), keyed.squeeze(cnt)[0])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if held and n + batch.num_rows > most:
                yield row(held)
                held, n = [], 0
            held, n = [*held, batch], n + batch.num_rows
        if n:
            yield row(held)

    return run


def _code_kind(width: int) -> np.dtype:
    return np.dtype(np.uint32 if width <= 32 else I64)


def collect_spectrum(counts: DataFrame, k: int, floor: int, hybrid: bool = True, graph: bool = True) -> Spectrum:
    """Trusted k-mers and the filter of all as arrays that workers map.

    The counts come to the driver in portions, a partition at a time. The filter is filled in a file, and trusted k-mers go to
    files too, of which one at a time is sorted into the table; so the number of distinct k-mers is bounded by disk alone.
    """
    spark, shape = counts.sparkSession, S.bloom_shape(counts).first()
    release(spark)  # shuffles of what has been counted before
    store = Store(spark)
    with tempfile.TemporaryDirectory(prefix="readprep-filter-") as folder:
        path, spool = os.path.join(folder, "counters"), Spool(folder, 2 * k)
        counters = np.memmap(path, np.uint8, "w+", shape=(shape.slots,)) if hybrid else None
        for row in counts.select("kmer", "cnt").mapInArrow(_portions(PORTION, 2 * k), "kmers binary, counts binary").toLocalIterator(prefetchPartitions=True):
            every, number = np.frombuffer(row.kmers, _code_kind(2 * k)).astype(I64), keyed.unsqueeze(row.counts).astype(I64)
            kept = number >= floor
            spool.add(every[kept], number[kept])
            if hybrid:
                S.add_to_counters(counters, every, number, shape.hashes)
        del counters
        table = Table.of(spool, store)
        filter_ = Filter(path, shape.slots, store) if hybrid else None
    return Spectrum(k, floor, None, None, filter_, shape.hashes, graph, table)


def process_reads(hits: DataFrame, s: Spectrum, min_quality: int, parity: bool = False, indels: bool = True) -> DataFrame:
    """Corrected and trimmed reads from reads with adapter_start and adapter_name.

    Reads whose qualities are all beyond the minimum by more than the grace can't be edited or trimmed at the tail; they
    are cut at the adapter in Spark and never enter Python.
    """
    hits = hits.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("sequence", "qualities")})  # a missing quality is the poorest
    weak = (F.length("qualities") < F.length("sequence")) | F.col("qualities").rlike("[\\x{0}-\\x{%x}]" % (33 + min_quality + GRACE))
    names = ["read_ix", "header", "sequence", "qualities", "adapter_start", "adapter_name"]
    edited = hits.where(weak).select(*names).mapInArrow(_run(s, min_quality, parity, indels), _OUT)
    cut = F.coalesce("adapter_start", F.length("sequence"))
    empty = "cast(array() as array<int>) as corrected_positions", "cast(array() as array<struct<position: int, kind: string, bases: string>>) as indels"
    sound = hits.where(~weak).withColumns({"n": F.length("sequence"), "sequence": F.substring("sequence", F.lit(1), cut), "qualities": F.substring("qualities", F.lit(1), cut)})
    sound = sound.selectExpr("read_ix", "header", "sequence", "qualities", *empty, "cast(n - length(sequence) as bigint) as trimmed_bases", "adapter_name as trimmed_adapter")
    return edited.unionByName(sound)
