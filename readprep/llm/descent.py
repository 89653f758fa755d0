"""NN-descent and greedy graph walks over the vectors of one shard, in numpy.

Nodes are places 0 to n - 1 of an array of 32-bit vectors; nearness is the inner product. All steps take many nodes or
queries at once, in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np

NEIGHBOURS = 40
REVERSE = 24
TABLES = 4
#: Nodes of a leaf, whose pairs are compared for first neighbours; at least 2 * (k + 1).
LEAF = 192
#: Updates, as a share of all edges, below which edges count as settled.
SETTLED = 0.02
#: Nodes whose neighbours are joined at once, and found pairs that are held before they are merged.
JOINED, HELD = 512, 1 << 20
#: Queries that walk at once, and bytes of what they have seen.
WALKERS, SEEN = 256, 16 << 20


def _merge(nbr: np.ndarray, sim: np.ndarray, new: np.ndarray, u: np.ndarray, w: np.ndarray, s: np.ndarray) -> int:
    """Pairs (u, w) of similarity s into the lists of u, which are in falling order; how many got in."""
    n, k = nbr.shape
    better = np.flatnonzero(s > sim[u, -1])
    u, w, s = u[better].astype(np.int64), w[better], s[better]
    key = u << 32 | w
    order = np.argsort(key)
    key = key[order]
    once = np.ones(len(key), bool)
    once[1:] = key[1:] != key[:-1]
    order = order[once]
    u, w, s = u[order], w[order], s[order]
    known = np.zeros(len(u), bool)
    for j in range(k):
        known |= nbr[u, j] == w
    u, w, s = u[~known], w[~known], s[~known]
    if not len(u):
        return 0
    bits = s.astype(np.float32).view(np.int32).astype(np.int64)
    bits = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits)  # as ordered as the floats
    order = np.argsort(u << 32 | ((1 << 31) - 1 - bits))
    u, w, s = u[order], w[order], s[order]
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
    place = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
    got = place < k
    u, w, s, place = u[got], w[got], s[got], place[got]
    rows = u[place == 0]
    at = np.repeat(np.arange(len(rows)), np.diff(np.append(np.flatnonzero(place == 0), len(u))))
    most = int(place.max()) + 1
    ids, sims, fresh = np.full((len(rows), k + most), -1, np.int32), np.full((len(rows), k + most), -np.inf, np.float32), np.zeros((len(rows), k + most), bool)
    ids[:, :k], sims[:, :k], fresh[:, :k] = nbr[rows], sim[rows], new[rows]
    ids[at, k + place], sims[at, k + place], fresh[at, k + place] = w, s, True
    best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    nbr[rows], sim[rows], new[rows] = (np.take_along_axis(x, best, 1) for x in (ids, sims, fresh))
    return int((best >= k).sum())


def reverse(nbr: np.ndarray, new: np.ndarray, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, most): a sample of the nodes in whose lists a node is, without those in its own; new ones first. -1 fills up."""
    n, k = nbr.shape
    src, dst, fresh = np.repeat(np.arange(n, dtype=np.int64), k), nbr.reshape(-1).astype(np.int64), new.reshape(-1)
    own = np.zeros(n * k, bool)
    for j in range(k):
        own |= nbr[dst, j] == src
    keep = np.flatnonzero((dst >= 0) & ~own)
    src, dst, fresh = src[keep], dst[keep], fresh[keep]
    order = np.argsort(dst << 32 | (~fresh).astype(np.int64) << 31 | np.random.default_rng(seed).integers(0, 1 << 31, len(dst)))
    src, dst, fresh = src[order], dst[order], fresh[order]
    first = np.searchsorted(dst, np.arange(n))
    place = np.arange(len(dst)) - first[dst]
    got = place < most
    back, back_new = np.full((n, most), -1, np.int32), np.zeros((n, most), bool)
    back[dst[got], place[got]], back_new[dst[got], place[got]] = src[got], fresh[got]
    return back, back_new


def _leaves(x: np.ndarray, leaf: int, seed: int) -> list[np.ndarray]:
    """Nodes dealt into leaves of like size by halving along random directions."""
    n, rng = len(x), np.random.default_rng(seed)
    order, parts = np.arange(n), 1
    while n / parts > leaf:
        part = np.arange(n) * parts // n
        order = order[np.lexsort(((x @ rng.normal(size=x.shape[1]).astype(np.float32))[order], part))]
        parts *= 2
    edge = -(-np.arange(parts + 1) * n // parts)
    return [order[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]


def descend(x: np.ndarray, k: int = NEIGHBOURS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(n, k) neighbours of each node, nearest first, and their similarities; -1 and -inf fill up lists where n <= k."""
    n = len(x)
    nbr, sim, new = np.full((n, k), -1, np.int32), np.full((n, k), -np.inf, np.float32), np.zeros((n, k), bool)
    if n < 2:
        return nbr, sim
    leaf = max(leaf, 2 * k + 2)
    for tree in range(TABLES if n > leaf else 1):
        for at in _leaves(x, leaf, 1000 + tree):
            s = x[at] @ x[at].T
            np.fill_diagonal(s, -np.inf)
            take = min(k, len(at) - 1)
            best = np.argpartition(-s, take - 1, axis=1)[:, :take]
            _merge(nbr, sim, new, np.repeat(at, take), at[best].reshape(-1), np.take_along_axis(s, best, 1).reshape(-1))
    seed, moved = 0, n * k
    while moved > SETTLED * n * k:
        moved, seed = _round(x, nbr, sim, new, seed), seed + 1
    return nbr, sim


def _round(x: np.ndarray, nbr: np.ndarray, sim: np.ndarray, new: np.ndarray, seed: int) -> int:
    """Every node tells its neighbours and reverse neighbours of each other, where an edge is new; how many edges changed."""
    back, back_new = reverse(nbr, new, REVERSE, seed)
    members, fresh = np.hstack([nbr, back]), np.hstack([new, back_new])
    new[:] = False
    active = np.flatnonzero(fresh.any(1))
    held, size, moved = [], 0, 0
    for lo in range(0, len(active), JOINED):
        at = active[lo : lo + JOINED]
        m, f = members[at], fresh[at]
        y = x[m]
        s = np.matmul(y, y.transpose(0, 2, 1))
        worst = np.where(m >= 0, sim[m, -1], np.inf)
        tell = s > worst[:, :, None]
        tell &= f[:, :, None] | f[:, None, :]
        tell &= (m >= 0)[:, None, :]
        tell[:, np.arange(m.shape[1]), np.arange(m.shape[1])] = False
        i, pair = np.divmod(np.flatnonzero(tell), m.shape[1] ** 2)
        a, b = np.divmod(pair, m.shape[1])
        held.append((m[i, a], m[i, b], s[i, a, b]))
        size += len(i)
        if size > HELD or lo + JOINED >= len(active):
            moved += _merge(nbr, sim, new, *(np.concatenate(c) for c in zip(*held, strict=True)))
            held, size = [], 0
    return moved


def walk(x: np.ndarray, around: np.ndarray, starts: np.ndarray, queries: np.ndarray, own: np.ndarray, beam: int, expand: int, begin: int):
    """Yields (lo, places, scores) for blocks of queries: the beam that each ends with, best first; -1 and -inf fill up.

    A walk starts at the query's own node (-1: not here) and at the best of starts. A round expands the best nodes of the
    beam that it hasn't expanded, until none is left; a node that falls out of a beam can't come back.
    """
    n, step = len(x), max(1, min(WALKERS, SEEN // max(1, len(x))))
    for lo in range(0, len(queries), step):
        q, mine = queries[lo : lo + step], own[lo : lo + step]
        rows, seen = len(q), np.zeros(len(q) * n, bool)
        ids, score, opened = np.full((rows, beam), -1, np.int64), np.full((rows, beam), -np.inf, np.float32), np.zeros((rows, beam), bool)
        s = q @ x[starts].T
        take = min(begin, len(starts))
        best = np.argpartition(-s, take - 1, axis=1)[:, :take] if take else np.zeros((rows, 0), np.int64)
        key = np.unique(np.concatenate([(np.arange(rows)[:, None] * n + starts[best]).reshape(-1), np.flatnonzero(mine >= 0) * n + mine[mine >= 0]]))
        while len(key):
            seen[key] = True
            r, c = np.divmod(key, n)
            value = np.einsum("ij,ij->i", x[c], q[r])
            better = value > score[r, -1]
            r, c, value = r[better], c[better], value[better]
            if len(r):
                first = np.searchsorted(r, np.arange(rows))
                place = np.arange(len(r)) - first[r]
                moved = np.flatnonzero(np.bincount(r, minlength=rows))
                at = np.searchsorted(moved, r)
                all_ids, all_score, all_open = (np.full((len(moved), beam + int(place.max()) + 1), fill, kind) for fill, kind in ((-1, np.int64), (-np.inf, np.float32), (False, bool)))
                all_ids[:, :beam], all_score[:, :beam], all_open[:, :beam] = ids[moved], score[moved], opened[moved]
                all_ids[at, beam + place], all_score[at, beam + place], all_open[at, beam + place] = c, value, True
                kept = np.argsort(-all_score, axis=1)[:, :beam]
                ids[moved], score[moved], opened[moved] = (np.take_along_axis(t, kept, 1) for t in (all_ids, all_score, all_open))
            now = opened & (np.cumsum(opened, 1) <= expand)
            opened &= ~now
            r, c = np.nonzero(now)
            near = around[ids[r, c]]
            key = (r[:, None] * n + near)[near >= 0]
            key = np.unique(key[~seen[key]])
        yield lo, ids, score
