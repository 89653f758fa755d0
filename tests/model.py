"""A plain model of per-read correction: every rule lists all candidates, and picks one by a key. Slow and simple.

Reads are strings and lists of qualities. An edit is a new string; which of them wins is a matter of sorting.
"""

from __future__ import annotations

from itertools import groupby, product

OTHER_STRAND = str.maketrans("ACGT", "TGCA")


def canonical(kmer: str) -> str | None:
    return None if set(kmer) - set("ACGT") else min(kmer, kmer.translate(OTHER_STRAND)[::-1])


def count_kmers(reads, k, q):
    out: dict[str, int] = {}
    for seq, qual in reads:
        for i in range(len(seq) - k + 1):
            c = canonical(seq[i : i + k])
            if c and min(map(ord, qual[i : i + k])) - 33 >= q:
                out[c] = out.get(c, 0) + 1
    return out


def earliest_best(candidates, key):
    """The first of the candidates with the greatest key."""
    return max(candidates, key=key) if candidates else None


class Model:
    def __init__(self, counts, k, floor, min_quality, adapters, lookup=None):
        self.k, self.floor, self.q, self.adapters = k, floor, min_quality, adapters
        trusted = {x: n for x, n in counts.items() if n >= floor}
        self.look = lookup or (lambda c: trusted.get(c, 0))
        self.edges = {node: sorted(((n, x[-1], x[1:]) for x, n in trusted.items() if x[:-1] == node), key=lambda e: (-e[0], e[1])) for node in {x[:-1] for x in trusted}}

    def support(self, seq, at):
        """(least, total) over the windows that hold a position, and how many they are."""
        found = [self.look(c) if (c := canonical(seq[i : i + self.k])) else 0 for i in range(len(seq) - self.k + 1) if i <= at < i + self.k]
        return (min(found, default=0), sum(found)), len(found)

    def adapter_start(self, seq):
        hits = []
        for order, (_, adapter, support) in enumerate(self.adapters):
            for over in range(8, max(28, len(adapter)) + 1):
                n = min(over, len(adapter))
                same = sum(a == b for a, b in zip(seq[len(seq) - over :], adapter, strict=False))
                if over <= len(seq) and len(adapter) >= 8 and 100 * (n - same) <= 15 * n:
                    hits.append(((8 * same - 3 * n + n - same + support, over - len(seq), -order), len(seq) - over))
        return max(hits)[1] if hits else None

    def substituted(self, seq, at, quality):
        """The sequence with another base at a position, or None."""
        now, windows = self.support(seq, at)
        if not windows or quality > self.q + 5 or (quality >= self.q and now[0] >= self.floor):
            return None
        tries = [(self.support(new, at)[0], new) for new in (seq[:at] + b + seq[at + 1 :] for b in "ACGT") if new != seq]
        value, new = earliest_best(tries, key=lambda t: t[0])
        enough = (value[0] >= self.floor and value[0] > now[0]) or value[1] >= now[1] + max(self.floor, 1) * windows
        return new if value > now and enough else None

    def indel(self, seq, at):
        """(kind, bases) of the edit of a position, or None."""
        now, windows = self.support(seq, at)
        if not windows or now[0] >= self.floor:
            return None

        def value(edit):
            kind, bases = edit
            new = seq[:at] + seq[at + len(bases) :] if kind == "deletion" else seq[:at] + bases + seq[at:]
            return self.support(new, min(at, len(new) - 1))[0]

        longest = max([n for n in range(1, 6) if at + n <= len(seq) and len(seq) > self.k + (n if n > 1 else 0)], default=0)
        tries = [("deletion", seq[at : at + n]) for n in range(1, longest + 1)] + [("insertion", b) for b in "ACGT"]
        best = earliest_best([t for t in tries if value(t) > now], value)
        while best and best[0] == "insertion" and len(best[1]) < 5:
            longer = earliest_best([t for t in (("insertion", best[1] + b) for b in "ACGT") if value(t) > value(best)], value)
            if not longer:
                break
            best = longer
        return best if best and value(best)[0] >= 2 * self.floor else None

    def process(self, seq, qual, parity=True):
        quality = [max(ord(c) - 33, 0) for c in qual]
        hit = self.adapter_start(seq)
        limit = len(seq) if hit is None else hit
        positions, indels = [], []
        for at in range(limit):
            new = self.substituted(seq, at, quality[at])
            if new:
                seq = new
                positions.append(at)
        at = 0
        while at < min(limit, len(seq)):
            free = quality[at] < self.q and all(before // 50 != at // 50 for before, _, _ in indels[-1:])
            edit = self.indel(seq, at) if free else None
            if edit is None:
                at += 1
                continue
            kind, bases = edit
            n = len(bases)
            indels.append((at, kind, bases))
            inserted = kind == "insertion"
            seq = seq[:at] + (bases + seq[at:] if inserted else seq[at + n :])
            quality = quality[:at] + ([30] * n + quality[at:] if inserted else quality[at + n :])
            at += n + 1 if inserted else 0
        end = limit if parity or hit is not None else len(seq)
        kept = quality[:end]
        poor = next((i for i, x in enumerate(reversed(kept)) if x + 2 >= self.q), len(kept))
        if poor >= 3:
            end = len(kept) - poor
        trimmed, seq, quality = max(0, len(seq) - end), seq[:end], quality[:end]
        if self.edges and parity:
            low = [(quality[i] if i < len(quality) else 0) < self.q for i in range(len(seq))]
            at = 0
            for poor, run in groupby(low):
                n = len(list(run))
                new = self.region(seq, at, n) if poor and 2 <= n <= 10 else None
                if new:
                    positions += [p for p in (at + j for j, b in enumerate(new) if j >= n or b != seq[at + j]) if p not in positions]
                    seq = seq[:at] + new + seq[at + n :]
                at += n
        return seq, "".join(chr(33 + x) for x in quality), positions, indels, trimmed

    def paths(self, node, length, branches):
        """(weakest count, labels, last node) of all paths, those over later edges first."""
        if not length:
            yield float("inf"), "", node
            return
        for n, label, target in reversed(self.edges.get(node, [])[:branches]):
            for weakest, labels, last in self.paths(target, length - 1, branches):
                yield min(n, weakest), label + labels, last

    def region(self, seq, start, n):
        """Bases that fit better between the anchors of a region, or None."""
        side = self.k - 1
        before, after = seq[start - side : start] if start >= side else "", seq[start + n : start + n + side]
        if len(before) < side or len(after) < side or set(before + after) - set("ACGT"):
            return None
        lengths = [n] + [m for d, sign in product(range(1, min(5, n - 1) + 1), (-1, 1)) if (m := n + sign * d) <= 15]
        found = [(weakest, labels) for m in lengths for weakest, labels, last in self.paths(before, m, 4 if m == n else 3) if last == after]
        best = earliest_best(found, key=lambda f: f[0])
        return best[1] if best and best[1] != seq[start : start + n] else None
