"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state.

Token ids are ordered by frequency; id // SIZE is the token's class. P(token | state) = P(class | state) * P(token | class,
state). All parameters live in one flat float32 vector, so models are averaged and sent as such.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

HIDDEN = 16
CLASSES = 48
SIZE = 48
VOCAB = CLASSES * SIZE
#: Steps of truncated backpropagation, and parallel streams, of one update.
STEPS, LANES = 16, 512
#: Tokens before a stream's first one that its state is carried from.
BEFORE = 32
RATE = 0.015
LOG10 = float(np.log(10))
_SHAPES = {"emb": (VOCAB, HIDDEN), "win": (HIDDEN, 3 * HIDDEN), "bin": (3 * HIDDEN,), "rec": (HIDDEN, 3 * HIDDEN), "cls": (HIDDEN, CLASSES), "cls_b": (CLASSES,), "out": (VOCAB, HIDDEN), "out_b": (VOCAB,)}
LENGTH = sum(int(np.prod(s)) for s in _SHAPES.values())
F32 = np.float32


def views(theta: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = theta[at : at + n].reshape(shape)
        at += n
    return out


def initial(counts: np.ndarray, seed: int = 1) -> np.ndarray:
    """Parameters whose output, whatever the state, is the distribution of the counts (VOCAB of them, ids by frequency)."""
    rng = np.random.default_rng(seed)
    theta = np.zeros(LENGTH, F32)
    p = views(theta)
    p["emb"][:] = rng.normal(0, 0.3, p["emb"].shape)
    p["win"][:] = rng.normal(0, HIDDEN**-0.5, p["win"].shape)
    p["rec"][:] = rng.normal(0, 0.5 * HIDDEN**-0.5, p["rec"].shape)
    p["bin"][:HIDDEN] = 1.0  # the update gate leans towards keeping the state
    share = (counts + 0.1) / (counts + 0.1).sum()
    by_class = share.reshape(CLASSES, SIZE).sum(1)
    p["cls_b"][:] = np.log(by_class)
    p["out_b"][:] = np.log(share / np.repeat(by_class, SIZE))
    return theta


#: Gate values are kept times these factors, so that 1 / (1 + exp(value)) is the sigmoid of a gate, or of twice a candidate.
_FACTOR = np.concatenate([np.full(2 * HIDDEN, -1, F32), np.full(HIDDEN, -2, F32)])


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)) in place; an overflow of exp is 0 as it should be."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(x: np.ndarray, h: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, ...]:
    """(new state, gates, candidate, candidate's recurrent part) from input gate values x and state h; both scaled by _FACTOR."""
    r = h @ rec
    part = r[:, 2 * HIDDEN :]
    gates = _logistic(x[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
    cand = gates[:, HIDDEN:] * part
    cand += x[:, 2 * HIDDEN :]
    _logistic(cand)
    cand *= 2
    cand -= 1
    new = h - cand
    new *= gates[:, :HIDDEN]
    new += cand
    return new, gates, cand, part


def _log_softmax(logits: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Log probability of the wanted column; logits are overwritten. Values too large for exp are shifted first."""
    chosen = logits[np.arange(len(want)), want]
    top = float(logits.max(initial=0))
    if top > 60:
        shift = logits.max(1)
        logits -= shift[:, None]
        chosen = chosen - shift
    np.exp(logits, out=logits)
    return chosen - np.log(logits.sum(1))


def _slopes(logits: np.ndarray, want: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """(sum of log probabilities of the wanted columns, (probabilities - wanted) / n); logits are overwritten."""
    rows = np.arange(len(want))
    if float(logits.max(initial=0)) > 60:
        logits -= logits.max(1)[:, None]
    chosen = logits[rows, want].sum()
    np.exp(logits, out=logits)
    total = logits.sum(1)
    logits *= (1 / (total * n))[:, None]
    logits[rows, want] -= F32(1 / n)
    return chosen - np.log(total).sum(), logits


def _by_class(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cls = y // SIZE
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    return order, np.searchsorted(cls[order], np.arange(CLASSES + 1))


def log_probs(h: np.ndarray, y: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Natural log probability of each token y from its state h."""
    logits = h @ p["cls"]
    logits += p["cls_b"]
    out = _log_softmax(logits, y // SIZE)
    order, edge = _by_class(y)
    h, y, within = h[order], y[order], np.empty(len(y), F32)
    for c in range(CLASSES):
        i, j = edge[c], edge[c + 1]
        if i < j:
            words = slice(c * SIZE, (c + 1) * SIZE)
            logits = h[i:j] @ p["out"][words].T
            logits += p["out_b"][words]
            within[i:j] = _log_softmax(logits, y[i:j] - c * SIZE)
    out[order] += within
    return out


def gradients(x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h0: np.ndarray, p: dict[str, np.ndarray], g: dict[str, np.ndarray], real: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Fills g with the gradients of the mean loss over (steps, lanes) of inputs x and targets y; (last state, loss).

    fresh marks where a document starts, at which the state is 0. Where real is false nothing is to be learned.
    """
    steps, lanes = x.shape
    n = steps * lanes
    counted = np.arange(n) if real is None else np.flatnonzero(real.reshape(-1))
    emb = p["emb"][x.reshape(-1)]
    gates_in = (emb @ (p["win"] * _FACTOR) + p["bin"] * _FACTOR).reshape(steps, lanes, 3 * HIDDEN)
    rec = p["rec"] * _FACTOR
    starts = [np.flatnonzero(f) for f in fresh]
    h, saved, states = h0, [], np.empty((steps, lanes, HIDDEN), F32)
    for t in range(steps):
        if len(starts[t]):
            h = h.copy()
            h[starts[t]] = 0
        new, gates, cand, part = step(gates_in[t], h, rec)
        saved.append((h, gates, cand, part))
        states[t] = h = new
    every = states.reshape(n, HIDDEN)
    whole = len(counted) == n
    flat, target, m = (every, y.reshape(-1), n) if whole else (every[counted], y.reshape(-1)[counted], len(counted))
    for a in g.values():
        a[...] = 0
    # output layer
    logits = flat @ p["cls"]
    logits += p["cls_b"]
    loss, prob = _slopes(logits, target // SIZE, m)
    g["cls"][...], g["cls_b"][...] = flat.T @ prob, prob.sum(0)
    d_flat = prob @ p["cls"].T
    order, edge = _by_class(target)
    sorted_h, sorted_y = flat[order], target[order]
    d_sorted = np.empty_like(sorted_h)
    for c in range(CLASSES):
        i, j = edge[c], edge[c + 1]
        if i < j:
            words = slice(c * SIZE, (c + 1) * SIZE)
            logits = sorted_h[i:j] @ p["out"][words].T
            logits += p["out_b"][words]
            more, prob = _slopes(logits, sorted_y[i:j] - c * SIZE, m)
            loss += more
            g["out"][words], g["out_b"][words] = prob.T @ sorted_h[i:j], prob.sum(0)
            d_sorted[i:j] = prob @ p["out"][words]
    d_flat[order] += d_sorted
    d_states = d_flat
    if not whole:
        d_states = np.zeros((n, HIDDEN), F32)
        d_states[counted] = d_flat
    d_states = d_states.reshape(steps, lanes, HIDDEN)
    # back through the steps
    d_in = np.empty((steps, lanes, 3 * HIDDEN), F32)
    d_rec = np.empty((lanes, 3 * HIDDEN), F32)
    carry = np.zeros((lanes, HIDDEN), F32)
    for t in range(steps - 1, -1, -1):
        h, gates, cand, part = saved[t]
        update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        d = d_states[t]
        d += carry
        keep = d * update
        d_cand = d - keep
        d_cand *= 1 - cand * cand
        both = gates - gates * gates  # slopes of the gates
        both[:, :HIDDEN] *= d
        both[:, :HIDDEN] *= h - cand
        both[:, HIDDEN:] *= d_cand
        both[:, HIDDEN:] *= part
        both[:, HIDDEN:] *= F32(-0.5)  # part is kept times -2
        d_in[t, :, : 2 * HIDDEN] = d_rec[:, : 2 * HIDDEN] = both
        d_in[t, :, 2 * HIDDEN :] = d_cand
        np.multiply(d_cand, reset, out=d_rec[:, 2 * HIDDEN :])
        g["rec"] += h.T @ d_rec
        carry = d_rec @ p["rec"].T
        carry += keep
        if len(starts[t]):
            carry[starts[t]] = 0
    flat_in = d_in.reshape(n, 3 * HIDDEN)
    g["win"][...], g["bin"][...] = emb.T @ flat_in, flat_in.sum(0)
    d_emb = flat_in @ p["win"].T
    ids = x.reshape(-1)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
    g["emb"][ids[order][first]] = np.add.reduceat(d_emb[order], first, axis=0)
    return states[-1], float(-loss / m)


@dataclass
class Trainer:
    """Adam over updates of STEPS x LANES tokens; tokens are streams of whole documents, fed as they come."""

    theta: np.ndarray
    rate: float = RATE
    tokens: int = 0
    losses: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.theta = self.theta.copy()
        self.p = views(self.theta)
        self.grad = np.zeros(LENGTH, F32)
        self.g = views(self.grad)
        self.m, self.v, self.n = np.zeros(LENGTH, F32), np.zeros(LENGTH, F32), 0

    def feed(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray) -> None:
        """Learns from every token of one stream: it is cut into LANES stretches that run side by side, with carried state.

        A stretch starts with the state that the BEFORE tokens in front of it lead to. The last may be shorter than the others;
        what fills it up counts for nothing.
        """
        if not len(x):
            return
        lanes = int(min(LANES, max(1, len(x) // STEPS)))
        length = -(-len(x) // lanes)
        lanes = -(-len(x) // length)
        h = self._before(x, fresh, lanes, length)
        real = (np.arange(lanes * length) < len(x)).reshape(lanes, length).T
        x, y, fresh = (np.ascontiguousarray(np.append(a, np.zeros(lanes * length - len(a), a.dtype)).reshape(lanes, length).T) for a in (x, y, fresh))
        for t in range(0, length, STEPS):
            part = slice(t, t + STEPS)
            h, loss = gradients(x[part], y[part], fresh[part], h, self.p, self.g, None if real[part].all() else real[part])
            self.update()
            self.losses.append(loss)
        self.tokens += int(real.sum())

    def _before(self, x: np.ndarray, fresh: np.ndarray, lanes: int, length: int) -> np.ndarray:
        """The state of each stretch from the tokens in front of it; the first has none."""
        h = np.zeros((lanes, HIDDEN), F32)
        rec = self.p["rec"] * _FACTOR
        for t in range(min(BEFORE, length), 0, -1):
            at = np.arange(1, lanes) * length - t
            own = h[1:]
            own[fresh[at]] = 0
            gates_in = self.p["emb"][x[at]] @ (self.p["win"] * _FACTOR) + self.p["bin"] * _FACTOR
            h[1:] = step(gates_in, own, rec)[0]
        return h

    def update(self) -> None:
        self.n += 1
        norm = float(np.sqrt(self.grad @ self.grad))
        if norm > 1:
            self.grad /= norm
        self.m += 0.1 * (self.grad - self.m)
        self.v += 0.01 * (self.grad * self.grad - self.v)
        rate = self.rate * (1 - 0.99**self.n) ** 0.5 / (1 - 0.9**self.n)
        self.theta -= rate * self.m / (np.sqrt(self.v) + 1e-8)


def score(ids: np.ndarray, first: np.ndarray, start: int, theta: np.ndarray, window: int = 32, together: int = 65_536) -> np.ndarray:
    """log10 probability of each whole document ids[first[r]:first[r + 1]]; the state is carried from window to window.

    A window has fewer steps where many documents run side by side, so that about `together` states are held at once.
    """
    p = views(theta)
    gates_in = (p["emb"] @ p["win"] + p["bin"]) * _FACTOR
    rec = p["rec"] * _FACTOR
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[order], lengths[order]
    total = np.zeros(len(order))
    if not len(order) or not lengths[0]:
        return total
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right").tolist()
    h = np.zeros((len(order), HIDDEN), F32)
    last = np.full(len(order), start, np.int64)
    t0 = 0
    while t0 < len(active):
        states, targets, docs = [], [], []
        upto = min(t0 + max(1, min(window, together // active[t0])), len(active))
        for t in range(t0, upto):
            n = active[t]
            h = step(gates_in[last[:n]], h[:n], rec)[0]
            last = ids[begin[:n] + t]
            states.append(h)
            targets.append(last)
            docs.append(n)
        got = log_probs(np.concatenate(states), np.concatenate(targets), p)
        at = 0
        for n in docs:
            total[:n] += got[at : at + n]
            at += n
        t0 = upto
    out = np.empty(len(order))
    out[order] = total / LOG10
    return out
