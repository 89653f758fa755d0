import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from readprep.llm import gru
from readprep.llm import lm_scoring as S

UP = {c: c + 32 for c in range(65, 91)}


def held(doc, folds=10):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % folds == 0


def corpus(n=150, seed=4):
    r = random.Random(seed)
    languages = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    rows = []
    for d in range(n):
        words = r.choice(languages)
        rows.append((d, " ".join(words[min(int(r.expovariate(0.1)), 59)] for _ in range(r.randrange(0, 120)))))
    return rows + [(500, None), (501, ""), (502, "Unseen words HERE"), (None, "a1 b1"), (503, "rare"), (503, "rare"), (504, "a1 " * 3000)]


@pytest.mark.parametrize("most", [1 << 16, 20])
def test_base_scores_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(S.most_frequent, "__defaults__", (most,))
    rows = corpus()
    docs = [(d, (t or "").translate(UP).split()) for d, t in rows]
    count = collections.Counter()
    for d, w in docs:
        if not held(d):
            count.update([*w, None])
    total, distinct = sum(count.values()), len(count)
    want = []
    for d, w in docs:
        w = [*w, None]
        want.append((d, held(d), len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), 6)))
    got = S.lm_scores(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, c int").repartition(4)).collect()
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got)
    fresh = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_empty_and_untrainable_tables(spark):
    assert S.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = next(d for d in range(100) if held(d))
    (row,) = S.lm_scores(spark.createDataFrame([(only, "some words")], "doc_id long, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)
    assert math.isclose(row.base_score, 0.0, abs_tol=1e-9) and math.isfinite(row.score)


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(gru, "F32", np.float64)
    monkeypatch.setattr(gru, "_FACTOR", gru._FACTOR.astype(float))
    rng = np.random.default_rng(0)
    theta = gru.initial(np.arange(gru.VOCAB, 0, -1.0)).astype(float)
    p, grad = gru.views(theta), np.zeros(gru.LENGTH)
    p["cls"][:], p["out"][:] = rng.normal(0, 0.3, p["cls"].shape), rng.normal(0, 0.3, p["out"].shape)
    x, y = rng.integers(0, gru.VOCAB, (2, 6, 5))
    args = (x, y, rng.random((6, 5)) < 0.2, rng.normal(0, 0.1, (5, gru.HIDDEN)), p)
    gru.gradients(*args, gru.views(grad))
    loss = lambda: gru.gradients(*args, gru.views(np.zeros(gru.LENGTH)))[1]
    for i in rng.choice(np.flatnonzero(grad), 25):
        keep, e = theta[i], 1e-5
        theta[i] = keep + e
        up = loss()
        theta[i] = keep - e
        down = loss()
        theta[i] = keep
        assert math.isclose((up - down) / 2 / e, grad[i], rel_tol=1e-4, abs_tol=1e-8)


def test_what_fills_up_counts_for_nothing():
    rng = np.random.default_rng(3)
    theta = gru.initial(np.arange(gru.VOCAB, 0, -1.0))
    x, y = rng.integers(0, gru.VOCAB, (2, 6, 5))
    fresh, h = np.zeros((6, 5), bool), np.zeros((5, gru.HIDDEN), np.float32)
    real = np.ones((6, 5), bool)
    real[3:, 4] = False
    out = []
    for other in (0, 77):
        y[~real] = x[~real] = other
        g = np.zeros(gru.LENGTH, np.float32)
        gru.gradients(x, y, fresh, h, gru.views(theta), gru.views(g), real)
        out.append(g)
    assert np.allclose(*out, atol=1e-7) and np.abs(out[0]).max() > 0


@pytest.mark.parametrize("n", [1, 15, 17, 700, 20_300])
def test_every_token_is_learned(n):
    rng = np.random.default_rng(n)
    y = rng.integers(0, 50, n)
    trainer = gru.Trainer(gru.initial(np.arange(gru.VOCAB, 0, -1.0)))
    seen = []
    original = gru.gradients

    def watched(x, y, fresh, h, p, g, real=None):
        seen.append(y.size if real is None else int(real.sum()))
        return original(x, y, fresh, h, p, g, real)

    gru.gradients = watched
    try:
        trainer.feed(np.append(0, y[:-1]), y, np.arange(n) == 0)
    finally:
        gru.gradients = original
    assert trainer.tokens == n == sum(seen) and np.isfinite(trainer.theta).all()


def test_stretches_start_with_a_carried_state():
    rng = np.random.default_rng(2)
    trainer = gru.Trainer(gru.initial(np.arange(gru.VOCAB, 0, -1.0)))
    x, fresh = rng.integers(0, 90, 200), np.zeros(200, bool)
    fresh[[0, 90]] = True
    h = trainer._before(x, fresh, 2, 100)
    own = np.zeros((1, gru.HIDDEN), np.float32)
    for t in range(90, 100):  # the document that the second stretch starts in
        gates = trainer.p["emb"][x[[t]]] @ (trainer.p["win"] * gru._FACTOR) + trainer.p["bin"] * gru._FACTOR
        own = gru.step(gates, own, trainer.p["rec"] * gru._FACTOR)[0]
    assert np.allclose(h[1], own[0], atol=1e-5) and not h[0].any()


def test_a_task_that_diverges_fails(spark):
    class Bad:
        value = S.make_head([("a", 3)], 3, 1)

    theta = np.full(gru.LENGTH, np.nan, np.float32)
    with pytest.raises(FloatingPointError):
        list(S._train(Bad, theta)(iter([pa.RecordBatch.from_arrays([pa.array(["a a a"])], ["text"])])))


def plain_log_prob(ids, start, theta):
    """log10 probability of one document, token by token in double precision."""
    p = {k: v.astype(float) for k, v in gru.views(theta).items()}
    H, h, last, total = gru.HIDDEN, np.zeros(gru.HIDDEN), start, 0.0
    for token in ids:
        into, back = p["emb"][last] @ p["win"] + p["bin"], h @ p["rec"]
        update, reset = (1 / (1 + np.exp(-(into[i * H : (i + 1) * H] + back[i * H : (i + 1) * H]))) for i in (0, 1))
        h = update * h + (1 - update) * np.tanh(into[2 * H :] + reset * back[2 * H :])
        classes = h @ p["cls"] + p["cls_b"]
        c = token // gru.SIZE
        words = p["out"][c * gru.SIZE : (c + 1) * gru.SIZE] @ h + p["out_b"][c * gru.SIZE : (c + 1) * gru.SIZE]
        total += classes[c] - np.log(np.exp(classes).sum()) + words[token % gru.SIZE] - np.log(np.exp(words).sum())
        last = token
    return total / np.log(10)


def test_score_matches_a_plain_model(spark, monkeypatch):
    kept = {}
    train = S.train
    monkeypatch.setattr(S, "train", lambda docs, head: kept.setdefault("theta", train(docs, head)) if kept.update(head=head) is None else None)
    monkeypatch.setattr(S.most_frequent, "__defaults__", (40,))
    rows = corpus(60)
    got = S.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    docs = [(d, (t or "").translate(UP).split()) for d, t in rows]
    count = collections.Counter(x for d, w in docs if not held(d) for x in w)
    top = [w for w, _ in S.most_frequent(spark.createDataFrame(list(count.items()), "word string, c long"), 40)]
    rare = {w: c for w, c in count.items() if w not in top}
    log = math.log10(sum(rare.values()) + 0.1 * (len(rare) + 1))
    want = {}
    for d, w in docs:
        ids = [int(kept["head"].token[kept["head"].find(S.word_hash([x]))[0]]) if x in top else kept["head"].unknown for x in w]
        outside = sum(math.log10(count[x] + 0.1) - log for x in w if x not in top)
        want[(d, len(w))] = plain_log_prob([*ids, kept["head"].end], kept["head"].end, kept["theta"]) + outside
    for r in got:
        assert math.isclose(r.score, want[(r.doc_id, r.n_tokens - 1)], rel_tol=1e-3, abs_tol=1e-3)


def test_scores_are_probabilities_and_carry_state():
    rng = np.random.default_rng(1)
    theta = gru.initial(np.arange(gru.VOCAB, 0, -1.0))
    theta += rng.normal(0, 0.2, len(theta)).astype(np.float32)
    p = gru.views(theta)
    h = rng.normal(0, 0.5, (1, gru.HIDDEN)).astype(np.float32)
    every = gru.log_probs(np.repeat(h, gru.VOCAB, 0), np.arange(gru.VOCAB), p)
    assert math.isclose(np.exp(every.astype(float)).sum(), 1, rel_tol=1e-4)
    ids, first = rng.integers(0, 200, 400).astype(np.int32), np.array([0, 150, 150, 400])
    a = gru.score(ids, first, 3, theta, window=7)
    b = gru.score(ids, first, 3, theta, window=64, together=1)
    assert np.allclose(a, b, rtol=1e-4) and a[1] == 0
    alone = gru.score(ids[150:], np.array([0, 250]), 3, theta)
    assert math.isclose(alone[0], a[2], rel_tol=1e-4)
