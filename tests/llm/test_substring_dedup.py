import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readprep.llm import bytetext
from readprep.llm import substring_dedup as S


def brute(rows, window):
    """rows: (doc_id, text); places are judged on the input."""
    first, out = {}, {}
    words = {}
    for key, (doc, text) in enumerate(rows):
        words[key] = (text or "").encode().split()
        if doc is None:
            continue
        for i in range(len(words[key]) - window + 1):
            g = tuple(words[key][i : i + window])
            first[g] = min(first.get(g, (doc, i)), (doc, i))
    for key, (doc, _) in enumerate(rows):
        w = words[key]
        gone = [False] * len(w)
        if doc is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < (doc, i):
                    gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[key] = (doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=repr)


def corpus(seed, docs=60, letters=4):
    r = random.Random(seed)
    passages = [[r.choice("abcdefgh"[:letters]) + str(r.randrange(9)) for _ in range(r.randrange(20, 60))] for _ in range(6)]
    rows = []
    for d in range(docs):
        t = []
        for _ in range(r.randrange(0, 5)):
            t += r.choice(passages) if r.random() < 0.5 else [r.choice("xyz") + str(r.randrange(99)) for _ in range(r.randrange(1, 40))]
        if r.random() < 0.1:
            t += ["same"] * r.randrange(1, 90)
        rows.append((d, (r.choice([" ", "\n", " \t "])).join(t)))
    return rows


@pytest.mark.parametrize("hot", [2000, 3])
def test_matches_brute_force(spark, hot):
    rows = corpus(7) + [(100, None), (101, ""), (102, "é " * 25), (None, "é " * 25), (103, "é " * 30)]
    r = random.Random(1)
    shuffled = rows[:]
    r.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "doc_id long, text string").withColumn("DOC_ID2", F.lit(1)).withColumn("bucket", F.lit("x")).repartition(5)
    got = sorted((tuple(x) for x in S.substring_dedup(df, hot_count=hot).collect()), key=repr)
    assert got == brute(rows, 20)


def test_repeated_rows_keep_alike(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (6, text)], "doc_id long, text string")
    got = {(x.doc_id, x.n_removed) for x in S.substring_dedup(df).collect()}
    assert got == {(5, 0), (6, 30)}


def test_empty_table(spark):
    assert S.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_window_minima():
    v = np.random.default_rng(3).integers(0, 6, 200).astype(np.uint64)
    for width in (1, 2, 5, 13):
        low, twice = S.window_minima(v, width)
        for i in range(len(v) - width + 1):
            part = v[i : i + width]
            assert low[i] == part.min() and twice[i] == ((part == part.min()).sum() > 1)


class Value:
    def __init__(self, value):
        self.value = value


def depart(rows):
    """Travelling rows of one task that finds every minimiser repeated and hot."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in rows], "text_key": [0] * len(rows), "text": [t for _, t in rows]})
    hot = np.unique(S.super_kmers(bytetext.words(batch["text"]))[3])
    return pa.Table.from_batches(S._depart(20, 8, Value(b"\xff" * (S.FILTER_BITS // 8)), hot)([batch]), S._TRAVEL_ARROW)


@pytest.mark.parametrize("sent", [S.SENT, 7, 0])
def test_hot_windows_batch_by_batch(monkeypatch, sent):
    monkeypatch.setattr(bytetext, "row_slices", lambda column: ((i, i + 1) for i in range(len(column))))
    monkeypatch.setattr(S, "SENT", sent)
    rows = corpus(11)
    random.Random(2).shuffle(rows)
    travel = depart(rows).sort_by("bucket")
    gone = {d: set() for d, _ in rows}
    for ranges in S._arrive(20)(iter(travel.to_batches())):
        for r in ranges.to_pylist():
            gone[r["doc_id"]].update(range(r["from_word"], r["to_word"]))
    assert sorted((d, len(x)) for d, x in gone.items()) == sorted((d, n) for d, _, n, _ in brute(rows, 20))


def test_a_task_sends_a_shared_line_once(monkeypatch):
    monkeypatch.setattr(bytetext, "row_slices", lambda column: ((i, i + 1) for i in range(len(column))))
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(d, line) for d in range(50)]
    assert depart(rows)["packed"].null_count == 49
    # from the other end every document is the earliest so far, and all of them arrive
    assert depart(rows[::-1])["packed"].null_count == 0
