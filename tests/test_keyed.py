import random

import numpy as np
import pytest

from readprep.operators import counted as C
from readprep.operators import keyed
from readprep.operators import spectrum as S
from readprep.plans.read_queries import QUERIES
from tests.model import canonical, count_kmers

SCHEMA = "read_ix long, header string, sequence string, qualities string"


def number(kmer):
    return int("".join(str("ACGT".index(c)) for c in kmer), 4)


def test_packed_keys_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**62, 2**40 + 5], np.uint64)
    assert (keyed.unsqueeze(keyed.squeeze(values)[0].tobytes()) == values).all() and not len(keyed.unsqueeze(b""))
    keys = np.arange(0, 4**9, 7)
    mixed = np.sort(keyed.mixed(keys, 18))
    assert (np.sort(keyed.unmixed(mixed, 18)) == keys).all()
    bucket, edges, raw = keyed.split(mixed, 18, 4)
    assert (np.concatenate([keyed.joined(b, r.as_py(), 18, 4) for b, r in zip(bucket.tolist(), raw, strict=True)]) == mixed).all()


@pytest.mark.parametrize("chunk", [1, 1 << 21])
def test_support_and_attention_match_brute_force_and_shuffle_no_positions(spark, monkeypatch, chunk):
    monkeypatch.setattr(keyed, "CHUNK", chunk)
    monkeypatch.setattr(S, "HELD", 50 if chunk == 1 else 100_000)
    r, k, floor, q = random.Random(3), 7, 3, 20
    genome = "".join(r.choice("ACGT") for _ in range(150))
    rows = []
    for i in range(120):
        at = r.randrange(100)
        s = "".join(c if r.random() > 0.02 else r.choice("ACGTNa") for c in genome[at : at + r.randrange(3, 40)])
        rows.append((i, f"r{i}", s, "".join(chr(33 + r.randrange(5, 41)) for _ in s)))
    rows += [(200, "x", None, None), (201, "y", "", ""), (202, "z", "ACGTACG", "IIIIIII"), (203, "u", "ACGTACéGTACGTAA", "I" * 15)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counts = S.kmer_counts(df, k, q - 2)
    exact = count_kmers([(s, x) for _, _, s, x in rows if s], k, q - 2)
    assert {x.kmer: x.cnt for x in counts.collect()} == {number(w): n for w, n in exact.items()}
    want, seen = {}, set()
    for i, _, s, x in rows:
        for p in range(len(s or "") if len(s or "") >= k else 0):
            own = [exact.get(canonical(s[j : j + k]), 0) for j in range(max(p - k + 1, 0), min(p, len(s) - k) + 1)]
            want[i, p] = (min(own), sum(own), len(own))
            phred = ord(x[p]) - 33
            if phred < q or (phred <= q + 5 and min(own) < floor):
                seen.add((i, p, phred, *want[i, p]))
    support = S.position_support(df, counts, k)
    assert {(x.read_ix, x.pos): (x.least, x.total, x.windows) for x in support.collect()} == want
    assert {tuple(x) for x in S.attention(df, counts, k, q, floor).collect()} == seen
    plan = support._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # no row for a window or a position is shuffled


@pytest.mark.parametrize("pieces", [1 << 25, 40])
def test_substitutions_match_brute_force_and_shuffle_nothing(spark, monkeypatch, pieces):
    monkeypatch.setattr(C, "PIECE", pieces)
    monkeypatch.setattr(C, "TRIED", 1 << 15 if pieces > 40 else 7)
    r, k, floor, q = random.Random(4), 7, 3, 20
    genome = "".join(r.choice("ACGT") for _ in range(150))
    rows = []
    for i in range(150):
        at = r.randrange(100)
        s = "".join(c if r.random() > 0.03 else r.choice("ACGTNa") for c in genome[at : at + r.randrange(3, 40)])
        rows.append((i, f"r{i}", s, "".join(chr(33 + r.randrange(5, 41)) for _ in s)))
    rows += [(200, "x", None, None), (201, "y", "", ""), (202, "z", "ACGTACG", "!!!!!!!"), (203, "u", "ACGTACéGTACGTAA", "+" * 15)]
    rows += [(300 + i, "m", "ACCAGGTAC", "I" * 9) for i in range(300)] + [(700, "n", "ACCAGGTAC", "IIII!IIII")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    exact = count_kmers([(s, x) for _, _, s, x in rows if s], k, q - 2)
    table = C.collected(df, k, q - 2)
    assert max(exact.values()) > 255 and (len(table.pieces) > 1) == (pieces == 40)
    names = list(exact) + [w for w in ("".join(r.choice("ACGT") for _ in range(k)) for _ in range(3000)) if canonical(w) == w]
    assert table.find(np.array([number(w) for w in names] + [-1])).tolist() == [exact.get(w, 0) for w in names] + [0]
    want = set()
    for i, _, s, x in rows:
        for p in range(len(s or "") if len(s or "") >= k else 0):
            starts = range(max(p - k + 1, 0), min(p, len(s) - k) + 1)
            support = lambda t: [exact.get(canonical(t[j : j + k]), 0) if set(t[j : j + k]) <= set("ACGT") else 0 for j in starts]  # noqa: B023, E731
            own, phred = support(s), ord(x[p]) - 33
            if phred < q or (phred <= q + 5 and min(own) < floor):
                tried = [(-min(n), -sum(n), b) for b in "ACGT" if b != s[p] for n in [support(s[:p] + b + s[p + 1 :])]]
                least, total, b = min(tried)
                least, total = -least, -total
                better = least > min(own) or (least == min(own) and total > sum(own))
                want.add((i, p, b, least, total, better and ((least >= floor and least > min(own)) or total >= sum(own) + floor * len(own))))
    got = C.substitutions(df, table, k, q, floor)
    assert {tuple(x) for x in got.collect()} == want and {x[5] for x in want} == {True, False}


def test_substitution_candidates_shuffles_no_window(spark):
    plan = QUERIES["substitution_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan


@pytest.mark.parametrize("share", [1 << 25, 60])
def test_supports_are_those_of_the_filter_and_join_no_slots(spark, monkeypatch, share):
    monkeypatch.setattr(S, "ROUND", share)
    r, k, floor = random.Random(6), 9, 4
    genome = "".join(r.choice("ACGT") for _ in range(400))
    rows = [(i, "", s, "I" * len(s)) for i in range(200) for at in [r.randrange(360)] for s in [genome[at : at + 40]]] + [(900, "", "ACGTACGTACGT", "I" * 12), (901, "", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    counts = S.kmer_counts(df, k, 0)
    want = S.hybrid_lookup(counts, S.trusted(counts, floor), S.bloom(counts), S.bloom_shape(counts)).collect()
    got = S.supports(df, k, 0, floor)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 300
    assert S.supports(df.where("read_ix = 901"), k, 0, floor).collect() == []
    plan = QUERIES["bloom_lookup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
