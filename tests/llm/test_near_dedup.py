import random

import numpy as np
import pytest

from readprep.llm import near_dedup as N
from readprep.llm.graph import components


def shingles(text, k=5):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or (both and 100 * both >= 75 * len(sets[i] | sets[j])):
                up[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None), default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d is None or d == c))
    return sorted(out, key=repr)


def copies(seed, groups=3, size=25, words=120):
    r, rows, d = random.Random(seed), [], 0
    for _ in range(groups):
        base = [f"w{r.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            t = base[:]
            for _ in range(r.randrange(0, 8)):
                t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
            rows.append((d, " ".join(t)))
            d += 1
    for _ in range(10):
        rows.append((d, " ".join(f"w{r.randrange(5000)}" for _ in range(r.randrange(1, 60)))))
        d += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("pairwise", [8, 1])
def test_matches_brute_force(spark, monkeypatch, pairwise):
    monkeypatch.setattr(N, "PAIRWISE", pairwise)
    rows = copies(5) + [(900, None), (901, ""), (902, "a b"), (903, "A B"), (904, "a b c"), (905, "r r r r r r r r r"), (None, "a b"), (906, " \t\n"), (907, "z " * 3000), (907, "z " * 3000)]
    df = spark.createDataFrame([(*x, 0, "c") for x in rows], "doc_id long, text string, band int, ID string").repartition(4)
    got = sorted((tuple(r) for r in N.near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    r = random.Random(2)
    names = list(range(300))
    r.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(99)] + [(names[100], names[i]) for i in range(101, 200)] + [(names[200 + i], names[200 + (i + 1) % 50]) for i in range(50)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {}
    for lo, hi in ((0, 100), (100, 200), (200, 250)):
        want |= {n: min(names[lo:hi]) for n in names[lo:hi]}
    assert got == want


@pytest.mark.parametrize("few", [10**6, 0])
def test_components_of_few_links_take_few_jobs(spark, few):
    rng = random.Random(5)
    links = [(rng.randrange(400) - 200, rng.randrange(400) - 200) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(2**62, -(2**62))]
    best = {n: n for a, b in links if a != b for n in (a, b)}
    for _ in best:
        for a, b in links:
            if a != b:
                best[a] = best[b] = min(best[a], best[b])
    tracker, group = spark.sparkContext.statusTracker(), f"components-{few}"
    spark.sparkContext.setJobGroup(group, group)
    table = spark.createDataFrame(links, "u long, v long")
    found = components(table) if few else components(table, few=0)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {x.node: x.component for x in found.collect()} == best
    assert few == 0 or jobs <= 8  # rounds of joins took 94


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**64, 3000, np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[1000:])
    s = N.signatures(np.concatenate([a, b]), np.array([0, 2000, 4000]), 200)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.08


def test_bands_catch_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(300):
        pool = rng.integers(0, 2**64, 350, np.uint64)
        a, b = np.sort(pool[:300]), np.sort(pool[50:])  # 250 of 350 would be 0.714; 300 each
        keys = N.band_keys(N.signatures(np.concatenate([a, b]), np.array([0, 300, 600])))
        met += bool((keys[0] == keys[1]).any())
    assert met == 300


@pytest.mark.parametrize("apart", [1_000_000, 40])
def test_small_sets_and_long_lists(spark, monkeypatch, apart):
    monkeypatch.setattr(N, "HOT", 6)
    monkeypatch.setattr(N, "APART", apart)
    r = random.Random(31)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(160):  # short texts that differ at their ends, so that many sets share rare shingles
        rows.append((i, " ".join(base[: r.randrange(6, 26)] + [f"x{r.randrange(4)}" for _ in range(r.randrange(0, 3))])))
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute(rows)


def test_rows_of_one_id_share_their_links(spark):
    words = [f"a{i}" for i in range(30)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (2, "something else that stands alone here"), (3, "something else that stands alone here"), (4, "q r s t u v")]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute(rows)


def test_only_sets_of_pairs_are_shuffled(spark):
    sets = N.cut(spark.range(3000).selectExpr("id", "array(id, id + 1, id + 2, id + 3) as shingles").union(spark.createDataFrame([(5000, [7, 8, 9, 10]), (5000, [1, 2])], "id long, shingles array<long>")))
    pairs = spark.createDataFrame([(7, 5000), (8, 5000), (7, 8)], "u long, v long")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    assert [tuple(x) for x in N.confirm(pairs, sets).collect()] == [(7, 5000)]
    assert written() - before < 200  # both sides took every set: 6004 rows
