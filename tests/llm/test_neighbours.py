import numpy as np
import pytest

from readprep.llm import neighbours as N


def brute(rows, every=20, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def rows_of(n, d, seed, norms=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms:
        x *= rng.uniform(0.2, 3, (n, 1))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("norms", [False, True])
def test_recall_ranks_and_scores(spark, norms):
    rows = rows_of(1500, 24, 3, norms)
    rows += [(2000 + i, rows[7][1]) for i in range(60)]  # a vector that many rows share
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = {}
    for r in N.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert sorted(mine, key=lambda m: (-m[2], m[1])) == mine
        exact = dict(brute([r for r in rows if r[0] == q or r[0] in {m[1] for m in mine}], every=q or 1).get(q))
        assert all(abs(exact[m[1]] - m[2]) < 1e-12 for m in mine)
        hits += len({m[1] for m in mine} & {i for i, _ in best})
    assert hits / (20 * len(want)) >= 0.9


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, [1.0]), (40, None), (1, [0.5, 0.5])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARED", 0)
    rows = rows_of(300, 8, 5)
    want = brute(rows)
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert hits / (20 * len(want)) >= 0.95


def test_empty_table(spark):
    assert N.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def scattered(spark, lengths, seed, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(len(lengths), d))
    x *= (lengths / np.linalg.norm(x, axis=1))[:, None]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def share(got, want):
    return sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got) / sum(map(len, want.values()))


def test_few_long_vectors_are_found(spark):
    lengths = np.where(np.arange(1500) % 100 == 7, 10.0, 1.0)
    rows, df = scattered(spark, lengths, 11)
    assert share(N.nearest(df, beam=40).collect(), brute(rows)) >= 0.95


def test_a_node_alone_in_its_leaves_is_linked_both_ways(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 2)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.02, (600, 8)) + np.eye(8)[0], -np.eye(8)[:1]])  # one vector away from all others
    x[[0, 600]] = x[[600, 0]]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = N.nearest(df, every=40).collect()
    assert sorted(r["rank"] for r in got if r.query_id == 0) == list(range(1, 21))
    codes = df.selectExpr("vec_id as id", "embedding as vector").mapInArrow(N._encode(2.0), "id long, code binary, scale float")
    graph = N.build(N.cut(codes), 601, 8)
    assert graph.where("src = 0").count() == N.NEIGHBOURS and graph.select("src").distinct().count() == 601


def test_recall_is_checked_and_made_up_for(spark, monkeypatch):
    monkeypatch.setattr(N, "STARTS", 1)
    rows, df = scattered(spark, np.ones(400), 5, 48)
    assert share(N.nearest(df, neighbours=2, beam=1).collect(), brute(rows)) >= 0.95


def test_many_shards_and_equal_queries_take_few_jobs(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW", 64, raising=False)  # four shards
    rows = rows_of(900, 16, 21, norms=True)
    rows += [(1000 + 20 * i, rows[i % 3][1]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    tracker, group = spark.sparkContext.statusTracker(), "neighbours"
    spark.sparkContext.setJobGroup(group, group)
    got = N.nearest(df).collect()
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = brute(rows)
    assert len(got) == 20 * len(want) and share(got, want) >= 0.95
    assert sorted((r.query_id, r["rank"]) for r in got) == [(q, i + 1) for q in sorted(want) for i in range(20)]
    assert [(r.vec_id, r["rank"]) for r in got if r.query_id == 1600 and r["rank"] <= 3] == [(i, n + 1) for n, (i, _) in enumerate(want[1600][:3])]
    assert jobs <= 100  # rounds of joins over walks of every query took 156
