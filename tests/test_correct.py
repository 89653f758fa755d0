import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readprep.operators import correct as C
from readprep.operators import spectrum as S
from readprep.operators.adapters import best_hit
from readprep.operators.correct import best_path, collect_spectrum, process_reads
from readprep.operators.evaluate import last_by, paired_truth, scored, single_truth, summarise
from readprep.operators.pipeline import benchmark, keep, prepare, prepare_pairs, report
from readprep.operators.profile import Plan
from tests.model import Model, canonical, count_kmers

ADAPTERS = [("illumina-universal", "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA", 5), ("illumina-short", "AGATCGGAAGAGC", 9)]


def damaged_reads(seed, n=220, length=60, k=9):
    """Reads of a small genome with substitutions, insertions, deletions, bursts, adapters and unknown bases."""
    r = random.Random(seed)
    genome = "".join(r.choice("ACGT") for _ in range(300))
    out = []
    for i in range(n):
        at = r.randrange(len(genome) - length)
        s, q = list(genome[at : at + length]), [r.randrange(30, 41) for _ in range(length)]
        kind = r.randrange(8)
        p = r.randrange(5, length - 12)
        if kind == 1:
            s[p], q[p] = r.choice("ACGT"), 3
        elif kind == 2:
            del s[p : p + r.randrange(1, 3)]
            q = q[: len(s)]
            q[p] = 4
        elif kind == 3:
            more = r.randrange(1, 4)
            s[p:p], q[p:p] = [r.choice("ACGT") for _ in range(more)], [5] * more
        elif kind == 4:
            for j in range(p, p + r.randrange(2, 6)):
                s[j], q[j] = r.choice("ACGT"), 6
        elif kind == 5:
            s, q = s[:35] + list(ADAPTERS[0][1][:20]), q[:35] + [20] * 20
        elif kind == 6:
            q[-6:] = [2] * 6
        elif kind == 7:
            s[p] = "N"
            q[p] = 2
        out.append((i, f"r{i}", "".join(s), "".join(chr(33 + x) for x in q)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 6])
def test_matches_the_plain_model(spark, seed, monkeypatch):
    monkeypatch.setattr(C, "CELLS", 1 << 12 if seed == 2 else 1 << 20)
    monkeypatch.setattr(C, "PLACES", 7 if seed == 6 else 1 << 15)
    k, floor, q = 9, 3, 20
    rows = damaged_reads(seed)
    df = spark.createDataFrame(rows, "read_ix long, header string, sequence string, qualities string").repartition(3)
    counts = S.kmer_counts(df, k, q - 2)
    s = collect_spectrum(counts, k, floor, hybrid=False)
    got = {r.read_ix: r for r in process_reads(best_hit(df, ADAPTERS), s, q, parity=True).collect()}
    model = Model(count_kmers([(x[2], x[3]) for x in rows], k, q - 2), k, floor, q, ADAPTERS)
    edits = 0
    for ix, _, seq, qual in rows:
        want = model.process(seq, qual)
        r = got[ix]
        edits += len(want[2]) + len(want[3])
        assert (r.sequence, r.qualities, r.corrected_positions, [tuple(x) for x in r.indels], r.trimmed_bases) == (*want[:4], want[4]), ix
    assert edits > 20


def test_hybrid_lookup_matches_the_filter(spark):
    k, floor = 9, 4
    df = spark.createDataFrame(damaged_reads(3), "read_ix long, header string, sequence string, qualities string")
    counts = S.kmer_counts(df, k, 0).persist()
    s = collect_spectrum(counts, k, floor)
    shape = S.bloom_shape(counts)
    got = {r.kmer: r.support for r in S.hybrid_lookup(counts, S.trusted(counts, floor), S.bloom(counts), shape).collect()}
    keys = np.array(sorted(got), np.int64)
    assert s.count(keys).tolist() == [got[x] for x in keys.tolist()]
    exact = {r.kmer: r.cnt for r in counts.collect()}
    assert all(got[x] >= min(exact[x], 15) for x in exact)


def test_spectrum_in_pieces_is_mapped_and_not_held_by_the_driver(spark, monkeypatch):
    import tracemalloc

    monkeypatch.setattr(C, "PIECE", 1 << 18)
    n = 2_000_000
    counts = spark.range(n).selectExpr("id * 7919 as kmer", "1 + id % 5 as cnt").persist()
    counts.count()
    tracemalloc.start()
    s = collect_spectrum(counts, 17, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(s.counters.parts) > 30 and peak < 60_000_000
    keys = np.arange(n) * 7919
    got = s.count(keys)
    assert (got[4::5] == 5).all() and (got >= 1 + np.arange(n) % 5).all()
    assert (s.count(keys + 1) > 0).mean() < 0.02
    mapped = s.counters.parts[3].array.base
    assert isinstance(mapped if isinstance(mapped, np.memmap) else mapped.base, (np.memmap, __import__("mmap").mmap))
    # workers have the same values as the driver
    told = spark.range(1000).repartition(3).select((F.col("id") * 7919).alias("id")).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([b["id"], pa.array(s.count(b["id"].to_numpy()))], names=["id", "n"]) for b in batches), "id long, n long")
    assert {r.id: r.n for r in told.collect()} == dict(zip(keys[:1000].tolist(), got[:1000].tolist(), strict=True))


@pytest.mark.parametrize("mode", ["folder", "broadcasts"])
def test_trusted_kmers_are_not_held_by_the_driver(spark, monkeypatch, mode):
    import os
    import tracemalloc

    from readprep.operators import shared

    shared.checkpoint_dir(spark)
    if mode == "broadcasts":
        def store(session):
            made = shared.Store(None)
            made.spark = session
            return made

        monkeypatch.setattr(C, "Store", store)
    monkeypatch.setattr(C, "ENTRIES", 1 << 18)
    monkeypatch.setattr(C, "PORTION", 1 << 16)
    n = 3_000_000
    counts = spark.range(n).selectExpr("id * 300 as kmer", "if(id % 1000 = 0, 5000000000, 5 + id % 300) as cnt").persist()
    counts.count()
    tracemalloc.start()
    s = collect_spectrum(counts, 15, 5, hybrid=False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000  # two longs for each trusted k-mer alone are 48 million
    assert bool(s.table.low.whole) == (mode == "folder") and len(s.table.low.parts) > 10
    keys = np.arange(n) * 300
    want = np.where(np.arange(n) % 1000 == 0, 5_000_000_000, 5 + np.arange(n) % 300)
    assert (s.count(keys) == want).all() and not s.count(keys + 1).any()
    done = spark.range(1000).repartition(3).select((F.col("id") * 300).alias("id")).mapInArrow(lambda batches, s=s: (pa.RecordBatch.from_arrays([b["id"], pa.array(s.count(b["id"].to_numpy()))], names=["id", "n"]) for b in batches), "id long, n long")
    path = s.table.low.whole.path if mode == "folder" else None
    del s
    shared.release(spark)
    shared.sweep()
    assert {r.id: r.n for r in done.collect()} == dict(zip(keys[:1000].tolist(), want[:1000].tolist(), strict=True))  # a plan keeps its folder
    shared.sweep(True)
    assert path is None or not os.path.exists(path)


@pytest.mark.parametrize("query", ["pipeline_report", "corrected_pairs"])
def test_queries_map_their_spectrum_from_files(spark, monkeypatch, query):
    from readprep.operators import pipeline, shared
    from readprep.plans.read_queries import QUERIES

    shared.checkpoint_dir(spark)
    made = []
    monkeypatch.setattr(pipeline, "collect_spectrum", lambda *a: made.append(collect_spectrum(*a)) or made[-1])
    assert QUERIES[query](spark, "/root/testdata/sf0.001").count() > 0
    s = made[0]
    assert len(made) == 1 and all(x.whole and not any(isinstance(p, shared.Shared) for p in x.parts) for x in (s.table.first, s.table.low, s.table.values, s.counters.bytes))


def test_kept_counts_are_the_counts(spark):
    df = spark.createDataFrame(damaged_reads(7), "read_ix long, header string, sequence string, qualities string")
    counts, kept = S.kept_counts(df, 9, 18)
    want = sorted(map(tuple, S.kmer_counts(df, 9, 18).collect()))
    assert sorted(map(tuple, counts.collect())) == want and kept.count() < len(want) > 100
    kept.unpersist()
    assert S.kept_counts(df.limit(0), 9)[0].collect() == []


def test_default_mode_keeps_lengths_equal(spark):
    rows = damaged_reads(4)
    df = spark.createDataFrame(rows, "read_ix long, header string, sequence string, qualities string")
    plan = Plan(9, 20, 3, 20, ADAPTERS)
    assert all(len(r.sequence) == len(r.qualities) for r in prepare(df, plan, hybrid=False).collect())


def test_search_keeps_the_first_best_path():
    graph = {0: [(1, 0, 9), (2, 1, 5)], 1: [(3, 0, 5)], 2: [(3, 1, 5)]}
    edges = lambda node: graph.get(node, [])
    assert best_path(edges, 0, 3, 2, 4) == ([1, 1], 5)  # the weaker first edge is explored first
    assert best_path(edges, 0, 3, 3, 4) is None
    assert canonical("ACN") is None


@pytest.mark.parametrize(("k", "n", "pops"), [(4, 60, 1000), (3, 64, 1000), (5, 300, 40)])
def test_paths_together_match_paths_alone(monkeypatch, k, n, pops):
    monkeypatch.setattr(C, "POPS", pops)
    rng = np.random.default_rng(k)
    keys = np.sort(rng.choice(4**k, min(n, 4**k), replace=False))
    s = C.Spectrum(k, 1, keys, rng.integers(1, 4, len(keys)), graph=True)
    start, end = rng.integers(0, 4 ** (k - 1), (2, 150))
    wanted = rng.random((150, 12)) < 0.5
    wanted[:, 0] = False
    for branches in (3, 4):
        least, labels = C.best_paths(s, start, end, wanted, branches)
        for i, length in zip(*np.nonzero(wanted), strict=True):
            path = best_path(s.edges_from, int(start[i]), int(end[i]), int(length), branches)
            got = [int(labels[i, length]) >> 2 * (length - 1 - j) & 3 for j in range(length)], int(least[i, length])
            assert (path or None) == (got if least[i, length] else None)


def test_regions_need_anchors():
    s = C.Spectrum(5, 1, np.zeros(0, np.int64), np.zeros(0, np.int64), graph=True)
    reads = C.Reads(np.array([[0] * 10 + [5] * 10, [4] * 20], np.uint8), np.zeros((2, 20), np.int32), np.array([10, 20]), np.array([10, 20]))
    assert C.better_regions(reads, np.array([0, 1]), np.array([2, 8]), np.array([2, 2]), s)[0].tolist() == [0, 0]


def test_odd_reads_pass(spark):
    rows = [(0, "a", "", ""), (1, "b", None, None), (2, "c", "ACG", "!!!"), (3, "d", "ACGTACGTACGTA" * 9, "5" * 40), (4, "e", "acgtnRYacgtacgtacgt", "#" + "\u00e9" * 18), (5, "f", "ACGT" * 2000, "#" * 8000), (6, "g", "ACGTTGCA", "#" * 20)]
    df = spark.createDataFrame(rows, "read_ix long, header string, sequence string, qualities string")
    plan = Plan(9, 20, 3, 1, ADAPTERS)
    got = {r.read_ix: r for r in prepare(df, plan).collect()}
    assert set(got) == set(range(7)) and got[4].sequence.startswith("ACGTN") and got[4].qualities == "#" + "\u00e9" * 18
    assert prepare(df.limit(0), plan).count() == 0


def test_truth_scenarios_reach_the_gates(spark):
    truth = single_truth(spark, 6)
    plan = Plan(15, 20, 4, 35, [("illumina-short", "AGATCGGAAGAGC", 18)])
    done = prepare(truth.drop("scenario", "expected"), plan, parity=True)
    out = last_by(keep(done, plan), done["header"], "read_ix")
    total = summarise(scored(truth, out)).where("scenario is null").first()
    assert total.reads == 30 and total.exact_match_rate >= 0.95
    assert min(total.retention_f1, total.trimming_f1, total.correction_recall) >= 0.95
    r = report(done, plan).first()
    assert r.input_reads == 30 and r.discarded_reads == 6


def test_paired_truth_scenarios_reach_the_gates(spark):
    from pyspark.sql import functions as F

    from readprep.functions import pair_key

    truth = paired_truth(spark, 6)
    sides = [truth.select("read_ix", *(F.col(f"{c}{n}").alias(c) for c in ("header", "sequence", "qualities"))) for n in (1, 2)]
    plan = Plan(15, 20, 4, 35, [("illumina-short", "AGATCGGAAGAGC", 18)])
    done = prepare_pairs(*sides, plan, parity=True).where("length(sequence1) >= 35 and length(sequence2) >= 35")
    out = done.select(pair_key(F.col("header1")).alias("out_key"), F.col("sequence1").alias("output1"), F.col("sequence2").alias("output2"))
    total = summarise(scored(truth, out, paired=True)).where("scenario is null").first()
    assert total.reads == 30 and total.exact_match_rate >= 0.95
    assert min(total.retention_f1, total.trimming_f1, total.correction_recall) >= 0.95


def test_benchmark_counts_reads(spark):
    df = spark.createDataFrame(damaged_reads(5, n=40), "read_ix long, header string, sequence string, qualities string")
    rounds = benchmark(df, 2, reuse=True, plan=Plan(9, 20, 3, 20, []))
    assert [r["round"] for r in rounds] == [1, 2] and all(r["reads"] == 40 and r["wall_s"] > 0 for r in rounds)
    assert rounds[1]["setup_s"] < rounds[0]["setup_s"]
