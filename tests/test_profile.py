import random

import numpy as np
import pytest

from readprep.functions import packed
from readprep.operators import profile as P

SCHEMA = "read_ix long, header string, sequence string, qualities string"


def frame(spark, sequences, quality="I", tail=None):
    rows = []
    for i, s in enumerate(sequences):
        q = quality * len(s)
        if tail:
            q = q[: -len(tail)] + tail
        rows.append((i, f"r{i}", s, q))
    return spark.createDataFrame(rows, SCHEMA)


def bases(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def test_single_cell(spark):
    p = P.auto_profile(frame(spark, ["ACGTACGTACGTACGTGATCGATCGATCTTTTTTTT"] * 64)).first()
    assert p.experiment == "10x v3" and p.umi_bases == 12


def test_atac_and_a_trace_of_its_adapter(spark):
    r = random.Random(1)
    atac = [bases(r, 76) for _ in range(232)] + [bases(r, 57) + "CTGTCTCTTATACACATCT" for _ in range(24)]
    assert P.auto_profile(frame(spark, atac)).first().experiment == "ATAC-seq"
    trace = [bases(r, 76) for _ in range(1999)] + [bases(r, 57) + "CTGTCTCTTATACACATCT"]
    assert P.auto_profile(frame(spark, trace)).first().experiment == "WGS"


def test_illumina_adapter_goes_before_flat_quality(spark):
    r = random.Random(2)
    reads = [bases(r, 36) for _ in range(1995)] + [bases(r, 23) + "AGATCGGAAGAGC" for _ in range(5)]
    assert P.auto_profile(frame(spark, reads)).first().platform == "Illumina"


@pytest.mark.parametrize(("length", "quality", "platform", "k", "q", "minlen"), [(900, "+", "ONT", 11, 10, 200), (900, "I", "PacBio", 11, 15, 200), (60, "I", "MGI", 13, 20, 35), (20, "I", "Unknown", 13, 20, 35)])
def test_platforms_and_plans(spark, length, quality, platform, k, q, minlen):
    r = random.Random(3)
    p = P.auto_profile(frame(spark, [bases(r, length) for _ in range(40)], quality))
    assert p.first().platform == platform
    plan = P.execution_plan(p).first()
    assert (plan.kmer_size, plan.min_quality, plan.min_length) == (k, q, minlen)


def test_rna_evidence(spark):
    r = random.Random(4)
    transcripts = [bases(r, 64) for _ in range(8)]
    reads = ["GGGCGGGCGGGC" + r.choice(transcripts) for _ in range(128)]
    p = P.auto_profile(frame(spark, reads, tail="!" * 10)).first()
    assert p.experiment == "RNA-seq" and p.duplication_rate > 0.5


def test_no_reads(spark):
    p = P.auto_profile(spark.createDataFrame([], SCHEMA)).first()
    assert (p.platform, p.experiment, p.n_reads, p.median_length) == ("Unknown", "Unknown", 0, 0)


def test_upper_median(spark):
    for values, want in (([1, 2, 3, 4], 3), ([5], 5), ([1, 1, 9], 1)):
        assert P.upper_median(spark.createDataFrame([(v,) for v in values], "v0 long"), "v0").first().median == want


def test_overrides(spark):
    r = random.Random(5)
    df = frame(spark, [bases(r, 80) for _ in range(50)])
    plan = P.plan_of(df, adapter="acgtacgtacgt", min_quality=7, kmer_size=9, experiment_="10x v3")
    assert plan.adapters[0] == ("forced", "ACGTACGTACGT", 50) and (plan.min_quality, plan.kmer_size, plan.trusted_floor) == (7, 9, 3)


def test_codes_of_windows_are_those_of_their_bases():
    rng = np.random.default_rng(1)
    bases = rng.integers(0, 4, 80)
    for k in (1, 2, 3, 7, 15, 31):
        plain = [sum(int(b) << 2 * (k - 1 - j) for j, b in enumerate(bases[i : i + k])) for i in range(80 - k + 1)]
        turned = [sum(int(3 - b) << 2 * j for j, b in enumerate(bases[i : i + k])) for i in range(80 - k + 1)]
        assert packed.forward_codes(bases, k).tolist() == plain and packed.backward_codes(bases, k).tolist() == turned
    assert len(packed.forward_codes(bases[:3], 4)) == 0


def test_counts_and_diversity_of_odd_reads(spark):
    rows = [("ACGTNacgtA", "I" * 10), ("", ""), (None, None), ("ACGTACGT", "IIII"), ("ACGTéACGT", "I" * 9), ("AC", "II")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "read_ix long, sequence string, qualities string").repartition(2)
    from readprep.operators import spectrum as S

    for q in (0, 20):
        want = {r.kmer: r["count"] for r in S.windows(df, 4, q).selectExpr("least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) as kmer").selectExpr("cast(conv(translate(kmer, 'ACGT', '0123'), 4, 10) as long) as kmer").groupBy("kmer").count().collect()}
        assert {r.kmer: r.cnt for r in S.kmer_counts(df, 4, q).collect()} == want
    texts = [s[i : i + 4] for s, _ in rows if s for i in range(len(s) - 3)]
    row = P.kmer_diversity(df, 4).first()
    assert (row.n_kmers, row.n_distinct) == (len(texts), len(set(texts)))
    by = {r.cycle: r for r in P.cycle_table(df).collect()}
    assert by[0].n_bases == 6 and by[1].n_bases == 4 and by[9].n_bases == 2
