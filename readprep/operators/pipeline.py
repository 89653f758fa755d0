"""Preparing reads end to end: profile, plan, spectrum, correction, trimming, filtering, report."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readprep.operators import spectrum as S
from readprep.operators import trim as T
from readprep.operators.adapters import best_hit
from readprep.operators.correct import collect_spectrum, process_reads
from readprep.operators.profile import Plan, plan_of

SAMPLE = 100_000
#: The spectrum takes windows of qualities down to this much under the plan's.
EASE = 2


def build_spectrum(reads: DataFrame, plan: Plan, sample: int = SAMPLE):
    """(counts, floor, kept): the k-mer table, the plan's floor raised for inputs larger than the sample, and what to unpersist."""
    counts, kept = S.kept_counts(reads, plan.kmer_size, max(plan.min_quality - EASE, 0))
    row = S.trusted_floor(S.summary(reads, counts, plan.kmer_size), plan.trusted_floor, sample).first()
    return counts, row.floor, kept


def prepare(reads: DataFrame, plan: Plan | None = None, sample: int = SAMPLE, parity: bool = False, hybrid: bool = True, indels: bool = True) -> DataFrame:
    """All reads, corrected and trimmed, those to be discarded too; keep() drops them.

    For the mode of accelerators see prepare_accelerated.
    """
    plan = plan or plan_of(reads, sample)
    counts, floor, kept = build_spectrum(reads, plan, sample)
    s = collect_spectrum(counts, plan.kmer_size, floor, hybrid)
    kept.unpersist()
    return process_reads(best_hit(reads, plan.adapters), s, plan.min_quality, parity, indels)


def accelerated(plan: Plan) -> Plan:
    """The plan as accelerators take it: the first four adapters of at least eight bases."""
    return replace(plan, adapters=[a for a in plan.adapters if len(a[1]) >= 8][:4])


def prepare_accelerated(reads: DataFrame, plan: Plan | None = None, sample: int = SAMPLE, parity: bool = False) -> DataFrame:
    """prepare() in the mode of accelerators: trusted k-mers only, substitutions only, four adapters."""
    return prepare(reads, accelerated(plan or plan_of(reads, sample)), sample, parity, hybrid=False, indels=False)


def keep(prepared: DataFrame, plan: Plan) -> DataFrame:
    return T.long_enough(prepared, plan.min_length)


def prepare_pairs(first: DataFrame, second: DataFrame, plan: Plan | None = None, sample: int = SAMPLE, parity: bool = False) -> DataFrame:
    """Pairs of prepared mates, columns with 1 and 2; the plan follows the first mates, the spectrum counts both."""
    pairs = T.pair_up(first, second)
    mate = lambda n: pairs.select("read_ix", *(F.col(f"{c}{n}").alias(c) for c in ("header", "sequence", "qualities")))
    plan = plan or plan_of(mate(1), (max(sample, 2) + 1) // 2, mates=mate(2))
    both = T.interleave(mate(1), mate(2))
    done = prepare(both, plan, sample, parity)
    one = done.withColumn("mate", F.pmod("read_ix", F.lit(2)) + 1).withColumn("read_ix", F.floor(F.col("read_ix") / 2))
    sides = [one.where(F.col("mate") == n).select("read_ix", *(F.col(c).alias(f"{c}{n}") for c in done.columns if c != "read_ix")) for n in (1, 2)]
    return sides[0].join(sides[1], "read_ix")


def report(prepared: DataFrame, plan: Plan) -> DataFrame:
    """One row of totals, over discarded reads too."""
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    kept = F.length("sequence") >= plan.min_length
    return prepared.agg(
        F.count("*").alias("input_reads"), total(kept).alias("output_reads"), total(~kept).alias("discarded_reads"),
        total(F.size("corrected_positions")).alias("corrected_bases"), total(F.size("indels")).alias("indel_corrections"),
        total(F.col("trimmed_bases") > 0).alias("trimmed_reads"), total(F.col("trimmed_bases")).alias("trimmed_bases"),
        total(F.when(kept, F.length("sequence")).otherwise(0)).alias("output_bases"),
    )


def benchmark(reads: DataFrame, rounds: int = 3, reuse: bool = False, plan: Plan | None = None, sample: int = SAMPLE) -> list[dict]:
    """Rounds of preparing reads into a sink that keeps nothing: setup and processing seconds, reads and bases per second.

    Cold rounds profile and count anew, outside the processing time; with reuse that is done once.
    """
    size = reads.agg(F.count("*").alias("n"), F.sum(F.length("sequence")).alias("bases")).first()
    out, ready = [], None
    for i in range(max(rounds, 1)):
        began = time.perf_counter()
        if ready is None or not reuse:
            own = plan or plan_of(reads, sample)
            counts, floor, kept = build_spectrum(reads, own, sample)
            ready = replace(own), collect_spectrum(counts, own.kmer_size, floor)
            kept.unpersist()
        setup = time.perf_counter() - began
        own, s = ready
        began = time.perf_counter()
        keep(process_reads(best_hit(reads, own.adapters), s, own.min_quality), own).write.format("noop").mode("overwrite").save()
        wall = time.perf_counter() - began
        out.append({"round": i + 1, "setup_s": setup, "wall_s": wall, "reads": size.n, "bases": size.bases or 0, "reads_per_s": size.n / wall, "bases_per_s": (size.bases or 0) / wall})
    return out
