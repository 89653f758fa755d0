"""Profiling a sample of reads, and the plan that follows from it.

All statistics are aggregates of reads(read_ix, header, sequence, qualities) or tables of at most a few hundred rows made
by one; nothing is collected but the one row of a finished profile. Medians are upper medians, spreads population ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readprep.functions import ramp
from readprep.functions.packed import aligned, characters, forward_codes, places, window_starts
from readprep.operators.adapters import tail_support

#: Adapters that are looked for in every sample.
KNOWN_ADAPTERS = [("illumina-universal", "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"), ("illumina-short", "AGATCGGAAGAGC"), ("nextera-transposase", "CTGTCTCTTATACACATCT")]


def head(reads: DataFrame, n: int) -> DataFrame:
    """The first n reads in file order."""
    return reads.orderBy("read_ix").limit(max(n, 0))


def walked(df: DataFrame, value: str) -> DataFrame:
    """(v, n, upper): the distinct values, how often each occurs, and whether it is the upper median or beyond."""
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    walk = counts.select("v", "n", F.sum("n").over(Window.orderBy("v")).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    return walk.select("v", "n", (F.col("upto") >= F.floor(F.col("total") / 2) + 1).alias("upper"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row `median`: the middle value, of two the upper; null for none. Counts values first, then walks their counts."""
    return walked(df, value).where("upper").agg(F.min("v").alias("median"))


def length_stats(reads: DataFrame) -> DataFrame:
    """n_reads, mean_length, median_length, sd_length, from the distinct lengths and how often each occurs."""
    lengths = walked(reads.select(F.length("sequence").cast("long").alias("len")), "len")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    n, v = F.col("n"), F.coalesce("v", F.lit(0))
    sums = lengths.agg(total(n).alias("n"), total(n * v).alias("s"), total(n * v * v).alias("ss"), F.min(F.when(F.col("upper"), F.col("v"))).alias("median"))
    mean = F.coalesce(F.try_divide(F.col("s"), F.col("n")), F.lit(0.0))
    spread = F.sqrt(F.greatest(F.coalesce(F.try_divide(F.col("ss") * F.col("n") - F.col("s") * F.col("s"), F.col("n") * F.col("n")), F.lit(0.0)), F.lit(0.0)))
    return sums.select(F.col("n").alias("n_reads"), mean.alias("mean_length"), F.coalesce("median", F.lit(0)).cast("long").alias("median_length"), spread.alias("sd_length"))


_CYCLE = ["n_bases", "phreds", "a", "c", "g", "t"]


def _by_cycle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.int64()) for c in ("cycle", *_CYCLE)])
    for batch in batches:
        (letters, ends), (marks, q_ends) = characters(batch["sequence"]), characters(batch["qualities"])
        at = places(ends)
        n = int(at.max(initial=-1)) + 1
        phred = np.maximum(aligned(marks, q_ends, ends).astype(np.int64) - 33, 0)
        sums = [np.bincount(at, minlength=n), np.bincount(at, weights=phred, minlength=n).astype(np.int64), *(np.bincount(at[letters == ord(b)], minlength=n) for b in "ACGT")]
        whole = [np.append(np.int64(len(ends) - 1 if i == 0 else 0), x) for i, x in enumerate(sums)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), *(pa.array(x, pa.int64()) for x in whole)], schema=schema)


def cycle_table(reads: DataFrame) -> DataFrame:
    """(cycle from 1, n_bases, phreds, a, c, g, t): what all reads have at a cycle, and under cycle 0 the number of reads.

    A task sums up whole batches at once, so a batch and cycle is one row of the shuffle, whatever the reads are.
    """
    found = reads.select("sequence", "qualities").mapInArrow(_by_cycle, ", ".join(f"{c} long" for c in ("cycle", *_CYCLE)))
    return found.groupBy("cycle").agg(*(F.sum(c).alias(c) for c in _CYCLE))


def cycle_quality(reads: DataFrame) -> DataFrame:
    """(cycle, n_bases, mean_phred)."""
    return cycle_table(reads).where("cycle > 0").select("cycle", "n_bases", (F.col("phreds") / F.col("n_bases")).alias("mean_phred"))


def cycle_profile(table: DataFrame, lead: int = 12, gc_cycles: int = 10) -> DataFrame:
    """One row of a cycle table: mean_phred, tail_drop, leading_bias, gc_bias.

    mean_phred is over all bases. tail_drop is the mean of the first ten cycle means less that of the last ten, 0 under ten
    cycles. leading_bias is half the summed distance of the shares of A, C, G, T and all else, cycle against overall, averaged
    over the first cycles that all reads have; gc_bias the mean distance of the share of G and C over the first that any has.
    """
    every, cycle = Window.partitionBy(F.lit(0)), F.col("cycle")
    of_all = lambda c: F.sum(F.when(cycle > 0, F.col(c))).over(every)
    buckets = ["a", "c", "g", "t", "other"]
    rows = table.withColumn("other", F.col("n_bases") - F.col("a") - F.col("c") - F.col("g") - F.col("t"))
    rows = rows.select("*", *(F.try_divide(of_all(b), of_all("n_bases")).alias(f"{b}_all") for b in buckets), F.max("cycle").over(every).alias("last"), F.max(F.when(cycle == 0, F.col("n_bases"))).over(every).alias("n_reads"))
    share = lambda b: F.try_divide(F.col(b), F.col("n_bases"))
    mean = F.try_divide("phreds", "n_bases")
    distance = sum((F.abs(share(b) - F.col(f"{b}_all")) for b in buckets), F.lit(0.0)) / 2
    gc = F.abs(share("g") + share("c") - F.col("g_all") - F.col("c_all"))
    real = cycle > 0
    sums = rows.agg(
        F.coalesce(F.try_divide(F.sum(F.when(real, F.col("phreds"))), F.sum(F.when(real, F.col("n_bases")))), F.lit(0.0)).alias("mean_phred"),
        F.max("last").alias("last"), F.avg(F.when(real & (cycle <= 10), mean)).alias("head"), F.avg(F.when(real & (cycle > F.col("last") - 10), mean)).alias("tail"),
        F.coalesce(F.avg(F.when(real & (cycle <= lead) & (F.col("n_bases") == F.col("n_reads")), distance)), F.lit(0.0)).alias("leading_bias"),
        F.coalesce(F.avg(F.when(real & (cycle <= gc_cycles), gc)), F.lit(0.0)).alias("gc_bias"),
    )
    return sums.select("mean_phred", F.when(F.col("last") >= 10, F.col("head") - F.col("tail")).otherwise(0.0).alias("tail_drop"), "leading_bias", "gc_bias")


def quality_profile(reads: DataFrame) -> DataFrame:
    """mean_phred, tail_drop; see cycle_profile."""
    return cycle_profile(cycle_table(reads)).select("mean_phred", "tail_drop")


def poly_tail(reads: DataFrame) -> DataFrame:
    """n_reads, hits, rate of reads with eight A or eight T in a row within their last twenty bases."""
    hit = F.right("sequence", F.lit(20)).rlike("A{8}|T{8}")
    sums = reads.agg(F.count("*").alias("n_reads"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("hits"))
    return sums.select("n_reads", "hits", F.coalesce(F.try_divide("hits", "n_reads"), F.lit(0.0)).alias("rate"))


def barcode_hint(reads: DataFrame, median_length: DataFrame) -> DataFrame:
    """One row, or none: prefix_bases, umi_bases, rate. Reads are searched for poly-T behind a barcode, up to base 50."""
    window = F.substring("sequence", 15, 36)
    hit = (F.length("sequence") >= 28) & F.when(F.col("median") <= 40, window.rlike("T{6}")).otherwise(window.rlike("T{8}"))
    sums = reads.crossJoin(F.broadcast(median_length.select("median"))).groupBy("median").agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("hits"))
    rated = sums.withColumn("rate", F.col("hits") / F.col("n")).where(F.col("rate") >= F.when(F.col("median") <= 40, 0.08).otherwise(0.20))
    return rated.select(F.lit(16).alias("prefix_bases"), F.when(F.col("median") >= 28, 12).otherwise(10).alias("umi_bases"), "rate")


def duplication(reads: DataFrame) -> DataFrame:
    """n_reads, n_distinct, rate = 1 - distinct / reads."""
    sums = reads.groupBy("sequence").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_reads"), F.count("*").alias("n_distinct"))
    return sums.select("n_reads", "n_distinct", F.coalesce(1 - F.try_divide("n_distinct", "n_reads"), F.lit(0.0)).alias("rate"))


#: Four bits of each letter that a base may be named by; windows with other characters are told apart as strings.
_SYMBOL = np.full(256, 16, np.uint8)
_SYMBOL[[ord(c) for c in "ACGTNRYSWKMBDHV."]] = np.arange(16)


def _raw_windows(k: int):
    schema = pa.schema([("code", pa.int64()), ("text", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, ends = characters(batch["sequence"])
            symbol = _SYMBOL[np.minimum(letters, 255)]
            odd = (symbol > 15) | (k > 15)
            code, n = np.unique(forward_codes(symbol & 15, min(k, 15), 4)[window_starts(odd, ends, k)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.nulls(len(code), pa.string()), pa.array(n, pa.int64())], schema=schema)
            if odd.any():
                every, plain = window_starts(np.zeros(len(odd), bool), ends, k), window_starts(odd, ends, k)
                texts = ["".join(map(chr, letters[i : i + k].tolist())) for i in np.setdiff1d(every, plain).tolist()]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), pa.array(texts, pa.string()), pa.array(np.ones(len(texts), np.int64))], schema=schema)

    return run


def kmer_diversity(reads: DataFrame, k: int = 15, most: int | None = None) -> DataFrame:
    """n_kmers, n_distinct, diversity over raw windows (no canonical form, N allowed), of the first `most` reads if given."""
    rows = head(reads, most) if most else reads
    windows = rows.select("sequence").mapInArrow(_raw_windows(k), "code long, text string, n long")
    sums = windows.groupBy("code", "text").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_kmers"), F.count("*").alias("n_distinct"))
    return sums.select("n_kmers", "n_distinct", F.coalesce(F.try_divide("n_distinct", "n_kmers"), F.lit(1.0)).alias("diversity"))


def leading_bias(reads: DataFrame, most: int = 12) -> DataFrame:
    """bias; see cycle_profile."""
    return cycle_profile(cycle_table(reads), lead=most).select(F.col("leading_bias").alias("bias"))


def gc_bias(reads: DataFrame, most: int = 10) -> DataFrame:
    """bias; see cycle_profile."""
    return cycle_profile(cycle_table(reads), gc_cycles=most).select(F.col("gc_bias").alias("bias"))


def known_support(reads: DataFrame) -> DataFrame:
    """(name, sequence, support, score) of the known adapters that some read ends in."""
    sums = reads.agg(F.count("*").alias("n"), *(F.sum(tail_support(F.col("sequence"), a).cast("long")).alias(f"s{i}") for i, (_, a) in enumerate(KNOWN_ADAPTERS)))
    each = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(a).alias("sequence"), F.col(f"s{i}").alias("support")) for i, (name, a) in enumerate(KNOWN_ADAPTERS)))
    return sums.select("n", F.explode(each).alias("a")).select("a.*", "n").where("support > 0").select("name", "sequence", "support", (F.col("support") / F.col("n")).alias("score"))


def denovo_suffixes(reads: DataFrame, most: int = 2) -> DataFrame:
    """(sequence, support, score) of the commonest 12-base endings of reads with a poor tail."""
    tail = F.transform(F.split(F.right("qualities", F.lit(12)), ""), lambda c: F.greatest(F.ascii(c) - 33, F.lit(0)))
    poor = F.aggregate(tail, F.lit(0), lambda a, x: a + x) <= 25 * 12
    suffix = F.right("sequence", F.lit(12))
    varied = F.size(F.array_distinct(F.split(suffix, ""))) >= 3
    counts = reads.where((F.length("sequence") >= 12) & poor & varied).groupBy(suffix.alias("sequence")).agg(F.count("*").alias("support"))
    total = reads.agg(F.count("*").alias("n"))
    kept = counts.crossJoin(F.broadcast(total)).where((F.col("support") >= F.greatest(F.floor(F.col("n") / 25), F.lit(3))) & (F.col("support") / F.col("n") < 0.80))
    return kept.orderBy(F.desc("support"), "sequence").limit(most).select("sequence", "support", (F.col("support") / F.col("n")).alias("score"))


def adapter_candidates(reads: DataFrame) -> DataFrame:
    """(place from 1, name, sequence, support, score): known adapters and de-novo endings by support."""
    known = known_support(reads)
    found = denovo_suffixes(reads).select(F.lit("de_novo_suffix").alias("name"), "sequence", "support", "score").where(~F.col("sequence").isin([s for _, s in KNOWN_ADAPTERS]))
    place = F.row_number().over(Window.orderBy(F.desc("support"), F.desc("score"), "name", "sequence"))
    return known.unionByName(found).select(place.alias("place"), "name", "sequence", "support", "score")


# The weights and thresholds of the next four functions.


def rna_evidence(poly, lead, dup, gc, diversity):
    """Evidence for transcripts between 0 and 1."""
    p, b, d, g, v = ramp(poly, 0.05, 0.20), ramp(lead, 0.03, 0.10), ramp(dup, 0.08, 0.25), ramp(gc, 0.02, 0.08), ramp(1 - diversity, 0.05, 0.30)
    primary = 0.40 * p + 0.30 * d
    classic = F.when(primary >= 0.01, primary + (0.15 * b + 0.08 * g + 0.07 * v) * F.least(primary / 0.20, F.lit(1.0))).otherwise(primary)
    biased = F.when((lead > 0.08) & (gc > 0.04) & (diversity >= 0.40) & (diversity < 0.65), 0.30 * b + 0.25 * g + 0.25 * v + 0.10 * d + 0.10 * p).otherwise(0.0)
    return F.greatest(classic, biased)


def platform(mean_length, sd_length, mean_phred, tail_drop, illumina, nextera):
    adapter = F.greatest(illumina, nextera)
    short = (
        F.when((F.try_divide(sd_length, mean_length) > 0.3) & (mean_phred < 28) & (adapter < 0.0005), "Ion Torrent")
        .when((tail_drop >= 6) | (adapter >= 0.0005), "Illumina")
        .when((tail_drop <= 3.5) & (mean_phred >= 28), "MGI")
        .otherwise("Illumina")
    )
    return F.when(mean_length > 800, F.when(mean_phred < 20, "ONT").otherwise("PacBio")).when((mean_length > 200) & (mean_phred < 15), "ONT").when(mean_length >= 35, short).otherwise("Unknown")


def experiment(platform_, mean_length, illumina, nextera, umi_bases, evidence):
    return (
        F.when(platform_.isin("ONT", "PacBio"), "Long Read")
        .when(umi_bases >= 12, "10x v3").when(umi_bases.isNotNull(), "10x v2")
        .when((nextera >= 0.002) & (mean_length < 120) & (nextera > illumina * 7), "ATAC-seq")
        .when(evidence >= 0.40, "RNA-seq").otherwise("WGS")
    )


def auto_profile(reads: DataFrame) -> DataFrame:
    """One row that describes the sample and names its platform and experiment; without reads both are Unknown."""
    candidates = known_support(reads)
    best = lambda needle: F.coalesce(F.max(F.when(F.contains("name", F.lit(needle)), F.col("score"))), F.lit(0.0))
    adapters = candidates.agg(best("illumina").alias("illumina"), best("nextera").alias("nextera"))
    lengths = length_stats(reads)
    hint = barcode_hint(reads, lengths.select(F.col("median_length").alias("median"))).agg(F.max("umi_bases").alias("umi_bases"), F.max("rate").alias("barcode_rate"))
    row = lengths
    for part in (cycle_profile(cycle_table(reads)), adapters, hint, poly_tail(reads).select(F.col("rate").alias("poly_tail_rate")), duplication(reads).select(F.col("rate").alias("duplication_rate")), kmer_diversity(reads).select(F.col("diversity").alias("kmer_diversity"))):
        row = row.crossJoin(F.broadcast(part))  # a row each
    c = F.col
    row = row.withColumn("rna_evidence", rna_evidence(c("poly_tail_rate"), c("leading_bias"), c("duplication_rate"), c("gc_bias"), c("kmer_diversity")))
    row = row.withColumn("platform", F.when(c("n_reads") == 0, "Unknown").otherwise(platform(c("mean_length"), c("sd_length"), c("mean_phred"), c("tail_drop"), c("illumina"), c("nextera"))))
    return row.withColumn("experiment", F.when(c("n_reads") == 0, "Unknown").otherwise(experiment(c("platform"), c("mean_length"), c("illumina"), c("nextera"), c("umi_bases"), c("rna_evidence"))))


def execution_plan(profile: DataFrame, accelerated: bool = False) -> DataFrame:
    """The thresholds that a profile (platform, experiment, mean_length) asks for."""
    p, e, m = F.col("platform"), F.col("experiment"), F.col("mean_length")
    single_cell = e.isin("10x v2", "10x v3")
    zero_copy = F.lit(accelerated) & p.isin("Illumina", "MGI") & (m >= 75)
    return profile.select(
        "platform", "experiment",
        F.when(p.isin("ONT", "PacBio"), 11).when(m < 75, 13).otherwise(15).alias("kmer_size"),
        F.when(p == "ONT", 10).when(p == "PacBio", 15).otherwise(20).alias("min_quality"),
        F.when(single_cell, 3).when(e == "Long Read", 2).otherwise(4).alias("trusted_floor"),
        F.when(single_cell, 20).when(e == "Long Read", 200).otherwise(35).alias("min_length"),
        zero_copy.alias("zero_copy"), F.when(zero_copy, 3).otherwise(1).alias("overlap_depth"),
    )


@dataclass
class Plan:
    """An execution plan at the driver, with overrides applied."""

    kmer_size: int = 15
    min_quality: int = 20
    trusted_floor: int = 4
    min_length: int = 35
    #: (name, sequence, support) in order of preference
    adapters: list[tuple[str, str, int]] = field(default_factory=list)
    platform: str = "Unknown"
    experiment: str = "Unknown"


def boosted_by_mates(profile: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The profile of first mates, as RNA if it says WGS but second mates have more poly tails and both together say RNA.

    Second mates of poly-A selected libraries begin with runs that first mates lack. Only the experiment changes. The second
    profile is made only where the first row asks for it.
    """
    row = profile.first()
    if row.experiment != "WGS" or second.isEmpty() or poly_tail(second).first().rate <= row.poly_tail_rate:
        return profile
    both = auto_profile(first.unionByName(second)).first()
    return profile.withColumn("experiment", F.lit("RNA-seq")) if both.experiment == "RNA-seq" else profile


def plan_of(reads: DataFrame, sample: int = 100_000, adapter: str | None = None, min_quality: int | None = None, kmer_size: int | None = None, platform_: str | None = None, experiment_: str | None = None, mates: DataFrame | None = None) -> Plan:
    """Profiles the first reads and plans; a forced adapter stands first with the sample as its support.

    Second mates, if given, can only turn WGS into RNA.
    """
    rows = head(reads, sample).persist()
    try:
        profile = auto_profile(rows)
        if mates is not None:
            profile = boosted_by_mates(profile, rows, head(mates, sample // 2))
        if platform_:
            profile = profile.withColumn("platform", F.lit(platform_))
        if experiment_:
            profile = profile.withColumn("experiment", F.lit(experiment_))
        r = execution_plan(profile).first()
        found = [(c.name, c.sequence, c.support) for c in adapter_candidates(rows).orderBy("place").collect()]
        n = rows.count()
    finally:
        rows.unpersist()
    if adapter:
        found = [("forced", adapter.upper(), n), *(c for c in found if c[1] != adapter.upper())]
    return Plan(kmer_size or r.kmer_size, min_quality if min_quality is not None else r.min_quality, r.trusted_floor, r.min_length, found, r.platform, r.experiment)
