"""Trimming and filtering of reads, and mates kept together; all within the row, or by one equi-join for mates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readprep.functions import pair_key
from readprep.operators.adapters import best_hit

GRACE, SHORTEST_CUT = 2, 3


def low_tail(qualities: Column, min_quality: int) -> Column:
    """Length of the run at the end with quality + 2 under the minimum."""
    limit = min_quality - GRACE
    if limit <= 0:
        return F.lit(0)
    return F.length(F.regexp_extract(qualities, "[\\x{0}-\\x{%x}]*$" % (32 + limit), 0))


def quality_cut(qualities: Column, min_quality: int) -> Column:
    """Bases that stay: the low run at the end goes if it has at least three."""
    run = low_tail(qualities, min_quality)
    return F.when(run >= SHORTEST_CUT, F.length(qualities) - run).otherwise(F.length(qualities))


def trim(reads: DataFrame, adapters: list[tuple[str, str, int]], min_quality: int) -> DataFrame:
    """reads cut at the adapter, then at the low tail of what is left: adds trimmed_bases and trimmed_adapter."""
    hit = best_hit(reads, adapters)
    kept = F.coalesce("adapter_start", F.length("sequence"))
    cut = hit.withColumn("__n", F.length("sequence")).withColumns({"sequence": F.substring("sequence", F.lit(1), kept), "qualities": F.substring("qualities", F.lit(1), kept)})
    final = quality_cut(F.col("qualities"), min_quality)
    cut = cut.withColumns({"sequence": F.substring("sequence", F.lit(1), final), "qualities": F.substring("qualities", F.lit(1), final)})
    return cut.withColumn("trimmed_bases", (F.col("__n") - F.length("sequence")).cast("long")).withColumn("trimmed_adapter", F.col("adapter_name")).drop("__n", "adapter_name", "adapter_start", "adapter_score")


def long_enough(reads: DataFrame, min_length: int) -> DataFrame:
    return reads.where(F.length("sequence") >= min_length)


def trim_stats(trimmed: DataFrame, min_length: int) -> DataFrame:
    """Counts over all trimmed reads, discarded ones too: n_reads, trimmed_reads, trimmed_bases, kept_reads, kept_bases."""
    keep = F.length("sequence") >= min_length
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return trimmed.agg(F.count("*").alias("n_reads"), total(F.col("trimmed_bases") > 0).alias("trimmed_reads"), total(F.col("trimmed_bases")).alias("trimmed_bases"), total(keep).alias("kept_reads"), total(F.when(keep, F.length("sequence")).otherwise(0)).alias("kept_bases"))


def low_regions(reads: DataFrame, min_quality: int, shortest: int = 2, longest: int | None = None) -> DataFrame:
    """(read_ix, start from 0, len) of maximal runs of qualities under the minimum: positions less their rank are constant on a run."""
    low = reads.select("read_ix", F.posexplode(F.split("qualities", "")).alias("pos", "q")).where(F.ascii("q") < 33 + min_quality)
    island = F.col("pos") - F.row_number().over(Window.partitionBy("read_ix").orderBy("pos"))
    runs = low.withColumn("island", island).groupBy("read_ix", "island").agg(F.min("pos").cast("long").alias("start"), F.count("*").alias("len")).where(F.col("len") >= shortest)
    return (runs.where(F.col("len") <= longest) if longest else runs).drop("island")


def attention(reads: DataFrame, support: DataFrame, min_quality: int, floor: int) -> DataFrame:
    """(read_ix, pos) that correction looks at: a low quality, or a middling one with too little support; some window covers them."""
    base = reads.select("read_ix", F.posexplode(F.split("qualities", "")).alias("pos", "c")).select("read_ix", F.col("pos").cast("long").alias("pos"), F.greatest(F.ascii("c") - 33, F.lit(0)).alias("phred"))
    near = base.where(F.col("phred") <= min_quality + 5).join(support, ["read_ix", "pos"])
    return near.where((F.col("windows") > 0) & ((F.col("phred") < min_quality) | (F.col("least") < floor))).select("read_ix", "pos", F.col("phred").cast("long").alias("phred"), "least", "total", "windows")


def pair_up(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by position: read_ix, key, and both records. Fails, as a query, if a file ends early or names differ."""
    left = first.select("read_ix", *(F.col(c).alias(f"{c}1") for c in ("header", "sequence", "qualities")))
    right = second.select("read_ix", *(F.col(c).alias(f"{c}2") for c in ("header", "sequence", "qualities")))
    both = left.join(right, "read_ix", "full_outer").withColumn("key", pair_key(F.col("header1")))
    missing = F.assert_true(F.col("header1").isNotNull() & F.col("header2").isNotNull(), "a file of mates ends early")
    differ = F.assert_true(F.col("key") == pair_key(F.col("header2")), "mates out of order")
    return both.where(missing.isNull() & differ.isNull())


def filter_pairs(pairs: DataFrame, min_length: int) -> DataFrame:
    """Pairs of which both mates are long enough."""
    return pairs.where((F.length("sequence1") >= min_length) & (F.length("sequence2") >= min_length))


def interleave(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reads of both files, mate after mate, renumbered."""
    return first.withColumn("read_ix", F.col("read_ix") * 2).unionByName(second.withColumn("read_ix", F.col("read_ix") * 2 + 1))
