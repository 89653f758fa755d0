"""Reads and events as streams.

Correction is stateless once the spectrum is frozen, so reads that arrive as files pass through the same Arrow function;
running totals and k-mer counts are streaming aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readprep.operators import spectrum as S
from readprep.operators.adapters import best_hit
from readprep.operators.correct import Spectrum, process_reads
from readprep.operators.profile import Plan


def prepare_stream(reads: DataFrame, plan: Plan, spectrum: Spectrum, parity: bool = False) -> DataFrame:
    """Prepared reads of a stream of reads, in append mode; long enough ones only."""
    done = process_reads(best_hit(reads, plan.adapters), spectrum, plan.min_quality, parity)
    return done.where(F.length("sequence") >= plan.min_length)


def kmer_stream(reads: DataFrame, k: int, min_quality: int = 0) -> DataFrame:
    """Running k-mer counts, in update or complete mode."""
    return S.kmer_counts(reads, k, min_quality)


def write_batches(prepared: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Prepared reads as Parquet; a batch that is run again replaces its own files."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = prepared.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def windowed_totals(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) of event-time windows; rows later than the watermark are dropped."""
    marked = events.withWatermark("ts", late)
    sums = marked.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("event_type").alias("kind"), "n", "total")
