"""Benchmark rounds, comparisons and their history with regression gates.

History is a table in order of line_no. The baseline of an entry is an earlier one of the same kind, backend, pairedness
and (for plain benchmarks) session mode; all look-ups are windows over that key or aggregates, never a join of entries
with entries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readprep.functions import speedup


def summarise_rounds(rounds: DataFrame, key: str = "run_id") -> DataFrame:
    """rounds (key, round_ix from 1, wall_us, reads) to mean, best, worst, warm-up penalty; round 1 warms up."""
    later = F.avg(F.when(F.col("round_ix") > 1, F.col("wall_us")))
    first = F.max(F.when(F.col("round_ix") == 1, F.col("wall_us")))
    sums = rounds.groupBy(key).agg(F.count("*").alias("rounds"), F.avg("wall_us").alias("mean_us"), F.min("wall_us").alias("best_us"), F.max("wall_us").alias("worst_us"), first.alias("warmup_us"), later.alias("steady_us"), (F.sum("reads") / F.sum("wall_us") * 1e6).alias("reads_per_s"))
    penalty = F.when(F.col("steady_us") > 0, (F.col("warmup_us") - F.col("steady_us")) / F.col("steady_us") * 100)
    return sums.withColumn("warmup_penalty_pct", penalty)


def compare(cold: DataFrame, reuse: DataFrame, key: str = "run_id") -> DataFrame:
    """Cold rounds (mean_us) against rounds that reuse a session (mean_us, rounds, setup_us)."""
    c = cold.select(key, F.col("mean_us").alias("cold_us"))
    both = c.join(reuse.select(key, F.col("mean_us").alias("reuse_us"), "rounds", "setup_us"), key)
    amortised = F.col("reuse_us") + F.col("setup_us") / F.col("rounds")
    both = both.withColumn("amortised_us", amortised)
    return both.select(key, "cold_us", "reuse_us", "amortised_us", speedup(F.col("cold_us"), F.col("reuse_us")).alias("raw_speedup"), speedup(F.col("cold_us"), F.col("amortised_us")).alias("amortised_speedup"), F.when(F.col("cold_us") > 0, (F.col("cold_us") - F.col("reuse_us")) / F.col("cold_us") * 100).alias("saved_pct"))


def _order(frame: bool = True) -> Window:
    w = Window.partitionBy("kind", "backend", "paired", "mode").orderBy("line_no")
    return w.rowsBetween(Window.unboundedPreceding, -1) if frame else w


def stats(history: DataFrame) -> DataFrame:
    """Entries by kind, distinct labels and backends in order, latest time, average, best and latest speedup."""
    return history.agg(
        F.count("*").alias("entries"), F.count_if(F.col("kind") == "benchmark").alias("benchmarks"), F.count_if(F.col("kind") == "benchmark_compare").alias("comparisons"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("backends"),
        F.max("recorded_at").alias("latest_at"), F.avg("speedup").alias("avg_speedup"), F.max("speedup").alias("best_speedup"), F.max_by("speedup", F.when(F.col("speedup").isNotNull(), F.col("line_no"))).alias("latest_speedup"),
    )


def recent(history: DataFrame, n: int) -> DataFrame:
    """The last entries, in order."""
    return history.orderBy(F.desc("line_no")).limit(max(n, 1)).orderBy("line_no")


@dataclass
class Gates:
    """Alerts: wall time up by more than a percentage, speedup or transfer savings under a floor."""

    wall_pct: float | None = None
    speedup: float | None = None
    savings_pct: float | None = None


def status(wall: Column, base_wall: Column, own_speedup: Column, own_savings: Column, gates: Gates, comparable: Column) -> Column:
    """no_baseline, not_comparable, alert or pass; limits themselves pass."""
    delta = F.when(base_wall > 0, (wall - base_wall) / base_wall * 100)
    alert = F.lit(False)
    if gates.wall_pct is not None:
        alert = alert | F.coalesce(delta > gates.wall_pct, F.lit(False))
    if gates.speedup is not None:
        alert = alert | F.coalesce(own_speedup < gates.speedup, F.lit(False))
    if gates.savings_pct is not None:
        alert = alert | F.coalesce(own_savings < gates.savings_pct, F.lit(False))
    return F.when(base_wall.isNull(), "no_baseline").when(~comparable, "not_comparable").when(alert, "alert").otherwise("pass")


def with_previous(history: DataFrame, gates: Gates) -> DataFrame:
    """Every entry with the one before it that it compares with: previous_line, previous_us, delta_pct, status."""
    w = _order(False)
    rows = history.withColumns({"previous_line": F.lag("line_no").over(w), "previous_us": F.lag("wall_us").over(w)})
    delta = F.when(F.col("previous_us") > 0, (F.col("wall_us") - F.col("previous_us")) / F.col("previous_us") * 100)
    verdict = status(F.col("wall_us"), F.col("previous_us"), F.col("speedup"), F.col("savings_pct"), gates, F.lit(True))
    return rows.withColumn("delta_pct", delta).withColumn("status", verdict)


def latest_passing(history: DataFrame, gates: Gates, prefix: str | None = None) -> DataFrame:
    """Every entry with the newest earlier comparable one that itself passed (and whose label begins so)."""
    rows = with_previous(history, gates)
    good = F.col("status") == "pass"
    if prefix is not None:
        good = good & F.coalesce(F.startswith(F.col("label"), F.lit(prefix)), F.lit(False))
    line = F.max(F.when(good, F.col("line_no"))).over(_order())
    wall = F.max_by("wall_us", F.when(good, F.col("line_no"))).over(_order())
    return rows.withColumns({"baseline_line": line, "baseline_us": F.when(line.isNotNull(), wall)})


def labelled_baseline(history: DataFrame, label: str | None = None, prefix: str | None = None) -> DataFrame:
    """The last entry with its baseline among earlier entries of a label or label prefix.

    The newest comparable one is taken, else the newest of that label, marked as not comparable.
    """
    current = history.agg(F.max_by(F.struct(*history.columns), "line_no").alias("c"))
    wanted = F.col("label") == label if label is not None else F.startswith(F.col("label"), F.lit(prefix or ""))
    pairs = history.where(wanted).crossJoin(F.broadcast(current)).where("line_no < c.line_no")  # one current entry
    same = F.lit(True)
    for k in ("kind", "backend", "paired", "mode"):
        same = same & F.col(k).eqNullSafe(F.col(f"c.{k}"))
    value = F.struct("line_no", "wall_us")
    found = pairs.agg(F.max_by(value, F.when(same, F.col("line_no"))).alias("near"), F.max_by(value, "line_no").alias("any"), F.max(F.when(same, F.col("line_no"))).alias("has"))
    picked = found.select(F.when(F.col("has").isNotNull(), F.col("near")).otherwise(F.col("any")).alias("b"), F.col("has").isNotNull().alias("comparable"))
    return current.join(picked, F.lit(True), "left").select(F.col("c.line_no").alias("line_no"), F.col("c.wall_us").alias("wall_us"), F.col("b.line_no").alias("baseline_line"), F.col("b.wall_us").alias("baseline_us"), F.when(F.col("b").isNull(), "no_baseline").when(~F.col("comparable"), "not_comparable").otherwise("comparable").alias("relation"))
