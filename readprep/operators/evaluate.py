"""Evaluation against synthetic truth: scenarios, confusion counts, precision and recall, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readprep.functions import pair_key, ratio_or_one

CORE_1, CORE_2, ADAPTER = "ACGT" * 10, "TGCA" * 10, "AGATCGGAAGAGC"
ERROR_1, ERROR_2, INSERT = 18, 11, 20


def _damaged(core: str, at: int) -> tuple[str, str]:
    base = core[at].translate(str.maketrans("ACGT", "CGTA"))
    return core[:at] + base + core[at + 1 :], "I" * at + "!" + "I" * (len(core) - at - 1)


def _adapted(sequence: str, qualities: str) -> tuple[str, str]:
    return sequence + ADAPTER, qualities + "!" * len(ADAPTER)


def single_scenarios() -> list[tuple]:
    """(scenario, header prefix, sequence, qualities, expected)."""
    clean, broken = (CORE_1, "I" * 40), _damaged(CORE_1, ERROR_1)
    short = (CORE_1[:INSERT], "I" * INSERT)
    return [
        ("clean_retention", "clean-", *clean, CORE_1),
        ("single_error_repair", "repair-", *broken, CORE_1),
        ("adapter_trim", "trim-", *_adapted(*clean), CORE_1),
        ("repair_then_trim", "repair-trim-", *_adapted(*broken), CORE_1),
        ("discard_short_insert", "discard-", *_adapted(*short), None),
    ]


def paired_scenarios() -> list[tuple]:
    """(scenario, header prefix, sequence1, qualities1, expected1, sequence2, qualities2, expected2)."""
    c1, c2 = (CORE_1, "I" * 40), (CORE_2, "I" * 40)
    b1, b2 = _damaged(CORE_1, ERROR_1), _damaged(CORE_2, ERROR_2)
    short = _adapted(CORE_2[:INSERT], "I" * INSERT)
    return [
        ("paired_clean_retention", "paired-clean-", *c1, CORE_1, *c2, CORE_2),
        ("paired_left_repair_right_trim", "paired-lr-rt-", *b1, CORE_1, *_adapted(*c2), CORE_2),
        ("paired_left_trim_right_repair", "paired-lt-rr-", *_adapted(*c1), CORE_1, *b2, CORE_2),
        ("paired_both_repair_trim", "paired-both-", *_adapted(*b1), CORE_1, *_adapted(*b2), CORE_2),
        ("paired_discard_short_insert", "paired-discard-", *c1, None, *short, None),
    ]


_SINGLE = "scenario string, prefix string, sequence string, qualities string, expected string"
_PAIRED = "scenario string, prefix string, sequence1 string, qualities1 string, expected1 string, sequence2 string, qualities2 string, expected2 string"


def single_truth(spark: SparkSession, per_scenario: int = 12) -> DataFrame:
    """(scenario, read_ix, header, sequence, qualities, expected): expected is null for reads to be discarded."""
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(single_scenarios())], "at long, " + _SINGLE)
    rows = F.broadcast(table).crossJoin(spark.range(per_scenario))
    return rows.select("scenario", (F.col("at") * per_scenario + F.col("id")).alias("read_ix"), F.concat("prefix", F.col("id").cast("string")).alias("header"), "sequence", "qualities", "expected")


def paired_truth(spark: SparkSession, per_scenario: int = 12) -> DataFrame:
    """The same for pairs, columns with 1 and 2; read_ix numbers pairs."""
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(paired_scenarios())], "at long, " + _PAIRED)
    rows = F.broadcast(table).crossJoin(spark.range(per_scenario))
    sides = [c for n in (1, 2) for c in (F.concat("prefix", F.col("id").cast("string"), F.lit(f"/{n}")).alias(f"header{n}"), F.col(f"sequence{n}"), F.col(f"qualities{n}"), F.col(f"expected{n}"))]
    return rows.select("scenario", (F.col("at") * per_scenario + F.col("id")).alias("read_ix"), *sides)


def last_by(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row for each key: of several the last."""
    value = F.struct(*df.columns)
    return df.groupBy(key.alias("out_key")).agg(F.max_by(value, F.col(order)).alias("r")).select("out_key", F.col("r.sequence").alias("output"))


def _base_counts(given: Column, truth: Column, output: Column) -> Column:
    """Struct (tp, fp, fn) over the bases that all three have.

    A base that was wrong is found if it comes out right, else missed, and falsely changed too if it came out different
    from both; a right base that comes out wrong is falsely changed.
    """
    places = F.sequence(F.lit(1), F.least(F.length(given), F.length(truth), F.length(output)))
    some = F.when(F.least(F.length(given), F.length(truth), F.length(output)) > 0, places).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        a, t, o = (F.substring(c, i, F.lit(1)) for c in (given, truth, output))
        return F.struct(((a != t) & (o == t)).cast("long").alias("tp"), ((o != t) & ((a == t) | (o != a))).cast("long").alias("fp"), ((a != t) & (o != t)).cast("long").alias("fn"))

    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("tp", "fp", "fn")))
    return F.aggregate(F.transform(some, one), zero, lambda s, x: F.struct((s["tp"] + x["tp"]).alias("tp"), (s["fp"] + x["fp"]).alias("fp"), (s["fn"] + x["fn"]).alias("fn")))


def scored(truth: DataFrame, outputs: DataFrame, paired: bool = False) -> DataFrame:
    """Each read (or pair) of the truth with its confusion counts. outputs: (key, output...) as left by last_by."""
    if paired:
        t = truth.withColumn("out_key", pair_key(F.col("header1"))).join(outputs, "out_key", "left")
        sides = (1, 2)
    else:
        t = truth.withColumnsRenamed({"sequence": "sequence1", "expected": "expected1"}).withColumn("out_key", F.col("header")).join(outputs.withColumnRenamed("output", "output1"), "out_key", "left")
        sides = (1,)
    kept, seen = F.col("expected1").isNotNull(), F.col("output1").isNotNull()
    cut = lambda c: F.greatest(*(F.coalesce(F.length(f"{c}{n}") < F.length(f"sequence{n}"), F.lit(False)) for n in sides)) if len(sides) > 1 else F.coalesce(F.length(f"{c}1") < F.length("sequence1"), F.lit(False))
    exact = kept & seen
    for n in sides:
        exact = exact & F.coalesce(F.col(f"output{n}") == F.col(f"expected{n}"), F.lit(False))
    unit = lambda name, want, got: [(want & got).cast("long").alias(f"{name}_tp"), (~want & got).cast("long").alias(f"{name}_fp"), (want & ~got).cast("long").alias(f"{name}_fn")]
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("tp", "fp", "fn")))
    bases = [F.when(kept & seen, _base_counts(F.col(f"sequence{n}"), F.col(f"expected{n}"), F.col(f"output{n}"))).otherwise(zero) for n in sides]
    correction = [sum((b[k] for b in bases[1:]), bases[0][k]).alias(f"correction_{k}") for k in ("tp", "fp", "fn")]
    return t.select("scenario", "read_ix", kept.cast("long").alias("expected_retained"), seen.cast("long").alias("observed_retained"), exact.cast("long").alias("exact"), *unit("retention", kept, seen), *unit("trimming", cut("expected"), cut("output")), *correction)


COUNTS = ["expected_retained", "observed_retained", "exact", *(f"{m}_{k}" for m in ("retention", "trimming", "correction") for k in ("tp", "fp", "fn"))]


def summarise(rows: DataFrame) -> DataFrame:
    """Counts and ratios for each scenario and, with scenario null, for all: one pass with grouping sets."""
    sums = rows.rollup("scenario").agg(F.count("*").alias("reads"), *(F.sum(c).alias(c) for c in COUNTS))
    out = sums.withColumn("exact_match_rate", ratio_or_one(F.col("exact"), F.col("expected_retained")))
    for m in ("retention", "trimming", "correction"):
        tp, fp, fn = (F.col(f"{m}_{k}") for k in ("tp", "fp", "fn"))
        out = out.withColumn(f"{m}_precision", ratio_or_one(tp, tp + fp)).withColumn(f"{m}_recall", ratio_or_one(tp, tp + fn))
        p, r = F.col(f"{m}_precision"), F.col(f"{m}_recall")
        out = out.withColumn(f"{m}_f1", F.when(p + r == 0, 0.0).otherwise(F.try_divide(2 * p * r, p + r)))
    return out


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences b - a of two summaries by scenario, and the largest of them in size."""
    ratios = [c for c in a.columns if c.endswith(("_rate", "_precision", "_recall", "_f1"))]
    x, y = a.select("scenario", *(F.col(c).alias(f"a_{c}") for c in ratios)), b.select(F.col("scenario").alias("s2"), *(F.col(c).alias(f"b_{c}") for c in ratios))
    both = x.join(y, F.col("scenario").eqNullSafe(F.col("s2")))
    deltas = [(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"delta_{c}") for c in ratios]
    return both.select("scenario", *deltas).withColumn("largest", F.greatest(*(F.abs(F.col(f"delta_{c}")) for c in ratios)))
