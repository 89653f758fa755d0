"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies in the mix. Of all rates that give each source its target
number of words, entropy balancing takes those closest to 1 in relative entropy, every word counting alike. They are
exponentially tilted, rate = exp(lambda[source]); the multipliers maximise the concave dual
sum_s lambda_s * target_s - sum_docs size * exp(lambda_source), found by Newton steps whose gradient and curvature are
distributed sums over the documents. The rates are then rounded into whole copies.

Rounding works in blocks of a source (so a source that holds a third of all rows is dealt over many tasks): a systematic
draw by a hash of the id turns rates into copies, and single copies are then added or removed until the block's words are
as close to its share of the target as its documents allow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readprep.llm.common import WORD, cut, pick, small

#: Rows a rounding block holds on average; the block's sort is the largest thing in a task's memory.
BLOCK_ROWS = 2000
MOST = 3.0


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST) -> DataFrame:
    """A row for each source: source, source_size, target.

    Sources in code point order, null last, take the weights in turn and share all words by them. A target stops at most
    times its source's size; what is over is shared again by weight until no target is above (the fixed point of that, a
    water level, is computed directly). Handles one row a source, so it may sort them in one task.
    """
    cap, order = F.col("source_size") * F.lit(most), Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(order)).withColumn("weight", weight)
    every = Window.partitionBy(F.lit(0))
    upto = every.orderBy(cap / F.col("weight")).rangeBetween(Window.unboundedPreceding, 0)
    level = sources.select("*", cap.alias("cap"), F.sum("source_size").over(every).alias("total"), F.sum(cap).over(upto).alias("caps"), (F.sum("weight").over(every) - F.sum("weight").over(upto)).alias("above"))
    full = level.withColumn("full", F.col("caps") + F.col("cap") / F.col("weight") * F.col("above") <= F.col("total"))
    over, left = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    spread = F.try_divide(F.col("total") - over, left)
    return full.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(spread * F.col("weight")).alias("target"))


def balance(sizes: DataFrame, targets: DataFrame, tolerance: float = 1e-9, most_steps: int = 50) -> DataFrame:
    """The targets with the multiplier and the rate of each source, by Newton iterations on the dual.

    With rates that depend on the source alone the curvature is diagonal, so a step needs two sums a source: the words the
    present rates give and their derivative. Rows of a source and size share one term and are added up before iterating.
    A source without words, or with target 0, has rate 0. Steps are damped to 1 in the multiplier, which makes the
    iteration converge from any start.
    """
    spark = sizes.sparkSession
    terms = cut(sizes.groupBy("source", "size").agg(F.count("*").alias("n")).where(F.col("size") > 0))
    open_ = targets.where((F.col("target") > 0) & (F.col("source_size") > 0))
    now = cut(open_.select("source", "target", F.lit(0.0).alias("lam")))
    n = now.count()
    for _ in range(most_steps):
        tilted = terms.alias("t").join(small(now, n).alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")))
        # the tilt is one factor for a source, so its words add up as integers and reruns agree to the last bit
        words = tilted.groupBy(F.col("l.source").alias("source"), "target", "lam").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
        given = F.col("words") * F.exp("lam")
        sums = words.withColumns({"given": given, "curve": given})
        step = (F.col("target") - F.col("given")) / F.col("curve")
        now = cut(sums.select("source", "target", (F.col("lam") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step))).alias("lam"), (F.abs(F.col("target") - F.col("given")) / F.col("target")).alias("miss")))
        worst = now.agg(F.max("miss")).first()[0]
        if worst is None or worst < tolerance:
            break
    else:
        raise ArithmeticError(f"the multipliers did not settle in {most_steps} steps: a source misses its target by {worst:.3g} of it")
    rates = now.select(F.col("source").alias("s2"), "lam")
    joined = targets.join(small(rates, n), F.col("source").eqNullSafe(F.col("s2")), "left")
    return joined.select("source", "source_size", "target", "lam", F.coalesce(F.exp("lam"), F.lit(0.0)).alias("rate"))


def round_block(size: np.ndarray, draw: np.ndarray, rate: float, most: float = MOST) -> np.ndarray:
    """Copies of each document of a block, whose words come as close to rate * words as single copies allow.

    Systematic rounding in the order of draw, then repair: the largest document that still fits is added or removed.
    """
    order = np.argsort(draw, kind="stable")
    upto = np.cumsum(np.full(len(size), rate))
    start = 0.5
    copies = np.empty(len(size), np.int64)
    copies[order] = np.diff(np.floor(np.concatenate([[0.0], upto]) + start)).astype(np.int64)
    top = math.floor(most + 1e-9)
    copies = np.clip(copies, 0, top)
    goal = rate * size.sum()
    rest = goal - float((copies * size).sum())
    for i in np.lexsort((draw, -size)):
        s = size[i]
        if s <= 0:
            continue
        while rest > 0 and copies[i] < top and abs(rest - s) < abs(rest):
            copies[i] += 1
            rest -= s
        while rest < 0 and copies[i] > 0 and abs(rest + s) < abs(rest):
            copies[i] -= 1
            rest += s
    return copies


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken.

    size is the number of words (a null text has none); taken = copies * size. Null sources form a source of their own.
    Rows that repeat an id are documents of their own and are rounded one by one; rows equal in id, source and size are
    interchangeable. Rows without an id draw one by one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = cut(pick(docs, doc_id=id_col, source=source_col, text=text_col).select("doc_id", "source", size.alias("size")))
    targets = cut(source_targets(sizes, weights, most))
    n = targets.count()
    rates = cut(balance(sizes, targets))
    counts = sizes.groupBy("source").agg(F.count("*").alias("rows"))
    per = cut(rates.alias("r").join(small(counts, n).alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).select(F.col("r.source").alias("s2"), "source_size", "target", "rate", F.ceil(F.col("rows") / F.lit(block_rows)).alias("blocks")))
    # rows without an id draw by their place in the table of sizes, which is written by now
    draw = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id(), "size")).otherwise(F.xxhash64("doc_id", "size"))
    rated = sizes.withColumn("draw", draw).join(small(per, n), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    blocked = rated.withColumn("block", F.pmod(F.xxhash64("draw"), F.col("blocks")))
    schema = "doc_id long, source string, size long, source_size long, target double, rate double, copies long, taken long"

    def rounded(block: pa.Table) -> pa.Table:
        size = block["size"].to_numpy()
        copies = round_block(size, block["draw"].to_numpy(), block["rate"][0].as_py(), most)
        return block.drop_columns(["draw", "block"]).append_column("copies", pa.array(copies)).append_column("taken", pa.array(copies * size))

    return blocked.select("doc_id", "source", "size", "source_size", "target", "rate", "draw", "block").groupBy("source", "block").applyInArrow(rounded, schema)
