"""Quotation linking, in DataFrame operations only.

Lines that begin with quote marks (">", nested as ">>" or "> >") are quoted at as many levels. Consecutive lines of one
level form a passage; passages and their single lines are normalised and hashed, and joined by hash to the messages of the
conversation that hold them unquoted: the latest of those before the quoting message. A message replies to the origin of
its shallowest quotes. The result has the messages without quotes and the place of each in its conversation, ordered by
threads: a thread stands where its first message does, and its messages follow in order of turn.

The latest origin before a message is found by sorting, not by pairing quotes with origins: within blocks of turns by a
window, across blocks by a second window over one row a block, so a phrase that fills a conversation stays divisible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readprep.llm.common import cut, partitions, pick

#: Turns of a block in the search for the latest origin.
BLOCK = 1024
_MARKS = r"^(?:[ \t]{0,3}>)+"
_KEY = ["conv_id", "turn", "k"]


def lines_of(messages: DataFrame) -> DataFrame:
    """Every line of a message (conv_id, turn, k, text): pos, level, rest (without marks), norm."""
    split = messages.select(*_KEY, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r")).alias("pos", "line"))
    marks = F.regexp_extract("line", _MARKS, 0)
    rest = F.substring(F.col("line"), F.length(marks) + 1, F.length("line"))
    return split.select(*_KEY, "pos", F.length(F.regexp_replace(marks, "[^>]", "")).cast("long").alias("level"), rest.alias("rest"), F.lower(F.trim(F.regexp_replace(rest, r"\s+", " "))).alias("norm"))


def passages(lines: DataFrame) -> DataFrame:
    """Runs of lines of a level, ended by blank lines: conv_id, turn, k, run, level, norm (their lines joined)."""
    order = Window.partitionBy(*_KEY).orderBy("pos")
    breaks = (F.col("level") != F.lag("level", 1, -1).over(order)) | (F.col("norm") == "") | (F.lag("norm", 1, "").over(order) == "")
    runs = lines.withColumn("breaks", breaks).withColumn("run", F.sum(F.col("breaks").cast("long")).over(order)).where(F.col("norm") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]), " ")
    return runs, runs.groupBy(*_KEY, "run", "level").agg(joined.alias("norm"))


def origins(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, k, run, level, whole, size, origin): quoted passages and lines with the latest earlier turn that has them."""
    runs, whole = passages(lines)
    rows = whole.select(*_KEY, "run", "level", "norm", F.lit(True).alias("whole")).union(runs.select(*_KEY, "run", "level", "norm", F.lit(False)))
    rows = rows.select(*_KEY, "run", "level", "whole", F.length("norm").cast("long").alias("size"), F.sha2("norm", 256).alias("hash"), F.floor(F.col("turn") / F.lit(BLOCK)).alias("block"))
    rows = rows.where("conv_id is not null and turn is not null")
    quoted = rows.where("level > 0").withColumn("own", F.lit(None).cast("long"))
    said = rows.where("level = 0").groupBy("conv_id", "hash", "block", "turn").agg(F.count("*").alias("n"))
    empty = {c: F.lit(None).cast(t) for c, t in (("k", "long"), ("run", "long"), ("level", "long"), ("whole", "boolean"), ("size", "long"))}
    wanted = quoted.select("conv_id", "hash").distinct()
    said = said.join(wanted, ["conv_id", "hash"], "left_semi").select("conv_id", "turn", "hash", "block", F.col("turn").alias("own"), *(v.alias(c) for c, v in empty.items()))
    both = quoted.select(said.columns).union(said)
    inside = Window.partitionBy("conv_id", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("own").over(inside)).where("level is not null")
    blocks = said.groupBy("conv_id", "hash", "block").agg(F.max("own").alias("last"))
    marks = blocks.union(quoted.select("conv_id", "hash", "block", "own")).groupBy("conv_id", "hash", "block").agg(F.max("last").alias("last"))
    before = marks.withColumn("before", F.max("last").over(Window.partitionBy("conv_id", "hash").orderBy("block").rangeBetween(Window.unboundedPreceding, -1))).drop("last")
    found = near.join(before, ["conv_id", "hash", "block"], "left")
    return found.select(*_KEY, "run", "level", "whole", "size", F.coalesce("near", "before").alias("origin"))


def _replies(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(linked passages of each message, reply_to of each message)."""
    hits = found.where("origin is not null")
    per_run = hits.groupBy(*_KEY, "run", "level", "origin").agg(F.max("whole").alias("whole"), F.sum(F.when(F.col("whole"), 0).otherwise(F.col("size"))).alias("size"))
    best = per_run.groupBy(*_KEY, "run", "level").agg(F.max(F.struct("whole", "size", "origin")).alias("best"))
    linked = best.select(*_KEY, "level", F.col("best.size").alias("size"), F.col("best.origin").alias("origin"))
    weight = linked.groupBy(*_KEY, "level", "origin").agg(F.sum("size").alias("size"))
    return linked, weight.groupBy(*_KEY).agg(F.max(F.struct((-F.col("level")).alias("shallow"), "size", "origin")).alias("best")).select(*_KEY, F.col("best.origin").alias("reply_to"))


def _threads(replies: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, root, depth) of the turns that reply; a turn with several rows follows its latest origin."""
    step = cut(replies.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("root")).withColumn("depth", F.lit(1).cast("long")))
    for _ in range(most_rounds):  # every round doubles the way towards the root
        up = step.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        joined = step.join(up, (F.col("conv_id") == F.col("c2")) & (F.col("root") == F.col("t2")), "left")
        following = cut(joined.select("conv_id", "turn", F.coalesce("r2", "root").alias("root"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("r2").isNotNull().alias("moved")))
        step = following.drop("moved")
        if following.where("moved").isEmpty():
            return step
    raise RuntimeError("threads did not settle")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct message: conv_id, place, turn, role, reply_to, root, depth, n_quoted, n_passages, n_linked, body.

    body is the text without quoted lines, trimmed at its end; n_quoted counts these lines, n_passages the quoted passages
    and n_linked those with an origin: an earlier turn of the conversation that holds the passage (else most of its lines)
    unquoted. root is the first turn of the thread and depth the number of replies up to it; a message that replies to
    none is its own root. place counts from 1 in order of (root, turn, role, text hash) within a conversation. Rows equal
    in all four columns count once. A null conversation is a conversation of its own without links; null turns come last
    and link with nothing; a null text has an empty body. An empty table gives an empty result.
    """
    spark = messages.sparkSession
    rows = cut(pick(messages, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).distinct().withColumn("k", F.xxhash64("role", "text")))
    lines = cut(lines_of(rows))
    body = lines.groupBy(*_KEY).agg(
        F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).alias("n_quoted"),
        F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "rest")))).alias("kept"),
    )
    body = body.withColumn("body", F.rtrim(F.array_join(F.transform("kept", lambda x: x["rest"]), "\n"))).drop("kept")
    found = cut(origins(lines))
    linked, replies = _replies(found)
    n_passages = found.where("whole").groupBy(*_KEY).agg(F.count("*").alias("n_passages"))
    n_linked = linked.groupBy(*_KEY).agg(F.count("*").alias("n_linked"))
    replies = cut(replies)
    threads = _threads(replies)

    def with_(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        b = b.select(*(F.col(c).alias(f"_{c}") for c in keys), *(c for c in b.columns if c not in keys))
        on = F.lit(True)
        for c in keys:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return a.join(b, on, "left").drop(*(f"_{c}" for c in keys))

    full = rows
    for part in (body, replies, n_passages, n_linked):
        full = with_(full, part, _KEY)
    full = with_(full, threads, ["conv_id", "turn"])
    zero = F.lit(0).cast("long")
    full = full.select("conv_id", "turn", "role", "k", "reply_to", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", zero).alias("depth"), *(F.coalesce(c, zero).cast("long").alias(c) for c in ("n_quoted", "n_passages", "n_linked")), F.coalesce("body", F.lit("")).alias("body"))

    # ranks without gathering a conversation: rows in range order, numbered within their range, plus what came before
    order = [F.col("conv_id").asc_nulls_first(), F.col("root").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("k").asc()]
    placed = cut(full.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    spans = placed.groupBy("conv_id", part.alias("part")).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), zero)
    spans = spans.select(F.col("conv_id").alias("c2"), F.col("part").alias("p2"), "low", earlier.alias("earlier"))
    ranked = placed.join(spans, F.col("conv_id").eqNullSafe(F.col("c2")) & (part == F.col("p2")))
    return ranked.select("conv_id", (F.col("at") - F.col("low") + F.col("earlier") + 1).alias("place"), "turn", "role", "reply_to", "root", "depth", "n_quoted", "n_passages", "n_linked", "body")
