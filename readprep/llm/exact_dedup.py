"""Exact dedup by content sort, in DataFrame operations only.

Normalised texts are range-partitioned by sampled splitters and sorted externally within their range, which places equal
texts side by side; neighbours are compared in full, and each run of equals names the row that stays.

A text with very many copies would fill one range. Such texts are found first by a count over hashes (equal texts have
equal hashes, so none is missed; a foreign text under the same hash is only dealt out finer, never merged). Their rows get
a salt, so their run is cut into pieces that sort in different ranges; what stays of a hot text is settled by a
pre-aggregation over its full content, and the piece that holds the winner keeps it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readprep.llm.common import ascii_lower, carried, partitions, position

#: A text counts as hot from this many copies on, and from the thousandth part of all rows on: at most 1000 texts are hot.
HOT_ROWS = 1000
SALTS = 64
#: Characters of the text in a splitter.
PREFIX = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", carry: bool = False, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; a null text counts as the empty one. Of equal texts the row with
    the smallest (or, by keep="largest", the largest) id stays. Exactly one row of a group is kept: a null id comes last,
    and of rows that repeat an id one is kept. keep_id is null only if all ids of the group are. An empty table gives an
    empty result. With carry, the input's columns follow under the names __c0, __c1 and so on, whatever they are called.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = docs.sparkSession
    best = F.min if keep == "smallest" else F.max
    first = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    safe, names = carried(docs)
    rest = [c for c in safe.columns if carry]
    rows = safe.select(F.col(f"__c{position(names, id_col)}").alias("doc_id"), ascii_lower(F.coalesce(F.col(f"__c{position(names, text_col)}"), F.lit(""))).alias("body"), *rest)

    hashes = rows.groupBy(F.xxhash64("body").alias("h")).agg(F.count("*").alias("n"))
    total = docs.count()
    hot = [r.h for r in hashes.where(F.col("n") >= max(hot_rows, total // 1000)).select("h").collect()]
    salt = F.when(F.xxhash64("body").isin(hot), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).otherwise(F.lit(-1))

    # splitters are sampled rows' keys at the driver, so a key is a short prefix and a hash rather than a whole text; Window
    # adds the body to the sort, and compares neighbours in full
    keyed = rows.withColumn("prefix", F.left("body", F.lit(PREFIX))).withColumn("h", F.xxhash64("body"))
    keys = ["prefix", "h"] + (["salt"] if hot else [])
    ranged = (keyed.withColumn("salt", salt) if hot else keyed).repartitionByRange(partitions(spark), *keys)
    run = Window.partitionBy(*keys, "body")
    placed = ranged.select(
        "doc_id", *(["salt"] if hot else []), *rest,
        F.sha2("body", 256).alias("text_sha256"),
        F.row_number().over(run.orderBy(first)).alias("place"),
        best("doc_id").over(run).alias("piece_id"),
        F.count("*").over(run).alias("piece_size"),
    )
    if not hot:
        return placed.select("doc_id", F.col("piece_id").alias("keep_id"), F.col("piece_size").alias("group_size"), (F.col("place") == 1).alias("kept"), "text_sha256", *rest)

    # pre-aggregated by full content before its shuffle: a row for each hot text and task, then at most 1000 rows
    outcome = rows.where(F.xxhash64("body").isin(hot)).groupBy("body").agg(best("doc_id").alias("o_id"), F.count("*").alias("o_size")).select(F.sha2("body", 256).alias("o_sha"), "o_id", "o_size")
    full = placed.join(F.broadcast(outcome), F.when(F.col("salt") >= 0, F.col("text_sha256")) == F.col("o_sha"), "left")
    # an id has one salt, so only the piece that holds the best id has it as its own best
    return full.select(
        "doc_id",
        F.when(F.col("o_sha").isNotNull(), F.col("o_id")).otherwise(F.col("piece_id")).alias("keep_id"),
        F.coalesce("o_size", "piece_size").alias("group_size"),
        ((F.col("place") == 1) & (F.col("o_sha").isNull() | F.col("o_id").eqNullSafe(F.col("piece_id")))).alias("kept"),
        "text_sha256", *rest,
    )
