"""A corpus pipeline of five stages, each of which calls one operator of readprep.llm.

Every stage takes (spark, docs, sf_dir); docs has the columns of `documents`, and all stages but the last return these
columns for the documents they keep. run() applies them in order, each stage written as Parquet in the shared folder and
read again as the next one's input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readprep.llm.common import carried, checkpoint_dir, cut, position, small
from readprep.llm.exact_dedup import exact_dedup
from readprep.llm.language_id import keep_identified, learned
from readprep.llm.mixing import mix
from readprep.llm.near_dedup import near_duplicates
from readprep.llm.sentencepiece import encode_texts


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs under safe names with the id as __key, and the original names."""
    safe, names = carried(docs)
    return safe.withColumn("__key", F.col(f"__c{position(names, 'doc_id')}").cast("long")), names


def _named(safe: DataFrame, names: list[str]) -> DataFrame:
    return safe.select(*(f"__c{i}" for i in range(len(names)))).toDF(*names)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language is found; those without a letter go, null and empty texts among them.

    Rows are judged one by one, so null or repeated ids and equal rows need no rule. Where no row has a language to learn
    from, all rows with a letter stay. An empty table stays empty.
    """
    return keep_identified(docs, learned(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the smallest id; null counts as the empty text, and a null id comes last.

    Of rows equal in both one stays. An empty table stays empty.
    """
    kept = exact_dedup(docs, carry=True).where("kept")
    return _named(kept, docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies; documents without words have none and stay.

    Where ids are null or repeat, each row is a document of its own, and the first row of the table stays. An empty table
    stays empty.
    """
    safe, names = _keyed(docs)
    if not safe.groupBy("__key").count().where("count > 1 or __key is null").isEmpty():
        safe = cut(safe.withColumn("__key", F.monotonically_increasing_id()))  # fixed by being written
    found = near_duplicates(safe, id_col="__key", text_col=f"__c{position(names, 'text')}")
    dropped = cut(found.where("not kept").select(F.col("doc_id").alias("key")))
    return _named(safe.join(small(dropped, dropped.count()), F.col("__key") == F.col("key"), "left_anti"), names)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times; a null source is a source of its own.

    Where ids are null or repeat, each row is a document of its own. Documents without words are taken by rate alone. An
    empty table stays empty.
    """
    safe, names = _keyed(docs)
    if not safe.groupBy("__key").count().where("count > 1 or __key is null").isEmpty():
        safe = cut(safe.withColumn("__key", F.monotonically_increasing_id()))  # fixed by being written
    mixed = mix(safe, id_col="__key", text_col=f"__c{position(names, 'text')}", source_col=f"__c{position(names, 'source')}")
    copies = cut(mixed.where("copies > 0").select(F.col("doc_id").alias("key"), F.col("copies").alias("n")))
    taken = safe.join(small(copies, copies.count()), F.col("__key") == F.col("key"))
    return _named(taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))), names)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, row by row; a null text has none. The last stage."""
    return encode_texts(docs).select("doc_id", "n_pieces", "n_bytes", "round_trip", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: Viterbi decoding, signatures, rounding and segmentation aren't expressible in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`. A stage's folder goes once the next one is written; the last stays."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        written = f"{folder}/{i}-{name}"
        out.write.parquet(written)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs, before = spark.read.parquet(written), written
    return docs
