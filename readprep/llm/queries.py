"""The queries of this subpackage: each applies an operator to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readprep.llm.exact_dedup import exact_dedup
from readprep.llm.language_id import languages
from readprep.llm.lm_scoring import lm_scores
from readprep.llm.mixing import mix
from readprep.llm.near_dedup import near_duplicates
from readprep.llm.neighbours import nearest
from readprep.llm.quotes import link_quotes
from readprep.llm.sentencepiece import encode_texts
from readprep.llm.substring_dedup import substring_dedup
from readprep.llm.warc import derivatives, responses_from_pages


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses_from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_quotation_linking": op6_quotation_linking,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_exact_dedup": op10_exact_dedup,
    "pipeline": pipeline,
}
