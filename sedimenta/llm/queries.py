"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import bpe, langid, media, mixing, pii, quality, simhash, topk, toxicity, urls
from sedimenta.llm.oracles import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(_table(spark, sf_dir, "documents"), ["doc_id"])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(_table(spark, sf_dir, "documents"), ["doc_id"])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), ["doc_id"])


def op9_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: each vector of embeddings is rendered as one."""
    found = media.copies(media.rendered(_table(spark, sf_dir, "embeddings")))
    return found.withColumnRenamed("img", "vec_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_pii": op2_pii,
    "op3_language_id": op3_language_id,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_source_mixing": op5_source_mixing,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_url_filter": op7_url_filter,
    "op8_quality": op8_quality,
    "op9_image_copies": op9_image_copies,
    "op10_toxicity": op10_toxicity,
}
