"""A training corpus from raw documents: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import bpe, langid, mixing, pii, simhash
from sedimenta.llm.common import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts, those without letters and those far from all languages go.

    Repeated rows stay or go together; texts are judged whole at any length; without a labelled document all go.
    """
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Of rows that repeat it one stays, and of a group without any doc_id too. Null and empty texts are one group.
    """
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows.

    A null text stays null, with a null n_chars; repeated rows are masked alike; an empty text stays empty.
    """
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source. Texts without words have no tokens and go with their block; rows with the same id and text are taken together.
    """
    return mixing.drawn(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them. A null text counts as empty, without ids; each row gives a row."""
    made = bpe.encoded(docs, ["doc_id", "lang", "source"])
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("source mixing", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: Language models and span classifiers aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table of documents, each one's rows written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
