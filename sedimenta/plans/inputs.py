"""The engine's inputs, made from the tables of documents, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.catalog import entries

EPOCH_NS = 1_700_000_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path() -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def document_files(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """A file for each document: path, size, time, mode, and the digest of its bytes as identity."""
    docs = table(spark, sf_dir, "documents")
    mode = F.when(F.col("lang") == "en", 420).when(F.col("lang") == "de", 384).when(F.col("lang") == "fr", 493).otherwise(292).cast("long")
    return docs.select(
        "doc_id", "lang", "source", document_path().alias("path"), F.octet_length("text").cast("long").alias("size"), (EPOCH_NS + F.col("doc_id") * 1_000_003).alias("modified_ns"), mode.alias("mode"), F.sha2("text", 256).alias("digest"), *(["text"] if text else [])
    )


def document_entries(spark: SparkSession, sf_dir: str, hardlinks: bool = True) -> DataFrame:
    """Catalogue entries of the documents; a later document with the same bytes is a hardlink."""
    return entries(document_files(spark, sf_dir), "digest" if hardlinks else None)


def micro_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing inputs: labelled toxic documents need isolated access; keys come from language and source."""
    files = document_files(spark, sf_dir)
    toxic = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    met = files.join(toxic, F.col("doc_id") == F.col("l_id"), "left")
    return met.select(
        F.col("doc_id").alias("entry_id"), "path", "size", "modified_ns", "mode", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("requires_isolated_access"),
        F.length("lang").cast("decimal(20,0)").alias("family_key"), F.col("lang").alias("path_prefix_key"), F.lit("txt").alias("extension_key"), (F.col("doc_id") % 7).cast("decimal(20,0)").alias("similarity_key"),
    )


def language_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large objects: all documents of a language end to end, as sizes."""
    files = document_files(spark, sf_dir)
    return files.groupBy("lang").agg(F.sum("size").cast("long").alias("size")).select((F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1))).cast("long").alias("entry_id"), F.lit(0).cast("long").alias("object_id"), "size", "lang")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job commands from events: the user is the session, props.k numbers its jobs."""
    kinds = F.create_map(*[F.lit(x) for x in ("view", "submit", "click", "start", "signup", "cancel", "purchase", "complete", "error", "fail")])
    states = F.create_map(*[F.lit(x) for x in ("view", "queued", "click", "running", "signup", "cancelling", "purchase", "completed", "error", "failed")])
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")  # whatever the session's zone
    return e.select("event_id", "ts", F.col("user_id").alias("owner"), k.alias("job_no"), kinds[F.col("event_type")].alias("command"), states[F.col("event_type")].alias("state"), "value", ms.alias("ms"))
