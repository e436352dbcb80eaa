"""Solid groups, restore maps, candidate codecs, costs and resource estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.config import CANDIDATES, CODECS, COST_CODEC, COST_GROUP, COST_INDEX, COST_INTEGRITY, COST_PADDING, GROUP_TARGETS, KIB, MEMORY_BOUNDS, MIB
from sedimenta.operators.ordered import next_fit, ordered


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, t) for p, t in GROUP_TARGETS.items()], "profile string, target long")


def candidates(spark: SparkSession) -> DataFrame:
    """profile, codec, codec_id: the codecs that each profile tries."""
    return spark.createDataFrame([(p, c, CODECS[c]) for p, cs in CANDIDATES.items() for c in cs], "profile string, codec string, codec_id int")


def grouped(files: DataFrame, profile: str) -> DataFrame:
    """Adds position, group_id and group_offset to files (entry_id, size) in the order of entry_id.

    Order is kept, a group ends before the file that would bring it over the target, and
    a longer file stays whole in a group of its own; raw has a group for each file.
    """
    laid = ordered(files, ["entry_id"], number="position", sums={"__before": "size"})
    made = next_fit(laid, "position", "size", GROUP_TARGETS[profile])
    start = made.groupBy("group_id").agg(F.min("__before").alias("__start"))
    return made.join(start, "group_id").withColumn("group_offset", F.col("__before") - F.col("__start")).drop("__before", "__start")


def restore_map(placed: DataFrame) -> DataFrame:
    return placed.select("entry_id", F.lit(0).cast("long").alias("original_offset"), F.col("size").alias("length"), "group_id", "group_offset")


def group_table(placed: DataFrame) -> DataFrame:
    return placed.groupBy("group_id").agg(F.count("*").alias("chunk_count"), F.sum("size").cast("long").alias("uncompressed_len"), F.min("entry_id").alias("first_entry"))


def memory_bound(codec: Column, length: Column) -> Column:
    """Bytes that a codec may need for an input."""
    out = F.lit(None).cast("long")
    for name, more in MEMORY_BOUNDS.items():
        out = F.when(codec == name, length + F.lit(more).cast("long")).otherwise(out)
    return out


def total_cost(payload: Column) -> Column:
    return payload + (COST_CODEC + COST_GROUP + COST_INDEX + COST_INTEGRITY + COST_PADDING)


def registry(used: DataFrame) -> DataFrame:
    """chain_id, codec_id, required: a record for each codec in use; chain 0 is kept for raw archives."""
    return used.select("codec_id").distinct().select((F.col("codec_id") + 1).alias("chain_id"), "codec_id", F.lit(True).alias("required"))


def registry_problems(records: DataFrame, known: tuple[int, ...] = tuple(CODECS.values()), most: int = 32) -> DataFrame:
    """Duplicate chains, chain 0, unknown required codecs, and too many records."""
    twice = records.groupBy("chain_id").agg(F.count("*").alias("n")).where("n > 1").select("chain_id", F.lit("duplicate").alias("problem"))
    zero = records.where("chain_id = 0").select("chain_id", F.lit("reserved").alias("problem"))
    unknown = records.where(F.col("required") & ~F.col("codec_id").isin(*known)).select("chain_id", F.lit("unknown").alias("problem"))
    many = records.agg(F.count("*").alias("chain_id")).where(F.col("chain_id") > most).select(F.col("chain_id").cast("int").alias("chain_id"), F.lit("too many").alias("problem"))
    return twice.unionByName(zero).unionByName(unknown).unionByName(many)


def estimates(measure: DataFrame, by_profile: DataFrame) -> DataFrame:
    """Memory, temporary space and output that packing needs at most, for a measure (bytes, entries, max_file) under each profile."""
    n, total = F.col("entries"), F.col("bytes")
    output = total + n * MIB + 16 * MIB
    scan = n * 512 + 64 * KIB
    largest = F.greatest(F.col("max_file"), F.least(total, F.col("target")))
    tried = F.array(*[F.when(F.col("profile").isin(*[p for p, cs in CANDIDATES.items() if c in cs]), F.lit(m)).otherwise(F.lit(0)) for c, m in MEMORY_BOUNDS.items()])
    coded = F.greatest(largest + F.array_max(tried) + largest + MIB + 2, scan)
    raw = F.col("profile") == "raw"
    return measure.crossJoin(F.broadcast(by_profile)).select(
        "profile", F.when(raw, scan).otherwise(coded).cast("long").alias("memory_bytes"), F.when(raw, output).otherwise(total + output).cast("long").alias("temp_bytes"), output.cast("long").alias("output_bytes")
    )
