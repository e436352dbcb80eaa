"""Micro-file packs: eligibility, canonical order, next-fit packing, metadata and front coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.config import Chunking
from sedimenta.errors import EngineError
from sedimenta.operators.ordered import fold_sorted, lagged, next_fit, ordered

#: The canonical order of members.
ORDER = ["family_key", "path_prefix_key", "extension_key", "mode", "similarity_key", "path", "entry_id"]
WIDE = "decimal(20,0)"


def exclusion(config: Chunking = Chunking()) -> Column:
    """Why an input isn't packed, null if it is: isolated access comes before size."""
    return F.when(F.col("requires_isolated_access"), "requires_isolated_access").when(F.col("size") > config.micro_file_max, "too_large")


def excluded(inputs: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """entry_id, reason and position (in canonical order among the excluded)."""
    out = inputs.withColumn("reason", exclusion(config)).where("reason IS NOT NULL")
    return ordered(out, ORDER, number="position").select("entry_id", "reason", "position")


def packed(inputs: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Eligible inputs with pack_id and ordinal in it, content_offset and position in canonical order.

    A pack ends only when the next member would bring it over the target.
    """
    eligible = inputs.where(exclusion(config).isNull()).withColumn("length", F.col("size").cast("long"))
    laid = ordered(eligible, ORDER, number="position", sums={"__before": "length"})
    grouped = next_fit(laid, "position", "length", config.pack_target, "pack_id")
    first = grouped.groupBy("pack_id").agg(F.min("position").alias("__first"), F.min("__before").alias("__start"))
    met = grouped.join(first, "pack_id")
    return met.withColumn("ordinal", F.col("position") - F.col("__first")).withColumn("content_offset", F.col("__before") - F.col("__start")).drop("__first", "__start", "__before")


def headers(members: DataFrame) -> DataFrame:
    """A row for each pack: length, first time, and the sorted dictionary of modes."""
    return members.groupBy("pack_id").agg(F.sum("length").cast("long").alias("uncompressed_len"), F.min("modified_ns").alias("base_modified_ns"), F.array_sort(F.collect_set("mode")).alias("mode_dictionary"))


def with_metadata(members: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Adds the difference to the pack's first time, up to 2^64-1, and the index of the mode in the pack's dictionary."""
    heads = headers(members) if heads is None else heads
    met = members.join(heads.select("pack_id", "base_modified_ns", "mode_dictionary"), "pack_id")
    delta = F.col("modified_ns").cast(WIDE) - F.col("base_modified_ns").cast(WIDE)
    return met.withColumn("modified_ns_delta", delta.cast(WIDE)).withColumn("mode_index", F.array_position("mode_dictionary", F.col("mode")) - 1).drop("mode_dictionary", "base_modified_ns")


def common_prefix(a: Column, b: Column) -> Column:
    """The number of bytes that two strings share at their beginning."""
    pairs = [F.regexp_extract_all(F.hex(F.encode(x, "UTF-8")), F.lit(".."), 0) for x in (a, b)]
    most = F.least(F.octet_length(a), F.octet_length(b))
    same = F.zip_with(F.slice(pairs[0], F.lit(1), most), F.slice(pairs[1], F.lit(1), most), lambda x, y: x == y)
    first_other = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first_other > 0, first_other - 1).otherwise(most)


def front_coded(members: DataFrame) -> DataFrame:
    """Adds shared_prefix_len with the path before it in the pack, and the rest of the path's bytes.

    A pack of empty files has no bound, so the path before is found without a window over a whole pack.
    """
    led = lagged(members, ["pack_id"], ["ordinal"], "path", "__before")
    coded = led.withColumn("shared_prefix_len", common_prefix(F.coalesce("__before", F.lit("")), F.col("path")).cast("long")).drop("__before")
    return coded.withColumn("suffix", F.unhex(F.expr("substring(hex(encode(path, 'UTF-8')), cast(2 * shared_prefix_len + 1 as int))")))


def expanded(coded: DataFrame) -> DataFrame:
    """pack_id, ordinal, path from shared_prefix_len and suffix: each path needs the one before it, and only that is held.

    A prefix longer than the path before fails.
    """

    def step(last: bytes, shared: int, suffix: bytes) -> tuple[bytes, tuple]:
        if shared > len(last):
            raise EngineError("invalid_metadata", "prefix")
        path = last[:shared] + suffix
        return path, (path.decode(),)

    rows = coded.select("pack_id", "ordinal", "shared_prefix_len", "suffix")
    return fold_sorted(rows, ["pack_id"], ["ordinal"], ["shared_prefix_len", "suffix"], "path string", bytes, step).select("pack_id", "ordinal", "path")


def pack_problems(members: DataFrame, heads: DataFrame) -> DataFrame:
    """What contradicts the layout of each pack: ordinals, offsets, lengths, dictionary."""
    w = Window.partitionBy("pack_id").orderBy("ordinal")
    flags = members.withColumn("__o", F.row_number().over(w) - 1).withColumn("__c", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = flags.groupBy("pack_id").agg(F.count_if(F.col("ordinal") != F.col("__o")).alias("ordinals"), F.count_if(F.col("content_offset") != F.col("__c")).alias("offsets"), F.sum("length").alias("total"))
    rising = F.forall(F.zip_with(F.slice("mode_dictionary", 2, F.size("mode_dictionary")), F.slice("mode_dictionary", 1, F.size("mode_dictionary") - 1), lambda b, a: b > a), lambda x: x)
    met = heads.join(per, "pack_id", "full")
    problem = F.when(F.col("ordinals").isNull() | F.col("uncompressed_len").isNull(), "missing").when(F.col("ordinals") > 0, "ordinal").when(F.col("offsets") > 0, "offset").when(F.col("total") != F.col("uncompressed_len"), "length").when(~rising, "dictionary")
    return met.select("pack_id", problem.alias("problem")).where("problem IS NOT NULL")


def plan_problems(members: DataFrame, out: DataFrame) -> DataFrame:
    """Entries that occur more than once in packs and exclusions together, and gaps between pack ids."""
    both = members.select("entry_id").unionByName(out.select("entry_id"))
    twice = both.groupBy("entry_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("entry_id").alias("id"), F.lit("entry").alias("problem"))
    ids = members.agg(F.max("pack_id").alias("m"), F.countDistinct("pack_id").alias("n"))
    return twice.unionByName(ids.where("m + 1 <> n").select(F.col("m").alias("id"), F.lit("pack").alias("problem")))


def input_problems(inputs: DataFrame) -> DataFrame:
    """Empty paths, and ids or paths that occur more than once."""
    empty = inputs.where("path IS NULL OR path = ''").select(F.col("entry_id").cast("string").alias("what"), F.lit("empty path").alias("problem"))
    ids = inputs.groupBy("entry_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("entry_id").cast("string").alias("what"), F.lit("id").alias("problem"))
    paths = inputs.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.col("path").alias("what"), F.lit("path").alias("problem"))
    return empty.unionByName(ids).unionByName(paths)


def as_chunks(members: DataFrame, object_id: int = 0) -> DataFrame:
    """Each member as a draft of one logical chunk."""
    return members.select("entry_id", F.lit(object_id).cast("long").alias("object_id"), F.lit(0).cast("long").alias("logical_offset"), "length", F.lit("MicroFile").alias("method"))
