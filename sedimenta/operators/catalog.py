"""Catalogue tables and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.config import MIB, DecodeLimits
from sedimenta.errors import EngineError
from sedimenta.functions.paths import sort_key
from sedimenta.operators.ordered import ordered


def entries(files: DataFrame, identity: str | None = None, kind: str | None = None) -> DataFrame:
    """Adds sort_key, a dense entry_id in its order, and kind, to rows with path, size, modified_ns and mode.

    With `identity`, a later row that shares it with an earlier one is a hardlink whose
    target_entry_id is the first; the minimum is combined before the shuffle, so a very common
    identity is no hot group. Rows are files unless a column `kind` says what they are; it becomes the kind.
    """
    own = F.col(kind) if kind else F.lit("file")
    made = ordered(files.withColumn("sort_key", sort_key(F.col("path"))).withColumn("__kind", own), ["sort_key"], number="entry_id")
    if kind:
        made = made.drop(kind)
    if identity is None:
        return made.withColumnRenamed("__kind", "kind").withColumn("target_entry_id", F.lit(None).cast("long"))
    shared = F.when(F.col("__kind") == "file", F.col(identity))
    first = made.where(shared.isNotNull()).groupBy(shared.alias("__identity")).agg(F.min("entry_id").alias("__first"))
    met = made.join(first, shared == F.col("__identity"), "left").drop("__identity")
    later = F.col("entry_id") > F.col("__first")
    return met.withColumn("kind", F.when(later, "hardlink").otherwise(F.col("__kind"))).withColumn("target_entry_id", F.when(later, F.col("__first"))).drop("__first", "__kind")


def check_unique_paths(made: DataFrame) -> DataFrame:
    """Paths that occur more than once; a scan with any fails."""
    return made.groupBy("sort_key").agg(F.count("*").alias("n")).where("n > 1")


def scan_budget(files: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """Bytes that a scan holds: 512 for each entry, its path, 32 for each component, and its sort key; more than `most_bytes` fail."""
    parts = F.size(F.split(F.col("path"), "/")).cast("long")
    path_bytes = F.octet_length("path").cast("long")
    key_bytes = path_bytes - (parts - 1) + 9 * parts
    out = files.agg(F.count("*").alias("entries"), F.coalesce(F.sum(512 + path_bytes + 32 * parts + key_bytes), F.lit(0)).cast("long").alias("held_bytes"))
    if most_bytes is None:
        return out
    return out.where(F.assert_true(F.col("held_bytes") <= most_bytes, F.lit("resource_limit")).isNull())


def listing(made: DataFrame) -> DataFrame:
    return made.select("entry_id", "path", "kind", "size", "modified_ns")


#: Names of the kinds of entries as people read them.
KINDS = {"file": "File", "directory": "Directory", "hardlink": "Hardlink", "symlink": "Symlink"}


def kind_name(kind: Column) -> Column:
    """The name of an entry's kind; an unknown kind fails."""
    out = F.raise_error(F.concat(F.lit("invalid_metadata: kind "), F.coalesce(kind, F.lit("null"))))
    for k, name in KINDS.items():
        out = F.when(kind == k, name).otherwise(out)
    return out


def lines(made: DataFrame) -> DataFrame:
    """The listing for people: entry_id, and a line with size, kind and path."""
    return made.select("entry_id", F.format_string("%10d  %s  %s", F.col("size"), kind_name(F.col("kind")), F.col("path")).alias("line"))


def inspection_lines(inspected: dict) -> str:
    """The row of `inspection` for people."""
    kinds = ", ".join(f"{k}: {inspected[k]}" for k in ("files", "directories", "hardlinks", "symlinks"))
    return f"entries: {inspected['entries']} ({kinds})\ngroups: {inspected['groups']}\noriginal bytes: {inspected['original_bytes']}"


def inspection(made: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts by kind, groups, and original bytes, to which files and hardlinks both count."""
    kinds = [F.count_if(F.col("kind") == k).alias(n) for k, n in (("file", "files"), ("directory", "directories"), ("hardlink", "hardlinks"), ("symlink", "symlinks"))]
    held = F.when(F.col("kind").isin("file", "hardlink"), F.col("size")).otherwise(0)
    return made.agg(F.count("*").alias("entries"), *kinds, F.coalesce(F.sum(held), F.lit(0)).cast("long").alias("original_bytes")).crossJoin(groups.agg(F.countDistinct("group_id").alias("groups")))


def resolved(made: DataFrame) -> DataFrame:
    """Each entry with the entry that holds its bytes."""
    targets = made.where("kind = 'file'").select(F.col("entry_id").alias("__t"), F.col("size").alias("target_size"))
    owner = F.coalesce("target_entry_id", "entry_id")
    return made.withColumn("owner_id", owner).join(targets, F.col("owner_id") == F.col("__t"), "left").drop("__t")


def extracted(made: DataFrame, restore: DataFrame, payload: DataFrame, wanted: Column) -> DataFrame:
    """entry_id, path, content of the entries that `wanted` selects; reads only the groups that own them."""
    chosen = resolved(made.where(wanted)).where(F.col("kind").isin("file", "hardlink")).select("entry_id", "path", "owner_id")
    places = restore.select(F.col("entry_id").alias("owner_id"), "group_id", "group_offset", "length")
    met = chosen.join(places, "owner_id").join(payload, "group_id")
    content = F.expr("substring(payload, cast(group_offset + 1 as int), cast(length as int))")
    return met.select("entry_id", "path", content.alias("content"))


def ranged(content: DataFrame, offset: int, length: int, data: str = "content") -> DataFrame:
    """A slice of each row's bytes and its digest, and for rows that end before it the problem instead."""
    fits = F.octet_length(data) >= offset + length
    piece = F.when(fits, F.expr(f"substring({data}, {offset + 1}, {length})"))
    return content.withColumn("slice", piece).withColumn("digest", F.sha2(piece, 256)).withColumn("problem", F.when(~fits, "invalid_range"))


def read_range(content: DataFrame, offset: int, length: int, data: str = "content") -> DataFrame:
    """A slice of each row's bytes and its digest; a slice beyond the end is an invalid range."""
    size = F.octet_length(data)
    whole = F.assert_true((F.lit(offset) + length <= size), F.lit("invalid_range"))
    piece = F.expr(f"substring({data}, {offset + 1}, {length})")
    return content.where(whole.isNull()).withColumn("slice", piece).withColumn("digest", F.sha2(piece, 256))


def range_plan(sizes: DataFrame, size: str = "size", piece: int = 64 * MIB) -> DataFrame:
    """Pieces in which a client reads an entry: offset and length; an empty entry has none."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1, F.lit(piece).cast("long")))
    return sizes.where(F.col(size) > 0).withColumn("offset", at).withColumn("length", F.least(F.lit(piece).cast("long"), F.col(size) - F.col("offset")))


def pieces(content: DataFrame, piece: int = 64 * MIB, data: str = "content") -> DataFrame:
    """The pieces of `range_plan` with their bytes and the digest of each; an empty content has none."""
    planned = range_plan(content.withColumn("size", F.octet_length(data).cast("long")), piece=piece)
    cut = F.substring(F.col(data), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return planned.withColumn(data, cut).withColumn("digest", F.sha2(F.col(data), 256))


def rejoined(parts: DataFrame, key: str, data: str = "content") -> DataFrame:
    """key, content and the number of pieces from `pieces`; a piece with another digest or length fails, as does a gap."""
    wrong = F.raise_error(F.concat(F.lit("checksum_mismatch: piece of "), F.col(key).cast("string")))
    sound = parts.withColumn(data, F.when((F.sha2(F.col(data), 256) == F.col("digest")) & (F.octet_length(data) == F.col("length")), F.col(data)).otherwise(wrong))
    made = sound.groupBy(key).agg(F.expr(f"listagg({data}) WITHIN GROUP (ORDER BY offset)").alias(data), F.count("*").alias("pieces"), F.max("size").alias("__size"))
    gap = F.raise_error(F.concat(F.lit("invalid_range: pieces of "), F.col(key).cast("string")))
    return made.withColumn(data, F.when(F.octet_length(data) == F.col("__size"), F.col(data)).otherwise(gap)).drop("__size")


def measured(made: DataFrame, most_entries: int = DecodeLimits.entries) -> DataFrame:
    """Bytes, entries and the largest file; too many entries are a resource limit."""
    out = made.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("entries"), F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("max_file"))
    return out.where(F.assert_true(F.col("entries") <= most_entries, F.lit("resource_limit")).isNull())


def changed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Entries whose length, time, identity or hash differ between two passes, or that one lacks."""
    cols = ["size", "modified_ns", "identity", "hash"]
    pair = first.select("entry_id", F.struct(*cols).alias("a")).join(second.select("entry_id", F.struct(*cols).alias("b")), "entry_id", "full")
    return pair.where(~F.col("a").eqNullSafe(F.col("b"))).select("entry_id")


def require_empty(violations: DataFrame, name: str) -> None:
    """Fails with the named error if there is any violation."""
    if bad := violations.limit(1).collect():
        raise EngineError(name, str(bad[0].asDict()))
