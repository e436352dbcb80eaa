"""Checks across the tables of an archive; each gives the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.config import DecodeLimits
from sedimenta.functions.paths import path_problem, resolves_within

_PROBLEM = "id long, problem string"


def _found(df: DataFrame, name: str, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.lit(name).alias("problem"))


def _dense(df: DataFrame, key: str) -> DataFrame:
    """Ids that are repeated, negative or beyond the count: without any, they are 0 to n - 1."""
    n = df.agg(F.count("*").alias("__n"))
    odd = df.select(key).crossJoin(F.broadcast(n)).where((F.col(key) < 0) | (F.col(key) >= F.col("__n"))).select(key)
    twice = df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key)
    return _found(odd.unionByName(twice).distinct(), "not dense", key)


def entry_problems(entries: DataFrame, groups: DataFrame, limits: DecodeLimits = DecodeLimits()) -> DataFrame:
    """Entry ids, paths and their limits, groups that don't exist, folders with bytes, and bad links."""
    paths = entries.groupBy("path").agg(F.count("*").alias("n"), F.max("entry_id").alias("entry_id")).where("n > 1")
    long = entries.where((F.octet_length("path") > limits.path_bytes) | (F.size(F.split("path", "/")) > limits.path_parts))
    files = entries.where("kind = 'file'")
    lost = files.join(groups.select("group_id"), "group_id", "left_anti")
    folders = entries.where("kind = 'directory' AND size <> 0")
    targets = entries.select(F.col("entry_id").alias("t_id"), F.col("kind").alias("t_kind"), F.col("size").alias("t_size"), F.col("digest").alias("t_digest"))
    links = entries.where("kind = 'hardlink'").join(targets, F.col("target_entry_id") == F.col("t_id"), "left")
    fine = F.coalesce((F.col("t_id") < F.col("entry_id")) & (F.col("t_kind") == "file") & (F.col("t_size") == F.col("size")) & (F.col("t_digest") == F.col("digest")), F.lit(False))
    return (
        _dense(entries, "entry_id")
        .unionByName(_found(paths, "path repeated", "entry_id"))
        .unionByName(_found(long, "path limit", "entry_id"))
        .unionByName(_found(entries.where(path_problem(F.col("path"), devices=False).isNotNull()), "unsafe path", "entry_id"))
        .unionByName(_found(lost, "no group", "entry_id"))
        .unionByName(_found(folders, "folder size", "entry_id"))
        .unionByName(_found(links.where(~fine), "hardlink", "entry_id"))
    )


def symlink_problems(links: DataFrame) -> DataFrame:
    """Links (entry_id, path, target) that leave the root."""
    return _found(links.where(~resolves_within(F.col("path"), F.col("target"))), "unsafe symlink", "entry_id")


def projection_problems(entries: DataFrame, index: DataFrame, integrity: DataFrame) -> DataFrame:
    """Rows of the index and the integrity table that aren't projections of entries, and those missing."""
    own, hashes = entries.select(*index.columns), entries.select(*integrity.columns)
    parts = [(own.exceptAll(index), "index lacks"), (index.exceptAll(own), "index has"), (hashes.exceptAll(integrity), "integrity lacks"), (integrity.exceptAll(hashes), "integrity has")]
    out = None
    for df, name in parts:
        more = _found(df, name, "entry_id")
        out = more if out is None else out.unionByName(more)
    return out


def restore_problems(entries: DataFrame, restore: DataFrame) -> DataFrame:
    """Files without exactly one restore row that agrees on group and length, and restore rows without a file."""
    rows = restore.groupBy("entry_id").agg(F.count("*").alias("n"), F.min("group_id").alias("r_group"), F.min("length").alias("r_length"), F.max(F.col("original_offset") != 0).alias("moved"))
    met = entries.where("kind = 'file'").select("entry_id", "group_id", "size").join(rows, "entry_id", "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("size").isNull(), "not a file").when(F.col("n") > 1, "repeated").when(F.col("moved"), "offset").when(F.col("r_group") != F.col("group_id"), "group").when(F.col("r_length") != F.col("size"), "length")
    return met.select(F.col("entry_id").alias("id"), problem.alias("problem")).where("problem IS NOT NULL")


def group_problems(groups: DataFrame, codecs: DataFrame, limits: DecodeLimits = DecodeLimits()) -> DataFrame:
    """Group ids, sizes, expansion, codec chains, and a payload without gaps."""
    large = groups.where(F.col("uncompressed_len") > limits.group_bytes)
    # as decimals: a product that overflows is no violation
    grown = groups.where((F.col("compressed_len") != 0) & (F.col("uncompressed_len").cast("decimal(38,0)") > F.col("compressed_len").cast("decimal(38,0)") * limits.expansion))
    unknown = groups.join(codecs.select(F.col("chain_id").alias("codec_chain_id")), "codec_chain_id", "left_anti")
    # the group before ends where this one begins: an equi-join on ids, not one window over all
    ends = groups.select((F.col("group_id") + 1).alias("group_id"), (F.col("payload_offset") + F.col("compressed_len")).alias("__end"))
    gaps = groups.join(ends, "group_id", "left").where(F.col("payload_offset") != F.when(F.col("group_id") == 0, 0).otherwise(F.col("__end")))
    return (
        _dense(groups, "group_id")
        .unionByName(_found(large, "size", "group_id"))
        .unionByName(_found(grown, "expansion", "group_id"))
        .unionByName(_found(unknown, "codec", "group_id"))
        .unionByName(_found(gaps, "payload gap", "group_id"))
    )


def member_checks(groups: DataFrame, restore: DataFrame) -> DataFrame:
    """For each group its members, their bytes, and whether they fill it without gap and in the declared number."""
    w = Window.partitionBy("group_id").orderBy("group_offset", "entry_id").rowsBetween(Window.unboundedPreceding, -1)
    flags = restore.withColumn("__at", F.coalesce(F.sum("length").over(w), F.lit(0)))
    per = flags.groupBy("group_id").agg(F.count("*").alias("members"), F.sum("length").cast("long").alias("bytes"), F.count_if(F.col("group_offset") != F.col("__at")).alias("breaks"))
    met = groups.select("group_id", "chunk_count", "uncompressed_len").join(per, "group_id", "left")
    fine = F.coalesce((F.col("breaks") == 0) & (F.col("members") == F.col("chunk_count")) & (F.col("bytes") == F.col("uncompressed_len")), F.col("chunk_count") == 0)
    return met.select("group_id", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("bytes", F.lit(0)).alias("bytes"), fine.alias("contiguous"))


def overlaps(sections: DataFrame, start: str = "offset", length: str = "length", key: str = "section") -> DataFrame:
    """Sections that begin before the one ahead of them ends. For a directory of sections, which is short."""
    w = Window.orderBy(start, key)
    ahead = F.max(F.col(start) + F.col(length)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return sections.withColumn("__end", ahead).where(F.col(start) < F.col("__end")).drop("__end")


def table_counts(header: dict[str, int], tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows and told of each table in the header, and whether both agree."""
    out = None
    for name, told in header.items():
        one = tables[name].agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(told).cast("long").alias("told"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("agree", F.col("rows") == F.col("told"))


def count_problems(header: dict[str, int], tables: dict[str, DataFrame]) -> list[str]:
    """Names of tables whose number of rows isn't the header's."""
    return [n for n, df in tables.items() if df.count() != header[n]]


def original_bytes(entries: DataFrame) -> DataFrame:
    """Bytes of files and hardlinks."""
    return entries.agg(F.coalesce(F.sum(F.when(F.col("kind").isin("file", "hardlink"), F.col("size"))), F.lit(0)).cast("long").alias("original_bytes"))


def limit_problems(header: dict[str, int], limits: DecodeLimits = DecodeLimits()) -> list[str]:
    caps = {"entries": limits.entries, "groups": limits.groups, "chunks": limits.chunks, "original_bytes": limits.original_bytes, "metadata_bytes": limits.metadata_bytes, "sections": limits.sections}
    return [n for n, v in header.items() if n in caps and v > caps[n]]


def hash_problems(expected: DataFrame, content: DataFrame, name: str = "blake3") -> DataFrame:
    """Entries whose bytes hash to something else than recorded, or that one side lacks."""
    a, b = expected.select("entry_id", F.col(name).alias("__a")), content.select("entry_id", F.col(name).alias("__b"))
    return _found(a.join(b, "entry_id", "full").where(~F.col("__a").eqNullSafe(F.col("__b"))), "hash", "entry_id")
