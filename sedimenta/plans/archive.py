"""Whole plans: pack files into an archive of Parquet tables, verify it, and read from it."""

from __future__ import annotations

import json
import uuid
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.config import GROUP_TARGETS, DecodeLimits
from sedimenta.errors import EngineError
from sedimenta.functions.hashing import blake3
from sedimenta.operators import catalog, codecs, grouping, integrity, sections
from sedimenta.operators.ordered import ordered
from sedimenta.staging import stage

TABLES = ("entries", "groups", "restore_map", "codecs", "payload")
#: What a row of each table is known by, and rows whose hashes are hashed together.
_IDS = {"entries": "entry_id", "groups": "group_id", "restore_map": "entry_id", "codecs": "chain_id", "payload": "group_id"}
_FAN = 4096
VERSION = 1


def pack_tables(files: DataFrame, profile: str, identity: str | None = None, kind: str | None = None) -> dict[str, DataFrame]:
    """The tables of an archive from files (path, size, modified_ns, mode, data), or from a tree whose rows have a `kind`.

    Bytes are written once as they come, and entries are ordered without them; then they are shuffled to their entries, and
    once more to the groups that hold several. The best of the profile's
    codecs is kept for each. A path that occurs twice fails. Group ids, offsets and entry ids come from total orders, so
    the result doesn't depend on partitions.
    """
    if profile not in GROUP_TARGETS:
        raise EngineError("unsupported_codec", profile)
    held = stage(files.withColumn("__file", F.monotonically_increasing_id()))
    made = stage(catalog.entries(held.drop("data"), identity, kind))
    catalog.require_empty(catalog.check_unique_paths(made), "duplicate_path")
    owners = made.where("kind = 'file'")
    placed = grouping.grouped(owners.select("entry_id", "size"), profile)
    placed = stage(placed.select("entry_id", "size", "group_id", "group_offset"))
    blobs = placed.join(owners.select("entry_id", "__file"), "entry_id").join(held.select("__file", F.col("data").cast("binary").alias("data")), "__file")
    alone = blobs.select("group_id", F.coalesce("data", F.to_binary(F.lit(""), F.lit("utf-8"))).alias("data"))
    encoded = stage(codecs.encoded(codecs.group_bytes(blobs) if GROUP_TARGETS[profile] else alone, profile))
    hashed = codecs.hashed(held.select("__file", "data"), ["__file"], "data").select("__file", "blake3")
    hashed = owners.select("entry_id", "__file").join(hashed, "__file").select("entry_id", "blake3")
    owner = F.coalesce("target_entry_id", "entry_id")
    told = made.drop("__file").withColumn("owner_id", owner).join(hashed.select(F.col("entry_id").alias("owner_id"), "blake3"), "owner_id", "left")
    told = told.join(placed.select(F.col("entry_id").alias("owner_id"), F.col("group_id").alias("g")), "owner_id", "left").withColumn("group_id", F.when(F.col("kind") == "file", F.col("g"))).drop("owner_id", "g")
    numbers = encoded.join(placed.groupBy("group_id").agg(F.count("*").alias("chunk_count")), "group_id")
    chain = F.lit(0) if profile == "raw" else F.col("codec_id") + 1
    table = ordered(numbers.drop("payload"), ["group_id"], sums={"payload_offset": "compressed_len"})
    groups = table.select("group_id", chain.cast("long").alias("codec_chain_id"), "codec", "chunk_count", "uncompressed_len", "compressed_len", "payload_crc32c", "payload_offset")
    registry = grouping.registry(encoded) if profile != "raw" else grouping.registry(encoded).where(F.lit(False))
    return {"entries": told, "groups": groups, "restore_map": grouping.restore_map(placed), "codecs": registry, "payload": encoded.select("group_id", "payload")}


def _folded(hashes: DataFrame) -> str:
    """One hash of hashes (id, blake3): those of 4,096 ids in a row are hashed together until one is left. No task sees more."""
    level = stage(hashes.select(F.col("id").cast("long").alias("id"), "blake3"))
    while True:
        joined = F.expr("listagg(blake3) WITHIN GROUP (ORDER BY id, blake3)")
        level = stage(sections.digests(level.groupBy(F.floor(F.col("id") / _FAN).alias("id")).agg(joined.alias("data")), ["id"]).select("id", "blake3"))
        rows = level.limit(2).collect()
        if len(rows) < 2:
            return bytes(rows[0]["blake3"]).hex() if rows else ""


def root(tables: dict[str, DataFrame]) -> str:
    """A hash of all rows and payloads, whatever their order and partitions."""
    parts = []
    for name in TABLES:
        df, key = tables[name], _IDS[name]
        data = F.col("payload") if name == "payload" else F.encode(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), "UTF-8")
        parts.append(f"{name}:{_folded(sections.digests(df.select(F.col(key).cast('long').alias('id'), data.alias('data')), ['id']))}")
    return blake3("\n".join(parts).encode()).hex()


def header(tables: dict[str, DataFrame]) -> dict:
    """What the manifest tells of an archive: its version, the rows of each table, the original bytes and the root hash."""
    counts = {n: tables[n].count() for n in TABLES}
    return {"version": VERSION, "rows": counts, "original_bytes": integrity.original_bytes(tables["entries"]).first()[0], "root": root(tables)}


def publish(tables: dict[str, DataFrame], path: str) -> None:
    """Writes each table into a folder that doesn't exist yet, and the manifest last: without it there's no archive.

    The manifest's root hash is of the rows as they are read back.
    """
    spark = next(iter(tables.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise EngineError("output_exists", path)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    at = jvm.org.apache.hadoop.fs.Path(staging)
    try:
        for name in TABLES:
            df = tables[name]
            writer = df.repartitionByRange("group_id").sortWithinPartitions("group_id") if name == "payload" else df
            writer.write.parquet(f"{staging}/{name}")
        told = header({n: spark.read.schema(tables[n].schema).parquet(f"{staging}/{n}") for n in TABLES})
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{staging}/_MANIFEST"))
        out.write(bytearray(json.dumps(told, sort_keys=True).encode()))
        out.close()
        if not fs.rename(at, target):
            raise EngineError("output_exists", path)
    except BaseException:
        fs.delete(at, True)
        raise


def open_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a published archive; payloads are read only where a query needs them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_MANIFEST")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise EngineError("missing_section", "manifest")
    return {n: spark.read.parquet(f"{path}/{n}") for n in TABLES}


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a published archive; an unknown version fails."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_MANIFEST")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise EngineError("missing_section", "manifest")
    read = fs.open(at)
    try:
        told = json.loads(jvm.org.apache.commons.io.IOUtils.toString(read, "UTF-8"))
    finally:
        read.close()
    if told.get("version") != VERSION:
        raise EngineError("unsupported_container_version", str(told.get("version")))
    return told


def verify_published(spark: SparkSession, path: str, limits: DecodeLimits = DecodeLimits()) -> DataFrame:
    """`verify`, and before it the manifest: its limits, the rows of each table, the original bytes and the root hash.

    Those problems have no id.
    """
    told, tables = manifest(spark, path), open_archive(spark, path)
    sizes = {**{n: told["rows"][n] for n in ("entries", "groups")}, "original_bytes": told["original_bytes"]}
    found = [f"limit: {n}" for n in integrity.limit_problems(sizes, limits)]
    found += [f"rows: {r['name']}" for r in integrity.table_counts(told["rows"], tables).where("NOT agree").collect()]
    if integrity.original_bytes(tables["entries"]).first()[0] != told["original_bytes"]:
        found.append("original bytes")
    if root(tables) != told["root"]:
        found.append("root hash")
    return spark.createDataFrame([(None, p) for p in found], "id long, problem string").unionByName(verify(tables, limits))


def encoded_groups(archive: dict[str, DataFrame]) -> DataFrame:
    return archive["groups"].join(archive["payload"], "group_id")


def verify(archive: dict[str, DataFrame], limits: DecodeLimits = DecodeLimits()) -> DataFrame:
    """Everything that is wrong (id, problem): tables against each other, then each group's checksum and decode,
    then each file's hash. A damaged payload fails in the decode itself.
    """
    entries, groups, restore = archive["entries"], archive["groups"], archive["restore_map"]
    entries = entries if "digest" in entries.columns else entries.withColumn("digest", F.col("blake3"))
    chains = archive["codecs"].select("chain_id").unionByName(entries.sparkSession.createDataFrame([(0,)], "chain_id int"))
    found = integrity.entry_problems(entries, groups, limits).unionByName(integrity.restore_problems(entries, restore))
    found = found.unionByName(integrity.group_problems(groups, chains, limits))
    if "target" in entries.columns:
        found = found.unionByName(integrity.symlink_problems(entries.where("kind = 'symlink'")))
    checks = integrity.member_checks(groups, restore).where("NOT contiguous").select(F.col("group_id").alias("id"), F.lit("members").alias("problem"))
    content = codecs.members(encoded_groups(archive), restore)
    return found.unionByName(checks).unionByName(integrity.hash_problems(entries.where("kind = 'file'"), content))


def extract(archive: dict[str, DataFrame], wanted: Column) -> DataFrame:
    """entry_id, path, content, blake3 of the chosen entries; only their groups are read and decoded.

    Content whose hash isn't the entry's fails: a wrong place never hands out other bytes.
    """
    chosen = catalog.resolved(archive["entries"].where(wanted)).where(F.col("kind").isin("file", "hardlink")).select("entry_id", "path", "owner_id", F.col("blake3").alias("__entry"))
    places = archive["restore_map"].withColumnRenamed("entry_id", "owner_id").join(chosen.select("owner_id").distinct(), "owner_id")
    needed = places.select("group_id").distinct()
    groups = archive["groups"].join(needed, "group_id", "left_semi").join(archive["payload"], "group_id")
    content = codecs.members(groups, places.withColumnRenamed("owner_id", "entry_id")).select(F.col("entry_id").alias("owner_id"), "content", "blake3")
    wrong = F.raise_error(F.concat(F.lit("checksum_mismatch: entry "), F.col("entry_id").cast("string")))
    whole = F.when(F.col("blake3").eqNullSafe(F.col("__entry")), F.col("content")).otherwise(wrong)
    return chosen.join(content, "owner_id").select("entry_id", "path", whole.alias("content"), "blake3")


def read_range(archive: dict[str, DataFrame], wanted: Column, offset: int, length: int) -> DataFrame:
    """entry_id, path and slice of the chosen entries: each whole entry is verified first; a slice beyond the end fails."""
    return catalog.read_range(extract(archive, wanted), offset, length).select("entry_id", "path", "slice", "digest")


def write_entry(archive: dict[str, DataFrame], wanted: Column, out: BinaryIO) -> int:
    """Writes the one chosen entry to a binary file, after it has been verified; returns its length. None or several fail."""
    rows = extract(archive, wanted).limit(2).collect()
    if len(rows) != 1:
        raise EngineError("entry_not_found" if not rows else "invalid_metadata", "one entry must be chosen")
    return out.write(bytes(rows[0]["content"]))
