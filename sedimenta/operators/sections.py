"""Sections of an archive: a directory of places and checksums, checked reads, and rows of JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.config import DecodeLimits
from sedimenta.errors import EngineError
from sedimenta.functions.hashing import blake3_many, crc32c
from sedimenta.functions.records import HEADER, SECTION, SECTIONS, encoded
from sedimenta.operators.ordered import ordered


def digests(blobs: DataFrame, keep: list[str], data: str = "data") -> DataFrame:
    """`keep`, and length, crc32c and blake3 of each row's bytes; null bytes count as none."""
    kept = ", ".join(f"`{c}` {blobs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [b or b"" for b in batch.column(len(keep)).to_pylist()]
            made = [pa.array([len(b) for b in held], pa.int64()), pa.array([crc32c(b) for b in held], pa.int64()), pa.array(blake3_many(held), pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, "length", "crc32c", "blake3"])

    return blobs.select(*keep, F.col(data).cast("binary").alias(data)).mapInArrow(run, f"{kept}, length long, crc32c long, blake3 binary")


def ranges(blobs: DataFrame, keep: list[str], offset: Column, length: Column, data: str = "data") -> DataFrame:
    """`digests` of a range of each row's bytes; one that ends beyond them fails."""
    inside = (offset >= 0) & (length >= 0) & (offset + length <= F.octet_length(data))
    piece = F.when(inside, F.substring(F.col(data), (offset + 1).cast("int"), length.cast("int"))).otherwise(F.raise_error(F.lit("invalid_range: range of bytes")))
    return digests(blobs.select(*keep, piece.alias(data)), keep, data)


def directory(bodies: DataFrame) -> DataFrame:
    """A row for each section (section_type, data): its place after the header and the directory, its length and
    checksum, and its record. A type that occurs twice or isn't known fails. There are few sections.
    """
    if bad := bodies.groupBy("section_type").agg(F.count("*").alias("n")).where((F.col("n") > 1) | ~F.col("section_type").isin(*SECTIONS.values())).limit(1).collect():
        raise EngineError("duplicate_section" if bad[0]["n"] > 1 else "invalid_metadata", f"section {bad[0]['section_type']}")
    sums = digests(bodies, ["section_type"]).select("section_type", "length", "crc32c")
    laid = ordered(sums, ["section_type"], sums={"__before": "length"})
    start = F.lit(HEADER.size) + SECTION.size * F.lit(sums.count())
    placed = laid.withColumn("offset", (start + F.col("__before")).cast("long")).drop("__before")
    numbers = {"section_version": F.lit(1), "flags": F.lit(0), "reserved": F.lit(0)}
    return placed.withColumn("record", encoded(SECTION, {**numbers, **{n: F.col(n) for n in ("section_type", "offset", "length", "crc32c")}}))


def checked(bodies: DataFrame, places: DataFrame, limits: DecodeLimits = DecodeLimits()) -> DataFrame:
    """section_type and data of each section in the directory; a missing one, one over the limit and one whose
    length or checksum isn't the directory's fail.
    """
    seen = digests(bodies, ["section_type"]).select("section_type", F.col("length").alias("__length"), F.col("crc32c").alias("__crc"))
    met = places.select("section_type", "length", "crc32c").join(seen, "section_type", "left").join(bodies.select("section_type", "data"), "section_type", "left")
    say = lambda name: F.raise_error(F.concat(F.lit(f"{name}: section "), F.col("section_type").cast("string")))
    data = (
        F.when(F.col("__length").isNull(), say("missing_section"))
        .when(F.col("length") > limits.metadata_bytes, say("resource_limit"))
        .when((F.col("__length") != F.col("length")) | (F.col("__crc") != F.col("crc32c")), say("checksum_mismatch"))
        .otherwise(F.col("data"))
    )
    return met.select("section_type", data.alias("data"))


def json_rows(sections: DataFrame, section_type: int, schema: str) -> DataFrame:
    """The rows of a section that holds a JSON array of objects; malformed ones and other types fail."""
    text = F.col("data").cast("string")
    parsed = F.from_json(text, f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    return sections.where(F.col("section_type") == section_type).select(F.explode(parsed).alias("r")).select("r.*")


def json_body(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row with the table as a JSON array of objects in order: for tables within the limit of metadata."""
    made = rows.select(F.struct(*order).alias("o"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "j"))), lambda x: x["j"])
    return made.agg(F.encode(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), "UTF-8").alias("data"))
