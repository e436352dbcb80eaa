"""Chunk fingerprints, escalation of collisions, and similarity candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.config import KIB, Fingerprinting
from sedimenta.errors import EngineError
from sedimenta.functions.hashing import blake3_many, crc32c, xxh3
from sedimenta.functions.kernels import superfeatures
from sedimenta.operators.components import components
from sedimenta.staging import stage

SCHEMA = "chunk_id long, length long, xxh3 long, blake3_128 binary, full_blake3 binary, crc32c long, superfeatures array<long>"


def computed(chunks: DataFrame, config: Fingerprinting = Fingerprinting(), data: str = "data") -> DataFrame:
    """One pass over the bytes of each chunk (chunk_id, data, optionally length): all hashes and features.

    full_blake3 is complete here; `escalated` keeps it only where it is needed. A length
    that differs from the bytes fails, as do a chunk over the configured size and one without bytes; an
    empty chunk has some: none. Ids that occur twice are `batch`'s to refuse.
    """
    length = F.col("length").cast("long") if "length" in chunks.columns else F.octet_length(F.col(data)).cast("long")
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), length.alias("length"), F.col(data).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            blobs = batch.column(2).to_pylist()
            if None in blobs:
                raise EngineError("invalid_metadata", f"chunk {batch.column(0)[blobs.index(None)].as_py()} has no bytes")
            for chunk, n, blob, full in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), blobs, blake3_many(blobs)):
                if n != len(blob):
                    raise EngineError("invalid_range", f"chunk {chunk}")
                if n > config.most_chunk_bytes:
                    raise EngineError("resource_limit", f"chunk {chunk}")
                made.append({"chunk_id": chunk, "length": n, "xxh3": xxh3(blob), "blake3_128": full[:16], "full_blake3": full, "crc32c": crc32c(blob), "superfeatures": superfeatures(blob, config)})
            yield pa.RecordBatch.from_pylist(made, schema=_ARROW)

    return rows.mapInArrow(run, SCHEMA)


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id of chunks that occur more than once."""
    return chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id")


#: Bytes beyond its own that each row, each region's rolling window and each worker may take.
_ROW_MARGIN, _WORKER_MARGIN = 64, 64 * KIB


def computed_pages(chunks: DataFrame, pages: DataFrame, config: Fingerprinting = Fingerprinting()) -> DataFrame:
    """`computed` for chunks (chunk_id, length) whose bytes come as pages (chunk_id, page, data) in order.

    Pages that hold less or more than the length fail, as do pages of a chunk that isn't listed. A task holds one
    chunk, and no more of it than its length: a chunk over the configured size fails at its first page.
    """
    told = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("length").cast("long").alias("length"))
    met = pages.select(F.col("chunk_id").cast("long").alias("chunk_id"), "page", F.col("data").cast("binary").alias("data")).join(told, "chunk_id", "full")
    schema = pa.schema([("chunk_id", pa.int64()), ("length", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, parts, held = None, 0, [], 0

        def whole() -> pa.RecordBatch:
            if held < size:
                raise EngineError("invalid_metadata", f"chunk {now} is short")
            return pa.RecordBatch.from_pylist([{"chunk_id": now, "length": size, "data": b"".join(parts)}], schema=schema)

        for batch in batches:
            for chunk, blob, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if chunk != now:
                    if now is not None:
                        yield whole()
                    if length is None:
                        raise EngineError("invalid_metadata", f"chunk {chunk} isn't listed")
                    if length > config.most_chunk_bytes:
                        raise EngineError("resource_limit", f"chunk {chunk}")
                    now, size, parts, held = chunk, length, [], 0
                parts.append(blob or b"")
                held += len(parts[-1])
                if held > size:
                    raise EngineError("invalid_metadata", f"chunk {chunk} has trailing bytes")
        if now is not None:
            yield whole()

    rows = met.repartition("chunk_id").sortWithinPartitions("chunk_id", "page").select("chunk_id", "data", "length")
    return computed(rows.mapInArrow(run, "chunk_id long, length long, data binary"), config)


def working_set(chunks: DataFrame, config: Fingerprinting = Fingerprinting()) -> DataFrame:
    """Bytes that a batch holds at most: those of the largest chunks that workers have at once."""
    top = chunks.select("length").orderBy(F.desc("length")).limit(config.parallelism)
    return top.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("held_bytes"))


def batch_budget(chunks: DataFrame, config: Fingerprinting = Fingerprinting(), most_bytes: int | None = None) -> DataFrame:
    """Bytes that chunks (length) take if a batch holds them all: rows of results, and for each worker the largest
    chunk and its rolling windows; more than `most_bytes` fail.
    """
    row = 8 + 8 + 8 + 16 + 32 + 8 + 8 * config.groups + _ROW_MARGIN
    rows, largest = F.count("*"), F.coalesce(F.max("length"), F.lit(0))
    windows = F.least(F.lit(config.subchunks * config.window), largest) + config.subchunks * (16 + _ROW_MARGIN)
    held = rows * row + F.least(rows, F.lit(config.parallelism)) * (largest + windows + _WORKER_MARGIN)
    out = chunks.agg(rows.alias("chunks"), held.cast("long").alias("held_bytes"))
    return out if most_bytes is None else out.where(F.assert_true(F.col("held_bytes") <= most_bytes, F.lit("resource_limit: working set")).isNull())


def batch(chunks: DataFrame, config: Fingerprinting = Fingerprinting(), data: str = "data") -> DataFrame:
    """`computed` and `escalated` for a whole batch of chunks; ids that occur more than once fail."""
    if bad := duplicate_ids(chunks).limit(1).collect():
        raise EngineError("invalid_metadata", f"chunk {bad[0]['chunk_id']} occurs more than once")
    return escalated(stage(computed(chunks, config, data)), config)


_ARROW = pa.schema([("chunk_id", pa.int64()), ("length", pa.int64()), ("xxh3", pa.int64()), ("blake3_128", pa.binary()), ("full_blake3", pa.binary()), ("crc32c", pa.int64()), ("superfeatures", pa.list_(pa.int64()))])


def escalated(prints: DataFrame, config: Fingerprinting = Fingerprinting()) -> DataFrame:
    """Keeps the full hash only of chunks whose (xxh3, length, blake3_128) occurs more than once.

    Under the paranoid policy all keep it. The count is combined before the shuffle and
    joined back, so that a very common chunk is no window over its copies.
    """
    if config.policy == "paranoid":
        return prints
    key = ["xxh3", "length", "blake3_128"]
    shared = prints.groupBy(*key).agg(F.count("*").alias("__n")).where("__n > 1")
    met = prints.join(shared, key, "left")
    return met.withColumn("full_blake3", F.when(F.col("__n").isNotNull(), F.col("full_blake3"))).select(*prints.columns)


def mismatches(prints: DataFrame, chunks: DataFrame, data: str = "data") -> DataFrame:
    """Chunks whose recomputed length, hashes or checksum differ from the recorded ones; promotion needs none."""
    again = computed(chunks, data=data).select("chunk_id", F.struct("length", "xxh3", "blake3_128", "crc32c").alias("now"))
    then = prints.select("chunk_id", F.struct("length", "xxh3", "blake3_128", "crc32c").alias("then"))
    return then.join(again, "chunk_id", "full").where(~F.col("now").eqNullSafe(F.col("then"))).select("chunk_id")


def similar(prints: DataFrame, at_least: int = 1) -> DataFrame:
    """chunk_id, class_id and links for each chunk with superfeatures: an extension, candidates for a comparison of bytes.

    Two chunks are linked if they share at least so many superfeatures in the same places. links is the number of a chunk's
    partners, exact copies included, and class_id the smallest chunk it reaches; chunks with equal features share a class
    even if they are too few to link. Pairs are never listed: chunks that agree
    on a choice of places are counted by that choice, and partners follow from the counts of choices of all sizes, as each
    pair is counted once in every choice of the places it shares. So the work grows with the chunks, however many share a feature.
    """
    held = prints.where(F.size("superfeatures") > 0)
    reps = stage(held.groupBy("superfeatures").agg(F.min("chunk_id").alias("rep"), F.count("*").alias("copies")))
    most = reps.agg(F.max(F.size("superfeatures"))).first()[0] or 0
    choices = [c for n in range(at_least, most + 1) for c in combinations(range(most), n)]
    if not choices:
        return held.select("chunk_id", F.col("chunk_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    # how often pairs that share n places and at least `at_least` are counted too often by the smaller choices
    sign = [(-1) ** (len(c) - at_least) * comb(len(c) - 1, at_least - 1) for c in choices]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(s).alias("sign"), F.array(*(F.get("superfeatures", F.lit(p)) for p in c)).alias("values")) for i, (c, s) in enumerate(zip(choices, sign))])
    each = reps.select("rep", "copies", F.inline(keys)).where(~F.exists("values", F.isnull)).withColumn("key", F.struct("choice", "values"))
    shared = stage(each.groupBy("key").agg(F.sum("copies").alias("n"), F.min("rep").alias("first")))
    met = each.join(shared.where("n > 1"), "key")
    counted = met.groupBy("rep").agg(F.sum(F.col("sign") * (F.col("n") - 1)).cast("long").alias("links"))
    smallest = [i for i, c in enumerate(choices) if len(c) == at_least]
    roots = components(met.where(F.col("choice").isin(smallest)).select(F.col("rep").alias("a"), F.col("first").alias("b")))
    told = reps.join(counted, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = told.select("superfeatures", F.coalesce("root", "rep").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return held.select("chunk_id", "superfeatures").join(classes, "superfeatures").select("chunk_id", "class_id", "links")
