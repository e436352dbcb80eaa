"""Logical chunks: content-defined, fixed and structural ones, their checks and their ids."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.config import MIB, Chunking
from sedimenta.functions.kernels import cut_points
from sedimenta.operators.ordered import ordered
from sedimenta.staging import stage

DRAFT = "entry_id long, object_id long, logical_offset long, length long, method string"
_ORDER = ["entry_id", "object_id", "logical_offset"]


def content_defined(objects: DataFrame, config: Chunking = Chunking(), data: str = "data", method: str = "FastCdc") -> DataFrame:
    """Drafts of the content-defined chunks of each object (entry_id, object_id, data).

    Sequential inside an object, parallel across objects. An optional column `origin`
    is added to offsets.
    """
    origin = F.col("origin") if "origin" in objects.columns else F.lit(0).cast("long")
    rows = objects.select("entry_id", "object_id", origin.alias("origin"), F.col(data).cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for entry, obj, start, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                at = 0
                for end in cut_points(blob or b"", config):
                    made.append((entry, obj, start + at, end - at, method))
                    at = end
            cols = list(zip(*made)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=[*_ORDER, "length", "method"])

    return rows.mapInArrow(run, DRAFT)


def content_defined_pages(pages: DataFrame, config: Chunking = Chunking(), method: str = "FastCdc") -> DataFrame:
    """The same drafts from objects that come as pages (entry_id, object_id, page, data) in order.

    Pages of an object stream through one task, which holds at most one largest chunk more
    than a page. With a column `origin`, pages of an object that share it are cut from there.
    """
    origin = F.col("origin") if "origin" in pages.columns else F.lit(0).cast("long")
    keep = config.maximum

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tail, base = None, b"", 0
        made: list[tuple] = []

        def close() -> None:
            at = 0
            for end in cut_points(tail, config):
                made.append((*key[:2], base + at, end - at, method))
                at = end

        for batch in batches:
            for entry, obj, start, blob in zip(*(batch.column(n).to_pylist() for n in ("entry_id", "object_id", "origin", "data"))):
                if (entry, obj, start) != key:
                    if key is not None:
                        close()
                    key, tail, base = (entry, obj, start), b"", start
                tail += blob or b""
                at = 0
                # a chunk is final once a largest chunk's bytes lie beyond its start
                for end in cut_points(tail, config) if len(tail) > 2 * keep else ():
                    if len(tail) - at <= keep:
                        break
                    made.append((*key[:2], base + at, end - at, method))
                    at = end
                tail, base = tail[at:], base + at
            if made:
                yield _drafts(made)
                made = []
        if key is not None:
            close()
        if made:
            yield _drafts(made)

    keys = ["entry_id", "object_id", "origin"]
    rows = pages.select("entry_id", "object_id", origin.alias("origin"), "page", F.col("data").cast("binary").alias("data"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "page").mapInArrow(run, DRAFT)


def _drafts(made: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*made))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=[*_ORDER, "length", "method"])


def fixed(objects: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Drafts of fixed blocks of objects (entry_id, object_id, size) whose bytes don't compress; the last one is short, an empty object has none."""
    block = F.lit(config.fixed_block).cast("long")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, block))
    return objects.where("size > 0").select("entry_id", "object_id", "size", at.alias("logical_offset")).select(*_ORDER, F.least(block, F.col("size") - F.col("logical_offset")).alias("length"), F.lit("FixedHighEntropy").alias("method"))


def structural(regions: DataFrame, config: Chunking = Chunking(), data: str | None = None) -> DataFrame:
    """Drafts of regions (entry_id, object_id, start, end): one that isn't longer than the
    maximum stays whole, a longer one is cut by content from its start; it fails unless `data` names its bytes.
    """
    size = F.col("end") - F.col("start")
    short = regions if data else regions.where(F.assert_true(size <= config.maximum, F.lit("invalid_range: a region longer than the maximum needs its bytes")).isNull())
    kept = short.where((size > 0) & (size <= config.maximum)).select("entry_id", "object_id", F.col("start").alias("logical_offset"), (F.col("end") - F.col("start")).alias("length"), F.lit("Structural").alias("method"))
    if data is None:
        return kept
    long = regions.where(size > config.maximum)
    return kept.unionByName(content_defined(long.select("entry_id", "object_id", F.col("start").alias("origin"), data), config, data, "Structural"))


#: Bytes of an object within which pages and regions are matched.
_SPAN = 16 * MIB


def structural_pages(pages: DataFrame, ends: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """The drafts of `structural` from objects that come as pages (entry_id, object_id, page, data), with the
    ends of their regions (entry_id, object_id, ends).

    Pages that hold less or more than the last end fail, as do ends that don't rise from above 0. Only pages that
    meet a region longer than the maximum are moved; such a region streams through one task.
    """
    keys = ["entry_id", "object_id"]
    sizes = pages.select(*keys, "page", F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("__n"))
    places = stage(ordered(sizes, ["page"], sums={"__at": "__n"}, keys=keys))
    met = ends.select(*keys, "ends").join(places.groupBy(*keys).agg(F.sum("__n").alias("__held")), keys, "full")
    told = F.coalesce("ends", F.array().cast("array<long>"))
    want, held = F.coalesce(F.try_element_at(told, F.lit(-1)), F.lit(0)), F.coalesce("__held", F.lit(0))
    odd = boundary_problems(met.withColumn("ends", told).withColumn("size", want)).withColumn("__want", want).withColumn("__held", held)
    say = lambda what: F.raise_error(F.concat(F.lit(f"invalid_metadata: {what} of entry "), F.col("entry_id").cast("string")))
    whole = F.when(F.coalesce("problem", F.lit("empty")) != "empty", say("structural boundaries")).when(held < want, say("short pages")).when(held > want, say("trailing bytes")).otherwise(F.col("ends"))
    sound = odd.select(*keys, whole.alias("ends"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("ends"))
    region = F.inline(F.zip_with(F.slice(starts, 1, F.size("ends")), F.col("ends"), lambda a, b: F.struct(a.alias("start"), b.alias("end"))))
    regions = stage(sound.select(*keys, region))
    size = F.col("end") - F.col("start")
    spans = lambda a, b: F.explode(F.sequence(F.floor(a / _SPAN), F.floor((b - 1) / _SPAN)))
    long = regions.where(size > config.maximum).select(*keys, "start", "end", spans(F.col("start"), F.col("end")).alias("__span"))
    over = places.where("__n > 0").select(*keys, "page", "__at", "__n", spans(F.col("__at"), F.col("__at") + F.col("__n")).alias("__span"))
    lo, hi = F.greatest("__at", "start", F.col("__span") * _SPAN), F.least(F.col("__at") + F.col("__n"), F.col("end"), (F.col("__span") + 1) * _SPAN)
    pieces = over.join(long, [*keys, "__span"]).withColumn("__lo", lo).withColumn("__hi", hi).where("__lo < __hi").select(*keys, "page", "__at", "start", "__lo", "__hi")
    cut = F.substring("data", (F.col("__lo") - F.col("__at") + 1).cast("int"), (F.col("__hi") - F.col("__lo")).cast("int"))
    bytes_ = pages.select(*keys, "page", "data").join(pieces, [*keys, "page"]).select(*keys, F.col("start").alias("origin"), F.col("__lo").alias("page"), cut.alias("data"))
    return structural(regions.where(size <= config.maximum), config).unionByName(content_defined_pages(bytes_, config, "Structural"))


class Scanner(Protocol):
    """Finds the regions of one kind of content."""

    def probe(self, prefix: bytes) -> bool:
        """Whether content that begins like this is of the kind."""

    def ends(self, data: bytes) -> list[int]:
        """The ends of its regions: they rise, and the last one is the size."""


def scanned(objects: DataFrame, scanner: Scanner, prefix: int = 4096) -> DataFrame:
    """entry_id, object_id, size and ends of the objects (entry_id, object_id, data) that the scanner knows; check them with
    `boundary_problems`. Empty objects and null ones aren't scanned.
    """
    schema = pa.schema([("entry_id", pa.int64()), ("object_id", pa.int64()), ("size", pa.int64()), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
            made = [{"entry_id": e, "object_id": o, "size": len(d), "ends": scanner.ends(d)} for e, o, d in rows if d and scanner.probe(d[:prefix])]
            yield pa.RecordBatch.from_pylist(made, schema=schema)

    return objects.select("entry_id", "object_id", F.col("data").cast("binary").alias("data")).mapInArrow(run, "entry_id long, object_id long, size long, ends array<long>")


def boundary_problems(objects: DataFrame) -> DataFrame:
    """What is wrong with each object's list of ends (entry_id, object_id, size, ends); null if nothing is."""
    ends = F.col("ends")
    steps = F.zip_with(F.slice(ends, 2, F.size(ends)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), lambda b, a: b > a)
    problem = F.when(ends.isNull() | (F.size(ends) == 0), "empty").when(F.element_at(ends, 1) <= 0, "not positive").when(~F.forall(steps, lambda x: x), "not increasing").when(F.element_at(ends, -1) != F.col("size"), "not the size")
    return objects.withColumn("problem", problem)


def coverage(chunks: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each object whether its chunks cover it: from 0 to the size without gap, overlap or empty chunk.

    An empty object may have no chunk, or one empty micro-file.
    """
    w = Window.partitionBy("entry_id", "object_id").orderBy("logical_offset", "length")
    flags = chunks.withColumn("before", F.lag(F.col("logical_offset") + F.col("length"), 1, 0).over(w))
    empty_ok = (F.col("length") == 0) & (F.col("method") == "MicroFile")
    per = flags.groupBy("entry_id", "object_id").agg(
        F.count("*").alias("n"), F.sum("length").cast("long").alias("total"), F.count_if(F.col("logical_offset") != F.col("before")).alias("breaks"), F.count_if((F.col("length") <= 0) & ~empty_ok).alias("empties"), F.count_if(empty_ok).alias("empty_files")
    )
    met = sizes.select("entry_id", "object_id", "size").join(per, ["entry_id", "object_id"], "left")
    filled = (F.col("breaks") == 0) & (F.col("empties") == 0) & (F.col("total") == F.col("size"))
    fine = F.when(F.col("n").isNull(), F.col("size") == 0).when(F.col("empty_files") > 0, (F.col("n") == 1) & (F.col("size") == 0)).otherwise(filled)
    return met.select("entry_id", "object_id", F.coalesce("n", F.lit(0)).alias("chunks"), fine.alias("covered"))


def with_ids(drafts: DataFrame) -> DataFrame:
    """Dense chunk ids in the order of (entry_id, object_id, logical_offset)."""
    return ordered(drafts, _ORDER, number="chunk_id")


def id_violations(drafts: DataFrame) -> DataFrame:
    """Places that two drafts share, and empty chunks that aren't micro-files."""
    twice = drafts.groupBy(*_ORDER).agg(F.count("*").alias("n")).where("n > 1").select(*_ORDER, F.lit("duplicate").alias("problem"))
    empty = drafts.where("length <= 0 AND method <> 'MicroFile'").select(*_ORDER, F.lit("empty").alias("problem"))
    return twice.unionByName(empty)


def limits(chunks: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """Counts and bytes; more than allowed is a resource limit."""
    out = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))
    return out.where(F.assert_true((F.col("chunks") <= config.most_chunks) & (F.col("bytes") <= config.most_bytes), F.lit("resource_limit")).isNull())
