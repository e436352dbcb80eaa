"""Encoding of solid groups with each candidate, choice by cost, and bounded decoding."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.config import CANDIDATES, CODECS, COST_CODEC, COST_GROUP, COST_INDEX, COST_INTEGRITY, COST_PADDING
from sedimenta.errors import EngineError
from sedimenta.functions import codecs
from sedimenta.functions.hashing import blake3, blake3_many, crc32c_many

_EXTRA = COST_CODEC + COST_GROUP + COST_INDEX + COST_INTEGRITY + COST_PADDING
ENCODED = "group_id long, codec string, codec_id int, uncompressed_len long, compressed_len long, payload_crc32c long, total_cost long, payload binary"


def group_bytes(placed: DataFrame, data: str = "data") -> DataFrame:
    """group_id and the bytes of its members in order. A group has its target's bytes at most, or one file."""
    rows = placed.select("group_id", "group_offset", "entry_id", F.col(data).cast("binary").alias("data"))
    joined = F.expr("listagg(data) WITHIN GROUP (ORDER BY group_offset, entry_id)")
    return rows.groupBy("group_id").agg(F.coalesce(joined, F.to_binary(F.lit(""), F.lit("utf-8"))).alias("data"))


def tried(groups: DataFrame, profile: str) -> DataFrame:
    """A row for each group and candidate codec, without payloads: what each would cost."""
    return _encoded(groups, profile, every=True).drop("payload")


def encoded(groups: DataFrame, profile: str) -> DataFrame:
    """The cheapest encoding of each group; a tie goes to the lower codec id. Of a group only the best payload so far is held."""
    return _encoded(groups, profile, every=False)


def _encoded(groups: DataFrame, profile: str, every: bool) -> DataFrame:
    names = CANDIDATES[profile]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _parts(pc.binary_length(batch.column(1)).to_pylist(), SLICED_BYTES):
                made = []
                for group, data in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()):
                    tries = ((group, name, CODECS[name], len(data), codecs.encode(name, data)) for name in names)
                    made += tries if every else [min(tries, key=lambda t: (len(t[4]), t[2]))]
                group_ids, used, ids, lengths, payloads = map(list, zip(*made))
                sizes = [len(p) for p in payloads]
                columns = [group_ids, used, ids, lengths, sizes, crc32c_many(payloads), [n + _EXTRA for n in sizes], [b""] * len(made) if every else payloads]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return groups.select("group_id", F.col("data").cast("binary").alias("data")).mapInArrow(run, ENCODED)


_ARROW = pa.schema([("group_id", pa.int64()), ("codec", pa.string()), ("codec_id", pa.int32()), ("uncompressed_len", pa.int64()), ("compressed_len", pa.int64()), ("payload_crc32c", pa.int64()), ("total_cost", pa.int64()), ("payload", pa.binary())])


def chosen(costs: DataFrame) -> DataFrame:
    """The cheapest candidate of each group from a table of costs."""
    best = costs.groupBy("group_id").agg(F.min_by(F.struct("codec", "codec_id", "compressed_len", "total_cost"), F.struct("total_cost", "codec_id")).alias("b"))
    return best.select("group_id", "b.*")


#: Bytes of payloads that are checked together, and of members that leave the decoder together.
SLICED_BYTES = 8 << 20


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[dict, bytes]]:
    """Encoded groups and their bytes: their checksums, then a decode of each that is bounded by the declared length."""
    for a, b in _parts(pc.binary_length(batch.column("payload")).to_pylist(), SLICED_BYTES):
        groups = batch.slice(a, b - a).to_pylist()
        for g, crc in zip(groups, crc32c_many([g["payload"] for g in groups])):
            if crc != g["payload_crc32c"]:
                raise EngineError("checksum_mismatch", f"group {g['group_id']}")
        for g in groups:
            yield g, codecs.decode(g["codec"], g["payload"], g["uncompressed_len"])


_GROUP = ("group_id", "codec", "uncompressed_len", "payload_crc32c", "payload")


def decoded(groups: DataFrame) -> DataFrame:
    """group_id and data of encoded groups (group_id, codec, uncompressed_len, payload_crc32c, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, data in _opened(batch):
                yield pa.RecordBatch.from_pylist([{"group_id": g["group_id"], "data": data}], schema=pa.schema([("group_id", pa.int64()), ("data", pa.binary())]))

    return groups.select(*_GROUP).mapInArrow(run, "group_id long, data binary")


def members(groups: DataFrame, restore: DataFrame) -> DataFrame:
    """entry_id, content and blake3 of each member, from groups that are decoded once each.

    Lists of places meet encoded groups, and members are cut and hashed where a group is decoded; so decoded bytes
    aren't shuffled. Those of many small groups are hashed together. Members without bytes need no group.
    """
    places = restore.select("entry_id", "group_id", "group_offset", "length")
    listed = places.where("length > 0").groupBy("group_id").agg(F.collect_list(F.struct("entry_id", "group_offset", "length")).alias("places"))
    met = groups.select(*_GROUP).join(listed, "group_id")
    schema = pa.schema([("entry_id", pa.int64()), ("content", pa.binary()), ("blake3", pa.binary())])

    def told(ids: list[int], cut: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cut, pa.binary()), pa.array(blake3_many(cut), pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, cut, held = [], [], 0
        for g, data in (x for batch in batches for x in _opened(batch)):
            for p in g["places"]:
                if p["group_offset"] < 0 or p["group_offset"] + p["length"] > len(data):
                    raise EngineError("invalid_range", f"entry {p['entry_id']}")
                if cut and held + p["length"] > SLICED_BYTES:
                    yield told(ids, cut)
                    ids, cut, held = [], [], 0
                ids.append(p["entry_id"])
                cut.append(data[p["group_offset"] : p["group_offset"] + p["length"]])
                held += p["length"]
        if cut:
            yield told(ids, cut)

    whole = met.mapInArrow(run, "entry_id long, content binary, blake3 binary")
    nothing = F.to_binary(F.lit(""), F.lit("utf-8"))
    empty = places.where("length = 0").join(groups.select("group_id"), "group_id", "left_semi").select("entry_id", nothing.alias("content"), F.lit(blake3(b"")).alias("blake3"))
    return whole.unionByName(empty)


def _parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges whose sizes add up to about `most`."""
    at, total = 0, 0
    for k, n in enumerate(sizes):
        if k > at and total + n > most:
            yield at, k
            at, total = k, 0
        total += n
    if sizes:
        yield at, len(sizes)


def hashed(rows: DataFrame, keep: list[str], data: str, name: str = "blake3") -> DataFrame:
    """`keep`, the bytes and their BLAKE3 hash."""
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(len(keep)).to_pylist()
            made = blake3_many([b or b"" for b in blobs])
            hashes = pa.array([None if b is None else h for b, h in zip(blobs, made)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], names=[*keep, data, name])

    return rows.select(*keep, F.col(data).cast("binary").alias(data)).mapInArrow(run, f"{kept}, `{data}` binary, `{name}` binary")
