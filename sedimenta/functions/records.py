"""The archive format's fixed records as columns: little-endian fields at fixed places, some under a checksum."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.functions.hashing import _CRC0
from sedimenta.functions.paths import little_endian_hex


@dataclass(frozen=True)
class Field:
    """A number of 1 to 8 bytes, or with `raw` that many bytes as they are; without a name they are zeros."""

    name: str
    width: int
    raw: bool = False
    signed: bool = False


@dataclass(frozen=True)
class Layout:
    """Fields in order after the magic bytes. The field `crc` is the CRC-32C of all bytes but its own."""

    magic: bytes
    fields: tuple[Field, ...]
    crc: str = ""

    def places(self) -> list[tuple[Field, int]]:
        """Each field and where it begins."""
        at, out = len(self.magic), []
        for f in self.fields:
            out.append((f, at))
            at += f.width
        return out

    @property
    def size(self) -> int:
        return len(self.magic) + sum(f.width for f in self.fields)


def _numbers(**widths: int) -> tuple[Field, ...]:
    return tuple(Field(n, w) for n, w in widths.items())


#: The records' magic bytes, and their fields with widths in bytes.
HEADER = Layout(
    b"UDOC\r\n\x1a\n",
    (*_numbers(major=2, minor=2, header_len=4, flags=8), Field("archive_id", 16, raw=True), *_numbers(original_total_size=8, entry_count=8, logical_chunk_count=8, group_count=8, section_directory_offset=8, footer_offset=8, crc32c=4, section_count=4)),
    "crc32c",
)
SECTION = Layout(b"", _numbers(section_type=2, section_version=2, flags=4, offset=8, length=8, crc32c=4, reserved=4))
CODEC = Layout(b"", (*_numbers(chain_id=4, codec_id=2, codec_version=2), Field("level", 4, signed=True), *_numbers(flags=4)))
GROUP = Layout(b"UGRP", _numbers(version=2, flags=2, group_id=8, codec_chain_id=4, chunk_count=4, uncompressed_len=8, compressed_len=8, descriptor_len=4, payload_crc32c=4))
FOOTER = Layout(b"UFTR", (*_numbers(archive_length=8), Field("blake3_root", 32, raw=True), *_numbers(directory_crc32c=4, version=4), Field("", 4), *_numbers(crc32c=4), Field("", 4)), "crc32c")
#: Section types, and the version of the container.
SECTIONS = {"codec_registry": 1, "entry_table": 2, "object_graph": 3, "base_dictionary_area": 4, "group_table": 5, "payload_area": 6, "restore_map": 7, "central_index": 8, "integrity_tree": 9, "optional_telemetry": 10}
MAJOR, MINOR = 0, 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it's used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hex(field: Field, value: Column) -> Column:
    """The field's hex digits; a number that doesn't fit fails. Eight bytes are a long's bit pattern."""
    if not field.name:
        return F.lit("00" * field.width)
    if field.raw:
        fits = F.octet_length(value) == field.width
        return F.when(fits, F.hex(value)).otherwise(F.raise_error(F.lit(f"invalid_range: {field.name}")))
    digits = F.substring(little_endian_hex(value), 1, 2 * field.width)
    if field.width == 8:
        return digits
    span = 1 << 8 * field.width
    least = -span // 2 if field.signed else 0
    number = value.cast("long")
    return F.when((number >= least) & (number < least + span), digits).otherwise(F.raise_error(F.lit(f"integer_overflow: {field.name}")))


def encoded(layout: Layout, values: dict[str, Column]) -> Column:
    """The record as bytes. `values` names each field but the checksum; null if any value is null."""
    parts = [F.lit(layout.magic.hex().upper())]  # then the part of field i is parts[i + 1]
    parts += [F.lit("{crc}") if f.name == layout.crc != "" else _hex(f, values[f.name] if f.name else F.lit(0)) for f in layout.fields]
    if not layout.crc:
        return F.unhex(F.concat(*parts))
    at = next(i for i, f in enumerate(layout.fields, 1) if f.name == layout.crc)
    before = 2 * sum(f.width for f in layout.fields[: at - 1]) + 2 * len(layout.magic)
    crc = lambda rest: F.substring(little_endian_hex(crc32c(rest, layout.size - 4)), 1, 8)
    whole = lambda rest: F.concat(F.substring(rest, 1, before), crc(rest), F.substring(rest, before + 1, 2 * layout.size))
    return F.unhex(_let(F.concat(*parts[:at], *parts[at + 1 :]), whole))


def decoded(layout: Layout, record: Column) -> Column:
    """A struct of the record's fields. Another length, other magic bytes or a wrong checksum fail; null stays null."""
    return _let(F.hex(record), lambda digits: F.when(digits.isNotNull(), _decoded(layout, digits)))


def _decoded(layout: Layout, digits: Column) -> Column:
    got = {}
    for f, at in layout.places():
        if f.name:
            piece = F.substring(digits, 2 * at + 1, 2 * f.width)
            got[f.name] = F.unhex(piece) if f.raw else _number(piece, f)
    fail = lambda name: F.raise_error(F.lit(f"{name}: record"))
    out = F.struct(*[c.alias(n) for n, c in got.items()])
    if layout.crc:
        at = next(a for f, a in layout.places() if f.name == layout.crc)
        rest = F.concat(F.substring(digits, 1, 2 * at), F.substring(digits, 2 * at + 9, 2 * layout.size))
        out = F.when(crc32c(rest, layout.size - 4) == got[layout.crc], out).otherwise(fail("checksum_mismatch"))
    out = F.when(F.substring(digits, 1, 2 * len(layout.magic)) == layout.magic.hex().upper(), out).otherwise(fail("invalid_magic"))
    return F.when(F.length(digits) == 2 * layout.size, out).otherwise(fail("invalid_range"))


def _number(digits: Column, field: Field) -> Column:
    turned = F.concat(*[F.substring(digits, 2 * k - 1, 2) for k in range(field.width, 0, -1)])
    n = F.conv(turned, 16, -10).cast("long")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n) if field.signed else n


def crc32c(digits: Column, size: int) -> Column:
    """CRC-32C of `size` bytes given as hex digits, a byte at a time: for short records, not for contents."""
    table = F.array(*[F.lit(x).cast("long") for x in _CRC0])
    ones = F.lit(0xFFFFFFFF).cast("long")
    byte = lambda held, k: F.conv(F.substring(held, 2 * k + 1, F.lit(2)), 16, 10).cast("long")
    next_ = lambda crc, b: F.element_at(table, (crc.bitwiseXOR(b).bitwiseAND(F.lit(255)) + 1).cast("int")).bitwiseXOR(F.shiftright(crc, 8))
    fold = lambda held: F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), ones, lambda crc, k: next_(crc, byte(held, k)), lambda crc: crc.bitwiseXOR(ones))
    return _let(digits, fold)
