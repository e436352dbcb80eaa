"""The four codecs, deterministic at fixed levels, with bounded decoding."""

from __future__ import annotations

import io
import lzma

import pyarrow as pa
import zstandard

from sedimenta.config import CODECS, LEVELS
from sedimenta.errors import EngineError

NAMES = {v: k for k, v in CODECS.items()}


def encode(codec: str, data: bytes) -> bytes:
    if codec == "store":
        return bytes(data)
    if codec == "zstd":
        stream = zstandard.ZstdCompressor(level=LEVELS["zstd"], write_content_size=False).compressobj()
        return stream.compress(data) + stream.flush()
    if codec == "brotli":
        return pa.Codec("brotli", LEVELS["brotli"]).compress(data, asbytes=True)
    if codec == "lzma2":
        return lzma.compress(data, preset=LEVELS["lzma2"])
    raise EngineError("unsupported_codec", codec)


def decode(codec: str, payload: bytes, length: int) -> bytes:
    """Exactly `length` bytes: more is a resource limit, fewer an invalid range; stored bytes beyond it are ignored."""
    if codec == "store":
        out = payload[:length]
    elif codec == "zstd":
        out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(payload)).read(length + 1)
    elif codec == "brotli":
        try:
            out = pa.CompressedInputStream(pa.BufferReader(payload), "brotli").read(length + 1)
        except OSError as e:
            raise EngineError("invalid_range", f"brotli: {e}") from e
    elif codec == "lzma2":
        out = lzma.LZMADecompressor().decompress(payload, max_length=length + 1)
    else:
        raise EngineError("unsupported_codec", codec)
    if len(out) > length:
        raise EngineError("resource_limit", "more bytes than declared")
    if len(out) < length:
        raise EngineError("invalid_range", "fewer bytes than declared")
    return out
