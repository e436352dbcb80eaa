"""Profiles, limits and validated parameters."""

from __future__ import annotations

from dataclasses import dataclass

from sedimenta.errors import EngineError

KIB, MIB, GIB, TIB = 1 << 10, 1 << 20, 1 << 30, 1 << 40

#: Bytes of a solid group under each profile; raw has a group for each file.
GROUP_TARGETS = {"raw": 0, "stream": 4 * MIB, "random": 8 * MIB, "balanced": 64 * MIB, "archive_max": 512 * MIB}
#: Codec ids, and the codecs that each profile tries, in order.
CODECS = {"store": 0, "zstd": 1, "brotli": 2, "lzma2": 3}
CANDIDATES = {
    "raw": ("store",),
    "stream": ("store", "zstd"),
    "random": ("store", "zstd"),
    "balanced": ("store", "zstd", "brotli", "lzma2"),
    "archive_max": ("store", "zstd", "brotli", "lzma2"),
}
LEVELS = {"store": 0, "zstd": 9, "brotli": 9, "lzma2": 6}
#: Bytes that a codec needs beyond its input.
MEMORY_BOUNDS = {"store": 1, "zstd": 128 * MIB, "brotli": 32 * MIB, "lzma2": 64 * MIB}
#: Bytes that a choice of codec costs beyond its payload.
COST_CODEC, COST_GROUP, COST_INDEX, COST_INTEGRITY, COST_PADDING = 16, 48, 0, 4, 0
#: Priorities of jobs, highest first, and their weights.
PRIORITIES = {"interactive_read": 8, "interactive_extract": 6, "verify_requested": 4, "pack_foreground": 3, "pack_background": 2, "benchmark": 1}
#: The state changes that a job may be told to make.
TRANSITIONS = (("queued", "running"), ("queued", "cancelled"), ("running", "cancelling"), ("running", "completed"), ("running", "failed"), ("cancelling", "cancelled"), ("cancelling", "failed"))
TERMINAL = ("completed", "failed", "cancelled")


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise EngineError("resource_limit", what)


@dataclass(frozen=True)
class Chunking:
    minimum: int = 64 * KIB
    average: int = 256 * KIB
    maximum: int = 1024 * KIB
    fixed_block: int = MIB
    micro_file_max: int = 64 * KIB
    pack_target: int = 4 * MIB
    most_chunks: int = 50_000_000
    most_bytes: int = TIB

    def __post_init__(self):
        _check(64 <= self.minimum < self.average < self.maximum <= 16 * MIB, "chunk sizes must rise")
        _check(MIB <= self.fixed_block <= 4 * MIB, "a fixed block has 1 to 4 MiB")
        _check(0 < self.micro_file_max <= 64 * KIB, "a micro-file has at most 64 KiB")
        _check(max(MIB, self.micro_file_max) <= self.pack_target <= 16 * MIB, "a pack has 1 to 16 MiB")
        _check(self.most_chunks > 0 and self.most_bytes > 0, "limits can't be zero")


@dataclass(frozen=True)
class Fingerprinting:
    subchunks: int = 12
    groups: int = 4
    window: int = 48
    most_chunk_bytes: int = 4 * MIB
    parallelism: int = 8
    policy: str = "standard"

    def __post_init__(self):
        _check(4 <= self.subchunks <= 64, "4 to 64 regions")
        _check(self.groups in (3, 4) and self.subchunks % self.groups == 0, "regions must divide into 3 or 4 groups")
        _check(1 <= self.window <= 4096, "a window has 1 to 4096 bytes")
        _check(0 < self.most_chunk_bytes <= 4 * MIB, "a chunk has at most 4 MiB")
        _check(1 <= self.parallelism <= 64, "1 to 64 workers")
        _check(self.policy in ("standard", "paranoid"), "unknown policy")


@dataclass(frozen=True)
class DecodeLimits:
    entries: int = 10_000_000
    groups: int = 1_000_000
    chunks: int = 50_000_000
    original_bytes: int = 10**12
    group_bytes: int = GIB
    expansion: int = 1000
    metadata_bytes: int = 256 * MIB
    path_bytes: int = 32 * KIB
    path_parts: int = 1024
    sections: int = 64


@dataclass(frozen=True)
class ServerLimits:
    jobs: int = 4
    connections: int = 32
    jobs_per_session: int = 128
    threads: int = 8
    memory_bytes: int = 4 * GIB
    temp_bytes: int = 16 * GIB
    output_bytes: int = TIB
    range_bytes: int = 64 * MIB
    events_per_job: int = 4096
    rate_per_second: int = 100
    burst: int = 200
    session_ms: int = 8 * 3600 * 1000
    retained_jobs: int = 4096
    sessions: int = 4096
