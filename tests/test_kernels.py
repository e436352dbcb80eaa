"""Hashes, chunk boundaries, superfeatures and codecs against published vectors and plain versions."""

import hashlib
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.config import Chunking, Fingerprinting
from sedimenta.errors import EngineError
from sedimenta.functions import codecs
from sedimenta.functions.hashing import _CRC0, blake3, crc32c, xxh3
from sedimenta.functions.kernels import cut_points, masks_of, superfeatures
from sedimenta.operators.jobs import dag_levels, dispatch, next_state
from sedimenta.operators.ordered import _next_starts, chained, summary

M = (1 << 64) - 1


def _xorshift(state, n, byte):
    out = bytearray()
    for i in range(n):
        state ^= state << 13 & M
        state ^= state >> 7
        state ^= state << 17 & M
        out.append(byte(state, i))
    return bytes(out)


def test_hashes():
    assert crc32c(b"abc") == 0x364B3FB7
    assert blake3(b"abc")[:16].hex() == "6437b3ac38465133ffb63b75273a8db5"
    assert xxh3(b"abc") & M == 0x78AF5F94892F3950
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"


@pytest.mark.parametrize("n", [0, 1, 63, 16_383, 16_384, 70_001])
def test_crc_lanes(n):
    data = random.Random(n).randbytes(n)
    crc = 0xFFFFFFFF
    for b in data:
        crc = _CRC0[(crc ^ b) & 255] ^ crc >> 8
    assert crc32c(data) == crc ^ 0xFFFFFFFF


def test_frozen_boundaries():
    data = _xorshift(0x6A09E667F3BCC909, 6 * 2**20 + 12_345, lambda s, i: (s & 255) ^ ((i & 255) * 31 & 255))
    ends = cut_points(data)
    pairs = b"".join(struct.pack("<QI", a, b - a) for a, b in zip([0, *ends], ends))
    assert len(ends) == 22 and blake3(pairs).hex() == "0eae0ffb692f3f31a2a3d2616112fcd0bca04a66ea660083c3826751587b52bc"
    edited = data[: 97 * 1024] + bytes(4096) + data[97 * 1024 :]
    again = {e - 4096 for e in cut_points(edited)}
    assert len([e for e in ends if e > 97 * 1024 and e not in again]) <= 3


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=6000))
def test_boundaries_cover(data):
    ends = cut_points(data, Chunking(minimum=64, average=256, maximum=1024))
    assert ends == sorted(set(ends)) and (ends[-1:] or [0])[0] == len(data)
    assert all(b - a <= 1024 for a, b in zip([0, *ends], ends))


def _plain_cuts(data, config):
    """Byte by byte, as the published algorithm has it."""
    gear = [int.from_bytes(hashlib.md5(bytes([i]) * 64).digest()[:8], "big") for i in range(256)]
    strict, loose = masks_of(config.average)
    ends, start, word = [], 0, (1 << 64) - 1
    while start < len(data):
        left = len(data) - start
        size = left
        if left > config.minimum:
            size = left = min(left, config.maximum)
            h, centre = 0, min(config.average, left)
            for i in range(config.minimum // 2, left // 2):
                mask = strict if i < centre // 2 else loose
                h = ((h << 2) + (gear[data[start + 2 * i]] << 1)) & word
                if not h & (mask << 1):
                    size = 2 * i
                    break
                h = (h + gear[data[start + 2 * i + 1]]) & word
                if not h & mask:
                    size = 2 * i + 1
                    break
        start += size
        ends.append(start)
    return ends


@pytest.mark.parametrize("minimum, average, maximum", [(64, 256, 1024), (256, 1024, 4096), (1000, 3000, 9000), (1024, 4096, 16384), (4096, 16384, 65536), (16384, 65536, 131072)])
def test_boundaries_at_every_average(minimum, average, maximum):
    config = Chunking(minimum=minimum, average=average, maximum=maximum)
    data = random.Random(average).randbytes(12 * average) + bytes(2 * maximum) + b"abcd" * average
    assert cut_points(data, config) == _plain_cuts(data, config)


def test_masks():
    for bits in range(6, 25):
        strict, loose = masks_of(1 << bits)
        assert strict.bit_count() == bits + 1 and loose.bit_count() == bits - 1


def test_superfeatures():
    data = _xorshift(0x9E3779B97F4A7C15, 65_536, lambda s, i: s >> 24 & 255)
    assert [x & M for x in superfeatures(data)] == [516916243233388654, 4424382218447919696, 6983238759544818765, 3444815408549078898]
    assert [x & M for x in superfeatures(data, Fingerprinting(groups=3))] == [9966265271562159218, 1036113484870203154, 1633176484281783577]
    edited = bytes(b ^ 0xA5 if i < len(data) // 12 else b for i, b in enumerate(data))
    assert sum(a == b for a, b in zip(superfeatures(data), superfeatures(edited))) >= 3
    assert superfeatures(b"") == [] and len(superfeatures(b"abc")) == 4


@pytest.mark.parametrize("codec", ["store", "zstd", "brotli", "lzma2"])
def test_codecs(codec):
    data = b"shared-prefix " * 300 + bytes(range(256))
    payload = codecs.encode(codec, data)
    assert codecs.decode(codec, payload, len(data)) == data
    assert codecs.decode(codec, codecs.encode(codec, b""), 0) == b""
    with pytest.raises(EngineError):
        codecs.decode(codec, payload, len(data) + 1)
    if codec != "store":
        with pytest.raises(EngineError):
            codecs.decode(codec, payload, len(data) - 1)


def test_configuration():
    with pytest.raises(EngineError):
        Chunking(minimum=1024, average=512)
    with pytest.raises(EngineError):
        Fingerprinting(subchunks=13)


def _plain_fit(lengths, target):
    groups, fill = [], None
    for n in lengths:
        if fill is not None and fill + n <= target:
            fill += n
            groups.append(groups[-1])
        else:
            fill = n
            groups.append(groups[-1] + 1 if groups else 0)
    return groups, fill


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=1, max_size=40), st.integers(1, 20), st.integers(0, 25))
def test_run_summaries(lengths, target, fill):
    """What a summary says about an open group is what the plain loop does."""
    a = np.array(lengths)
    cut = len(lengths) // 2
    halves = [x for x in (a[:cut], a[cut:]) if len(x)]
    made = summary(halves[0], target) if len(halves) == 1 else chained(summary(halves[0], target), summary(halves[1], target), target)
    groups, end = _plain_fit([fill, *lengths], target)
    assert summary(a, target).after(fill, 3, target) == made.after(fill, 3, target) == (end, groups[-1] + 3)
    groups, end = _plain_fit(lengths, target)
    assert made.after(-1, 0, target) == (end, groups[-1] + 1)
    upto, after = _next_starts(a, target)
    whole, _ = _plain_fit(lengths, target)
    at, starts = 0, []
    while at < len(a):
        starts.append(at)
        at = int(after[at])
    assert starts == [i for i in range(len(a)) if i == 0 or whole[i] != whole[i - 1]]


def test_equal_rows_give_few_lines():
    """A million equal rows: as many lines as rows fit into a group, also when runs are chained."""
    one = summary(np.full(1_000_000, 1024), 4 << 20)
    both = chained(one, one, 4 << 20)
    assert len(one.before) <= 4098 and len(both.before) <= 4098
    assert both.after(-1, 0, 4 << 20) == summary(np.full(2_000_000, 1024), 4 << 20).after(-1, 0, 4 << 20)


def test_dag():
    assert dag_levels({1: [], 2: [1], 3: [1, 2], 4: []}) == {1: 0, 4: 0, 2: 1, 3: 2}
    with pytest.raises(EngineError):
        dag_levels({1: [2], 2: [1]})
    with pytest.raises(EngineError):
        dag_levels({1: [9]})
    tasks = [{"id": 30, "priority": 2, "needs": [], "memory": 1}, {"id": 20, "priority": 0, "needs": [10], "memory": 1}, {"id": 10, "priority": 1, "needs": [], "memory": 1}]
    assert dispatch(tasks, 10) == [10, 20, 30]
    with pytest.raises(EngineError):
        dispatch(tasks, 0)


def test_job_states():
    assert next_state("queued", "cancel") == ("cancelled", "applied")
    assert next_state("running", "cancel") == ("cancelling", "applied")
    assert next_state("cancelling", "cancel") == ("cancelling", "ignored")
    assert next_state("completed", "cancel") == ("completed", "conflict")
    assert next_state("queued", "complete") == ("completed", "applied")
    assert next_state("failed", "start") == ("failed", "conflict")


def test_many_hashes_at_once():
    from sedimenta.functions.hashing import blake3_many

    rnd = random.Random(1)
    blobs = [rnd.randbytes(n) for n in (0, 1, 64, 65, 1023, 1024, 1025, 2048, 2049, 3073, 7168, 100_000)] * 2
    assert blake3_many(blobs) == [blake3(x) for x in blobs] and blake3_many([]) == []


def test_checksums_of_many_are_those_of_each():
    from sedimenta.functions.hashing import crc32c_many

    draw = random.Random(9)
    blobs = [draw.randbytes(n) for n in [*range(12), 255, 256, 257, 511, 512, 513, 769, 4096, 70_000, 5 << 20, 3, 0]]
    assert crc32c_many(blobs) == [crc32c(x) for x in blobs] and crc32c_many([]) == []
