"""Content-defined chunk boundaries and superfeatures, vectorised over the bytes of one object."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash

from sedimenta.config import Chunking, Fingerprinting

#: Pairs of bytes that the rolling hash still remembers: each shifts it by two bits.
_MEMORY = 32


def _gear() -> np.ndarray:
    return np.array([int.from_bytes(hashlib.md5(bytes([i]) * 64).digest()[:8], "big") for i in range(256)], np.uint64)


_GEAR = _gear()
_GEAR_LEFT = _GEAR << np.uint64(1)
#: Masks of 5 to 25 bits, spread over a word, from the published algorithm.
_MASKS = {
    5: 0x0000000001804110,
    6: 0x0000000001803110,
    7: 0x0000000018035100,
    8: 0x0000001800035300,
    9: 0x0000019000353000,
    10: 0x0000590003530000,
    11: 0x0000D90003530000,
    12: 0x0000D90103530000,
    13: 0x0000D90303530000,
    14: 0x0000D90313530000,
    15: 0x0000D90F03530000,
    16: 0x0000D90303537000,
    17: 0x0000D90703537000,
    18: 0x0000D90707537000,
    19: 0x0000D91707537000,
    20: 0x0000D91747537000,
    21: 0x0000D91767537000,
    22: 0x0000D93767537000,
    23: 0x0000D93777537000,
    24: 0x0000D93777577000,
    25: 0x0000DB3777577000,
}


def masks_of(average: int) -> tuple[int, int]:
    """The strict mask before the average size and the loose one after it: a bit more and a bit less than its logarithm, rounded."""
    bits = round(math.log2(average))
    return _MASKS[bits + 1], _MASKS[bits - 1]


def _pair_hashes(b: np.ndarray, first: int) -> np.ndarray:
    """For pairs beginning at `first`, the hash over the last _MEMORY pairs."""
    n = (len(b) - first) // 2
    left, right = b[first : first + 2 * n : 2], b[first + 1 : first + 2 * n : 2]
    h = _GEAR_LEFT[left] + _GEAR[right]
    w = 1
    while w < _MEMORY:
        h[w:] += h[:-w].copy() << np.uint64(2 * w)
        w *= 2
    return h


def cut_points(data: bytes, config: Chunking = Chunking()) -> list[int]:
    """Ends of content-defined chunks: a gear hash over pairs of bytes, with a strict mask before
    the average size and a loose one after it. No data, no chunks.
    """
    b = np.frombuffer(data, np.uint8)
    strict, loose = map(np.uint64, masks_of(config.average))
    hashes = [_pair_hashes(b, 0), _pair_hashes(b, 1)]
    # where either byte of a pair passes a mask, for pairs at even and at odd places
    hits = {}
    for odd in (0, 1):
        h = hashes[odd]
        second = _GEAR[b[odd + 1 : odd + 2 * len(h) : 2]]
        first = h - second
        for mask in (strict, loose):
            hits[odd, int(mask)] = np.flatnonzero((first & (mask << np.uint64(1)) == 0) | (h & mask == 0))
    ends, start = [], 0
    while start < len(b):
        left = len(b) - start
        size = left if left <= config.minimum else _cut(b, start, min(left, config.maximum), config, int(strict), int(loose), hits)
        start += size
        ends.append(start)
    return ends


def _cut(b: np.ndarray, start: int, left: int, config: Chunking, strict: int, loose: int, hits: dict) -> int:
    centre = min(config.average, left)
    begin = config.minimum // 2
    odd = start & 1
    base = start // 2  # pairs at places start + 2i are number base + i of their alignment
    h = 0
    # the first pairs see fewer than _MEMORY others, so they are hashed on their own
    for i in range(begin, min(begin + _MEMORY, left // 2)):
        mask = strict if i < centre // 2 else loose
        a = 2 * i
        h = ((h << 2) + int(_GEAR_LEFT[b[start + a]])) & 0xFFFFFFFFFFFFFFFF
        if not h & (mask << 1):
            return a
        h = (h + int(_GEAR[b[start + a + 1]])) & 0xFFFFFFFFFFFFFFFF
        if not h & mask:
            return a + 1
    for mask, low, high in ((strict, begin + _MEMORY, centre // 2), (loose, max(begin + _MEMORY, centre // 2), left // 2)):
        found = hits[odd, mask]
        k = int(np.searchsorted(found, base + low))
        if k < len(found) and found[k] < base + high:
            i = int(found[k]) - base
            at = start + 2 * i
            # which byte of the pair: the hash before the second one is added
            window = 0
            for p in range(at - 2 * (_MEMORY - 1), at + 2, 2):
                window = ((window << 2) + int(_GEAR_LEFT[b[p]])) & 0xFFFFFFFFFFFFFFFF
                if p == at and not window & (mask << 1):
                    return 2 * i
                window = (window + int(_GEAR[b[p + 1]])) & 0xFFFFFFFFFFFFFFFF
            return 2 * i + 1
    return left


#: Fixed value: the base of the rolling polynomial.
_BASE = 0x100000001B3


def superfeatures(data: bytes, config: Fingerprinting = Fingerprinting()) -> list[int]:
    """Signed longs: the maxima of a rolling polynomial over balanced regions, hashed in groups.

    Window sums are built by doubling, so all windows of a region cost a few array steps.
    Empty data has none; a region without bytes contributes 0.
    """
    n, k = len(data), config.subchunks
    if not n:
        return []
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    most = []
    for i in range(k):
        a, z = i * n // k, (i + 1) * n // k
        w = min(config.window, z - a)
        most.append(int(_windows(values[a:z], w).max()) if w else 0)
    size = k // config.groups
    out = []
    for g in range(config.groups):
        x = xxhash.xxh3_64_intdigest(b"".join(m.to_bytes(8, "little") for m in most[g * size : (g + 1) * size]))
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def _windows(v: np.ndarray, w: int) -> np.ndarray:
    """The polynomial over each window of w values: parts of a power of two, put together."""
    out, done = None, 0
    part, width = v, 1
    while True:
        if w & width:
            # windows of `done` values get `width` more on their right
            right = part[done : len(v) - width + 1]
            out = right if out is None else out[: len(right)] * np.uint64(pow(_BASE, width, 1 << 64)) + right
            done += width
        if done == w:
            return out
        part = part[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + part[width:]
        width *= 2
