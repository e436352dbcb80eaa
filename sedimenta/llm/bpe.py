"""Byte-level BPE by merge replay over the distinct pieces of a slab of texts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sedimenta.llm.common import per_text, slabs

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of pieces and ids that a worker remembers, beyond which it starts anew, and the longest piece that is.
KNOWN_BYTES, KNOWN_PIECE = 40 << 20, 256
#: Looked-up pairs of tokens that a worker remembers.
KNOWN_PAIRS = 200_000
#: Bytes of new pieces that are encoded together, and the longest piece whose merges are applied with those of others.
REPLAY_BYTES, TOGETHER = 1 << 18, 64
#: Ranges of ranks whose merges are looked at together begin at these powers of two.
RANGES = range(9, 17)
#: Pieces of one text that are turned into ids at a time.
PIECES_AT_ONCE = 1 << 16
#: Bytes of text that are split into pieces together.
SPLIT_BYTES = 1 << 20
#: Characters beyond which a text that isn't Latin-1 is split lazily.
LONG_TEXT = 1 << 20

_EDGE, _GONE = -1, -2
_NO_MERGE = 1 << 30
#: The contractions that the pattern takes as pieces of their own.
_CONTRACTIONS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")
_LETTER, _DIGIT, _SPACE, _OTHER = range(4)


def _latin_classes() -> tuple[np.ndarray, bytes]:
    """The class of each Latin-1 character under the pattern, and those to leave to the pattern itself."""
    kinds, odd = np.empty(256, np.uint8), []
    for code in range(256):
        c = chr(code)
        kinds[code] = next((k for k, p in enumerate((r"\p{L}", "[0-9]", r"\s")) if regex.match(p, c)), _OTHER)
        if regex.match(r"\p{N}", c) and kinds[code] != _DIGIT or c.isspace() != bool(regex.match(r"\s", c)):
            odd.append(code)
    return kinds, bytes(odd)


_KIND, _ODD = _latin_classes()


def latin_pieces(data: bytes, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pattern's pieces begin and end, for Latin-1 texts laid end to end.

    Runs of one class are found for all texts at once. A last space before a run joins
    it, other white space before one stands alone, and contractions are taken apart.
    """
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    kind = _KIND[raw]
    starts = np.zeros(n + 1, bool)
    starts[1:n] = kind[1:] != kind[:-1]
    starts[doc_starts[doc_starts < n]] = True
    runs = np.flatnonzero(starts[:n])
    ends = np.append(runs[1:], n)
    fresh = np.zeros(n + 1, bool)
    fresh[doc_starts] = True
    fresh[n] = True
    gap = (kind[runs] == _SPACE) & ~fresh[ends]  # white space before something else of the same text
    last = ends[gap] - 1
    starts[last] = True
    joined = raw[last] == 32
    starts[last[joined] + 1] = False
    marks = np.flatnonzero((raw == 39) & starts[:n])
    for c in _CONTRACTIONS if len(marks) else ():
        fits = marks[marks + len(c) <= n]
        for k in range(1, len(c)):
            fits = fits[(raw[fits + k] == c[k]) & ~fresh[fits + k]]
        starts[fits + 1] = False
        after = fits + len(c)
        starts[after[after < n]] = True
    begin = np.flatnonzero(starts[:n])
    return begin, np.append(begin[1:], n)


@lru_cache(maxsize=2)
def _ranks(path: str) -> tuple[dict[bytes, int], list[bytes], np.ndarray, np.ndarray]:
    """Of a file of ranks: the rank of each token, the token of each rank, and a table of the pairs that spell tokens."""
    with open(path, "rb") as f:
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    token = [b""] * (max(rank.values()) + 1)
    of: list[int] = []
    made: list[int] = []
    get = rank.get
    for t, r in rank.items():
        token[r] = t
        for k in range(1, len(t)):
            if (x := get(t[:k])) is not None and (y := get(t[k:])) is not None:
                of.append(x << 32 | y)
                made.append(r)
    return rank, token, *_hashed(np.array(of, np.int64), np.array(made, np.int64))


def _slot(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64)


def _hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open table of these different keys and their values; its size is a power of two, empty slots have the key -1."""
    n = 1 << max(4, (2 * len(keys)).bit_length())
    held, value = np.full(n, -1, np.int64), np.full(n, _NO_MERGE, np.int32)
    at = _slot(keys, n)
    while len(keys):
        free = held[at] < 0
        held[at[free]] = keys[free]
        placed = held[at] == keys
        value[at[placed]] = values[placed]
        keys, values, at = keys[~placed], values[~placed], at[~placed] + 1 & n - 1
    return held, value


class MergeReplay:
    """Encodes distinct pieces together.

    An inverted index leads from each merge to the places where a neighbouring pair
    of tokens spells it. Merges are taken in rank order, those of a range of ranks
    together: of each piece the lowest one that it holds is applied at its leftmost
    place, in all pieces at once, until none of the range is left. Only the two
    neighbours of a place get new entries; one of a lower rank, or of this range, is
    taken before the next range, as encoding piece by piece would have it.

    Long pieces take merges one by one from a heap: each is applied at all its places,
    leftmost first within a piece. Where a merge makes a pair of a lower rank, the rest
    of that piece waits until the lower one has been applied.
    """

    def __init__(self, path: str = RANKS):
        self.rank, self.token, self.held, self.made = _ranks(path)
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}

    def spelled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the tokens that pairs spell together, _NO_MERGE where there is none or a side is an edge."""
        keys = a << 32 | b
        at = _slot(keys, len(self.held))
        found = self.held[at]
        fits = (found == keys) & (keys >= 0)
        out = np.where(fits, self.made[at], _NO_MERGE).astype(np.int64)
        rest = np.flatnonzero(~fits & (found >= 0) & (keys >= 0))
        at = at[rest]
        while len(rest):
            at = at + 1 & len(self.held) - 1
            found = self.held[at]
            fits = found == keys[rest]
            out[rest[fits]] = self.made[at[fits]]
            on = ~fits & (found >= 0)
            rest, at = rest[on], at[on]
        return out

    def merged(self, a: int, b: int) -> int:
        """The rank of the token that the two spell together, or -1."""
        key = a << 32 | b
        if (r := self.pairs.get(key)) is None:
            r = self.pairs[key] = self.rank.get(self.token[a] + self.token[b], -1)
        return r

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        return [ids for a, b in slabs(map(len, pieces), REPLAY_BYTES) for ids in self._together(pieces[a:b])]

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        out: list = list(map(self.rank.get, pieces))
        rest = [i for i, r in enumerate(out) if r is None]
        whole = np.array([r for r in out if r is not None], "<u4").tobytes()
        at = 0
        for i, r in enumerate(out):
            if r is not None:
                out[i] = whole[at : at + 4]
                at += 4
        if not rest:
            return out
        raw = np.frombuffer(b"".join(pieces[i] for i in rest), np.uint8)
        lengths = np.array([len(pieces[i]) for i in rest])
        ends = np.cumsum(lengths + 1)
        piece_of = np.repeat(np.arange(len(rest)), lengths + 1)
        laid = np.full(len(piece_of), _EDGE)
        inside = np.ones(len(laid), bool)
        inside[ends - 1] = False
        laid[inside] = self.of_byte[raw]
        spelled = self.spelled(laid, np.append(laid[1:], _EDGE))
        long = np.repeat(lengths > TOGETHER, lengths + 1)
        if long.any():
            kept = self._one_by_one(laid, ends, np.where(long, spelled, _NO_MERGE))
            spelled[long] = _NO_MERGE
        else:
            kept = laid
        kept = self._by_ranges(kept, piece_of, spelled)
        live = kept >= 0
        ids = kept[live].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(piece_of[live], minlength=len(rest)))).tolist()
        for i, start, stop in zip(rest, [0, *stops], stops):
            out[i] = ids[start:stop]
        return out

    def _by_ranges(self, tok: np.ndarray, piece: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """What is left of `tok` after all merges; `rank` is what each place and the next one spell."""
        n = len(tok)
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        uppers = np.append(1 << np.array(RANGES), _NO_MERGE)
        index: list[list[np.ndarray]] = [[] for _ in uppers]

        def put(places: np.ndarray) -> None:
            which = uppers.searchsorted(rank[places], "right")
            for k in range(len(uppers)):
                index[k].append(places[which == k])

        put(np.flatnonzero(rank < _NO_MERGE))
        for k, upper in enumerate(uppers):
            places = np.sort(np.concatenate(index[k]))
            while len(places := places[rank[places] < upper]):
                own = piece[places]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                i = np.minimum.reduceat(rank[places] << 32 | places, first) & 0xFFFFFFFF
                r, j, h = rank[i], after[i], before[i]
                m = after[j]
                tok[i], tok[j], rank[j] = r, _GONE, _NO_MERGE
                after[i], before[m] = m, i
                rank[i], rank[h] = self.spelled(r, tok[m]), self.spelled(tok[h], r)
                fresh = np.concatenate([i, h])
                soon = rank[fresh] < upper
                put(fresh[~soon & (rank[fresh] < _NO_MERGE)])
                places = np.sort(np.concatenate([places, fresh[soon]]))  # some twice
                places = places[np.r_[True, places[1:] != places[:-1]]]
        return tok

    def _one_by_one(self, laid: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The same from a heap."""
        if len(self.pairs) > KNOWN_PAIRS:
            self.pairs.clear()
        order = np.argsort(rank, kind="stable")
        order = order[rank[order] < _NO_MERGE]
        for i in np.unique(laid[order] << 32 | laid[order + 1]).tolist():
            self.merged(i >> 32, i & 0xFFFFFFFF)
        ranks, first = np.unique(rank[order], return_index=True)
        index = {int(r): p.tolist() for r, p in zip(ranks, np.split(order, first[1:]))} if len(ranks) else {}
        return np.array(self._replay(laid.tolist(), ends, index))

    def _replay(self, tok: list[int], ends: np.ndarray, index: dict[int, list[int]]) -> list[int]:
        n = len(tok)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        merged, known, end_of = self.merged, self.pairs.get, ends.searchsorted
        heap = list(index)
        heapify(heap)
        tok.append(_EDGE)  # so that the first position's left neighbour is an edge too
        while heap:
            r = heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            if len(places) > 1:
                places.sort()
            waiting: list[int] = []
            wait_until = -1
            for i in places:
                a = tok[i]
                if a < 0:
                    continue
                j = after[i]
                b = tok[j]
                if b < 0 or known(a << 32 | b) != r:  # a pair in the index has been looked up
                    continue
                if i < wait_until:
                    waiting.append(i)
                    continue
                k = after[j]
                tok[i], tok[j] = r, _GONE
                after[i] = k
                before[k] = i
                lower = False
                c = tok[k]
                if c >= 0:
                    x = known(r << 32 | c)
                    if x is None:
                        x = merged(r, c)
                    if x >= 0:
                        if x in index:
                            index[x].append(i)
                        else:
                            index[x] = [i]
                            heappush(heap, x)
                        lower = x < r
                h = before[i]
                c = tok[h]
                if c >= 0:
                    x = known(c << 32 | r)
                    if x is None:
                        x = merged(c, r)
                    if x >= 0:
                        if x in index:
                            index[x].append(h)
                        else:
                            index[x] = [h]
                            heappush(heap, x)
                        lower |= x < r
                if lower:
                    wait_until = int(ends[end_of(i, "right")])
            if waiting:
                index.setdefault(r, []).extend(waiting)
                heappush(heap, r)
        tok.pop()
        return tok


class Codec:
    """Texts to ids and back, with a bounded memory of pieces."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        self.replay = MergeReplay(path)
        self.split = regex.compile(pattern)
        self.latin = pattern == public_tokenizers.PATTERN
        self.known: dict = {}  # of pieces of Latin-1 texts as bytes, of others as str
        self.held = 0

    def _learn(self, pieces: list, utf8: Callable) -> dict:
        """The ids of all these pieces, and of others that are remembered."""
        different = set(pieces)
        long = [p for p in different if len(p) > KNOWN_PIECE]
        different.difference_update(long)
        new = list(different.difference(self.known))
        if new:
            if self.held > KNOWN_BYTES:
                self.known.clear()
                self.held, new = 0, list(different)
            self.known.update(zip(new, self.replay.encode([utf8(p) for p in new])))
            self.held += sum(map(len, new)) + 160 * len(new)
        return self.known | dict(zip(long, self.replay.encode([utf8(p) for p in long]))) if long else self.known

    def _ids(self, pieces: list, utf8: Callable) -> bytes:
        return b"".join(map(self._learn(pieces, utf8).__getitem__, pieces))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, Iterator[bytes]]]:
        """(place, ids in parts) for each text, in any order."""
        plain, other = [], []
        for i, t in enumerate(texts):
            try:
                e = t.encode("latin-1") if self.latin else None
            except UnicodeEncodeError:
                e = None
            if e is not None and len(e.translate(None, _ODD)) == len(e):
                plain.append((i, e))
            else:
                other.append((i, t))
        if plain:
            yield from self._plain(plain)
        for i, t in other:
            yield i, self._other(t)

    def _plain(self, plain: list[tuple[int, bytes]]) -> Iterator[tuple[int, Iterator[bytes]]]:
        data = b"".join(e for _, e in plain)
        doc_ends = np.cumsum([len(e) for _, e in plain])
        begin, end = latin_pieces(data, doc_ends - [len(e) for _, e in plain])
        cuts = [0, *np.searchsorted(begin, doc_ends).tolist()]
        utf8 = lambda p: p.decode("latin-1").encode()

        def parts(a: int, b: int) -> Iterator[bytes]:
            for k in range(a, b, PIECES_AT_ONCE):
                to = min(k + PIECES_AT_ONCE, b)
                yield self._ids([data[s:e] for s, e in zip(begin[k:to].tolist(), end[k:to].tolist())], utf8)

        at = 0
        while at < len(plain):  # several texts together learn their pieces at once
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PIECES_AT_ONCE, "right")) - 1)
            if to > at + 1:
                a, b = cuts[at], cuts[to]
                pieces = [data[s:e] for s, e in zip(begin[a:b].tolist(), end[a:b].tolist())]
                known = self._learn(pieces, utf8).__getitem__
                for k in range(at, to):
                    yield plain[k][0], iter((b"".join(map(known, pieces[cuts[k] - a : cuts[k + 1] - a])),))
            else:
                yield plain[at][0], parts(cuts[at], cuts[at + 1])
            at = to

    def _other(self, text: str) -> Iterator[bytes]:
        if len(text) < LONG_TEXT:
            yield self._ids(self.split.findall(text), str.encode)
            return
        found = (m.group() for m in self.split.finditer(text))
        while pieces := list(islice(found, PIECES_AT_ONCE)):
            yield self._ids(pieces, str.encode)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def digests(texts: list, codec: Codec) -> dict:
    n_tokens = [0] * len(texts)
    ids_sha, text_sha = [""] * len(texts), [""] * len(texts)
    for i, parts in codec.encode_batch([t or "" for t in texts]):
        ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()
        for part in parts:
            n_tokens[i] += len(part) // 4
            ids_hash.update(part)
            text_hash.update(codec.decode(part))
        ids_sha[i], text_sha[i] = ids_hash.hexdigest(), text_hash.hexdigest()
    return {"n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}


def encoded(docs: DataFrame, keep: list[str], text: str = "text", path: str = RANKS) -> DataFrame:
    """`keep`, ids, the token ids of each whole text (null: of an empty one), and round_trip, whether they decode to it.

    Ids are those of piecewise byte-pair encoding by the ranks in the file at `path`,
    without special tokens. Ties go to the leftmost pair; a text without characters
    has no ids; repeated rows each get a row.
    """

    def work():
        codec = Codec(path)

        def apply(texts: list) -> dict:
            ids: list = [None] * len(texts)
            same = [False] * len(texts)
            for i, parts in codec.encode_batch([t or "" for t in texts]):
                held = b"".join(parts)
                ids[i] = np.frombuffer(held, "<u4").astype(np.int32)
                same[i] = codec.decode(held) == (texts[i] or "").encode()
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))), "round_trip": pa.array(same, pa.bool_())}

        return apply

    return per_text(docs, text, keep, "ids array<int>, round_trip boolean", work, SPLIT_BYTES)


def decoded(rows: DataFrame, keep: list[str], ids: str = "ids", path: str = RANKS) -> DataFrame:
    """`keep` and text, from token ids; null ids give a null text."""
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = MergeReplay(path).token
        for batch in batches:
            texts = [None if x is None else b"".join(token[k] for k in x).decode("utf-8", "replace") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.select(*keep, ids).mapInArrow(run, ", ".join(x for x in (fields, "text string") if x))


def encode_decode_digests(docs: DataFrame, keep: list[str], text: str = "text", path: str = RANKS) -> DataFrame:
    """`keep`, n_tokens, ids_sha256 and decoded_sha256 of each whole text, encoded and decoded again.

    A null text counts as empty: no tokens, and both digests are of nothing. Texts of
    any length are taken in parts, so only a part's ids are held.
    """

    def work():
        codec = Codec(path)
        return lambda texts: digests(texts, codec)

    return per_text(docs, text, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", work, SPLIT_BYTES)
