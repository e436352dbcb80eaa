"""SimHash near-duplicates: exact linking of 64-bit fingerprints by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import carried, give_back, per_text, small, stage
from sedimenta.operators.components import components

BITS = 64
#: Shingles of one pass over the bits of a text.
SHINGLES_AT_ONCE = 1 << 16
#: Rows of a bucket that meet in one place; larger buckets are dealt out as pairs of parts.
PART_ROWS = 4096
ALL = np.uint64(0xFFFF_FFFF_FFFF_FFFF)


def _bit_counts(hashes: np.ndarray, starts: list[int]) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def _shingle_hashes(text: str, width: int, seed: int) -> tuple[Iterator[int], int]:
    words = text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return iter(()), 0
    if len(words) < width:
        return iter((xxhash.xxh64_intdigest(b" ".join(words), seed),)), 1
    runs = zip(*(islice(words, k, None) for k in range(width)))
    return map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(seed)), len(words) - width + 1


def fingerprints_of(texts: list, width: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text (None: as an empty one), as unsigned integers."""
    over_half = np.zeros((len(texts), BITS), bool)
    held: list[np.ndarray] = []
    rows: list[int] = []
    n_held = 0

    def flush() -> None:
        nonlocal n_held
        if rows:
            sizes = np.array([len(x) for x in held])
            counts = _bit_counts(np.concatenate(held), np.cumsum(sizes) - sizes)
            over_half[rows] = 2 * counts > sizes[:, None]
            held.clear()
            rows.clear()
            n_held = 0

    for i, text in enumerate(texts):
        hashes, n = _shingle_hashes(text or "", width, seed)
        if not n:
            continue
        if n > SHINGLES_AT_ONCE:
            counts = np.zeros(BITS, np.int64)
            for k in range(0, n, SHINGLES_AT_ONCE):
                part = np.fromiter(hashes, np.uint64, min(SHINGLES_AT_ONCE, n - k))
                counts += _bit_counts(part, [0])[0]
            over_half[i] = 2 * counts > n
            continue
        held.append(np.fromiter(hashes, np.uint64, n))
        rows.append(i)
        n_held += n
        if n_held >= SHINGLES_AT_ONCE:
            flush()
    flush()
    return np.packbits(over_half, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """`keep` and fp, the fingerprint as a signed long."""

    def work():
        return lambda texts: {"fp": pa.array(fingerprints_of(texts, width, seed).view(np.int64))}

    return per_text(docs, text, keep, "fp bigint", work)


# --- bit-sliced comparison -------------------------------------------------------------


def _planes(values: np.ndarray) -> np.ndarray:
    """Values in words of 64 lanes -> [bit, word], each a lane mask."""
    n_words = len(values) // BITS
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n_words, BITS, 8), axis=2, bitorder="little")
    lanes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(lanes).view("<u8").reshape(BITS, n_words)


def within(planes: np.ndarray, queries: np.ndarray, words: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """For each query and word of 64 lanes, the mask of valid lanes at `radius` differing bits or fewer.

    The distances of 64 lanes grow together in a counter of a few bit planes: a new
    difference is added by a carry-save step, and a carry out of the top plane marks
    a lane as too far. A word all of whose lanes are too far is abandoned.
    """
    depth = radius.bit_length()
    spare = (1 << depth) - 1 - radius
    out = np.zeros(len(queries), np.uint64)
    left = np.arange(len(queries))
    over = ~valid
    counters = [np.full(len(queries), ALL if spare >> k & 1 else 0, np.uint64) for k in range(depth)]
    for bit in range(BITS):
        carry = planes[bit][words] ^ (np.uint64(0) - (queries >> np.uint64(bit) & np.uint64(1)))
        for k in range(depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if bit % 8 == 7:
            alive = np.flatnonzero(over != ALL)
            if len(alive) < 0.8 * len(left):
                left, over, words, queries = left[alive], over[alive], words[alive], queries[alive]
                counters = [c[alive] for c in counters]
                if not len(left):
                    return out
    out[left] = ~over
    return out


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i]; labels keeps each member's smallest known partner, fully resolved."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def bucket_links(values: np.ndarray, offsets: np.ndarray, radius: int, items_at_once: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Links that span every class of the graph of pairs within `radius` in each bucket.

    values: the distinct fingerprints of bucket after bucket; offsets: where each
    begins, and the end. Returns a link (member, first member of its class) for each
    member that isn't its class's first: all connections, at most one row a member.
    """
    sizes = np.diff(offsets)
    n_words = -(-sizes // BITS)
    first_word = np.cumsum(n_words) - n_words
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - offsets[:-1][bucket]
    slot = first_word[bucket] * BITS + at
    padded = np.zeros(int(n_words.sum()) * BITS, np.uint64)
    padded[slot] = values
    member = np.full(len(padded), -1)
    member[slot] = np.arange(len(values))
    filled = np.packbits((member >= 0).reshape(-1, BITS), axis=1, bitorder="little").view("<u8").ravel()
    planes = np.concatenate([_planes(padded[k : k + BITS * 1024]) for k in range(0, len(padded), BITS * 1024)], axis=1)
    own = slot // BITS
    n_items = first_word[bucket] + n_words[bucket] - own
    ends = np.cumsum(n_items)
    labels = np.arange(len(values))
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + items_at_once)))
        counts = n_items[at:to]
        q = np.repeat(np.arange(at, to), counts)
        w = own[q] + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        lane = (slot[q] % BITS).astype(np.uint64)
        later = np.where(w == own[q], ~((np.uint64(2) << lane) - np.uint64(1)), ALL)
        near = within(planes, values[q], w, filled[w] & later, radius)
        hit = np.flatnonzero(near)
        if len(hit):
            i, lanes = np.nonzero(np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            _settle(labels, q[hit][i], member[w[hit][i] * BITS + lanes])
        at = to
    moved = np.flatnonzero(labels != np.arange(len(values)))
    return values[moved], values[labels[moved]]


def _keys(fp: Column, radius: int, blocks: int) -> Column:
    """One key for each choice of blocks that must agree if at most `radius` bits differ."""
    widths = [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]
    starts = [sum(widths[:i]) for i in range(blocks)]
    parts = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, widths)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, widths[i]).bitwiseOR(parts[i])
        keys.append(key)
    return F.array(*keys)


def near_links(distinct: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(a, b): links that span the classes of fingerprints at `radius` bits or fewer.

    `distinct` has a column fp without repeats. Two fingerprints within the radius
    agree on all of blocks - radius blocks of bits, so they meet in a bucket of one
    of the choices of blocks; with 5 blocks that is ten keys of about 26 bits. A bucket
    of more than PART_ROWS rows is dealt into parts, and every two parts meet in a
    place of their own, so no task holds more than two parts of it.
    """
    if not 0 < radius < blocks or (blocks - radius) * (BITS // blocks + 1) > 52:
        raise ValueError("radius and blocks don't fit")
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), radius, blocks)).alias("bucket"))
    hot = stage(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > PART_ROWS))
    parts = F.coalesce(F.ceil(F.col("n") / PART_ROWS), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = keyed.join(small(hot), "bucket", "left").withColumn("parts", parts).withColumn("mine", mine)
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, "mine").alias("i"), F.greatest(j, "mine").alias("j")))
    places = dealt.select("bucket", "fp", F.explode(meets).alias("place"))
    buckets = places.groupBy("bucket", "place").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
            ends = offsets - offsets[0]
            at = 0
            while at < len(lists):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + 64 * PART_ROWS, "right")) - 1)
                a, b = bucket_links(values[ends[at] : ends[to]], ends[at : to + 1] - ends[at], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
                at = to
        give_back()

    return buckets.mapInArrow(link, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3, width: int = 3, seed: int = 42, blocks: int = 5) -> DataFrame:
    """doc_id, fingerprint, component_id and root for each row of `docs`.

    Words are runs of other characters than ASCII white space, after lower-casing A-Z;
    a text's shingles are its runs of `width` words. A null or empty text has the
    fingerprint zero, which links like any other. component_id is the smallest non-null
    doc_id that the row reaches (null if there is none); root names the component even
    then. Repeated rows each get a row; other columns of `docs` are not touched.
    """
    renamed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    fps = stage(fingerprints(renamed, ["doc_id"], "text", width, seed))
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct.select("fp"), radius, blocks)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(named, "root")
    text_fp = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(classes, "fp").select("doc_id", text_fp.alias("fingerprint"), "component_id", "root")


#: Ids that are taken out by a broadcast, which then has some 50 MB; more are taken out by a shuffle.
BROADCAST_IDS = 1_000_000


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the smallest doc_id.

    Of rows that repeat that doc_id, and of rows without any doc_id in a component
    that has none, one stays. All columns are returned as they are; an empty table stays empty.

    Texts stay where they are: the rows that go are looked up by their ids, from a broadcast as long
    as a count allows it. Only rows whose id is null or occurs again are told apart by their fingerprints.
    """
    found = stage(near_duplicates(docs, doc_id, text, **options))
    named = found.where("doc_id IS NOT NULL")
    again = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"))
    gone = stage(named.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id")).unionByName(again).distinct())
    here = F.col(f"`{doc_id}`")
    plain, new, back = carried(docs.where(here.isNotNull()))
    kept = back(plain.join(small(gone, BROADCAST_IDS), F.col(new[doc_id]) == F.col("__id"), "left_anti"))
    odd = docs.where(here.isNull())
    repeats = again.limit(1).count()
    if repeats:
        more, new, back = carried(docs.where(here.isNotNull()))
        odd = odd.unionByName(back(more.join(small(again, BROADCAST_IDS), F.col(new[doc_id]) == F.col("__id"), "left_semi")))
    if not repeats and not found.where("doc_id IS NULL").limit(1).count():
        return kept
    firsts = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("fingerprint").alias("__print"), F.col("doc_id").alias("__id"), F.col("root").alias("__root")).distinct()
    bare, new, back = carried(odd)
    marked = fingerprints(bare, bare.columns, new[text], **{k: v for k, v in options.items() if k in ("width", "seed")}).withColumn("__print", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    met = marked.join(firsts, (marked["__print"] == firsts["__print"]) & F.col(new[doc_id]).eqNullSafe(F.col("__id")))
    return kept.unionByName(back(met.dropDuplicates(["__root"])))
