"""Exact top-k inner-product search by term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import stage

#: Candidates and queries that meet in one task.
TILE_ROWS, TILE_QUERIES = 4_096, 2_048
#: Rows whose dense scores are held at a time, for each query block.
SCORE_ROWS, SCORE_QUERIES = 4_096, 256
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
#: Bytes that hold any inner product of vectors of doubles.
WIDE_BYTES = 264


class Sparse:
    """Rows as postings: for each term the rows that have it, and their weights."""

    def __init__(self, vectors: list[list[float]], scale: int):
        self.n = len(vectors)
        lengths = np.array([len(v) for v in vectors])
        given = np.concatenate([np.asarray(v, np.float64) for v in vectors]) if self.n else np.zeros(0)
        with np.errstate(over="ignore"):
            flat = np.floor(scale * given)
        self.most = float(np.abs(flat).max(initial=0))
        if self.most == np.inf:  # a multiple that no double holds
            flat = np.array([floor(scale * Fraction(x)) for x in given.tolist()], object)
        self.terms = int(lengths.max(initial=0))
        row = np.repeat(np.arange(self.n), lengths)
        term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        held = flat != 0
        order = np.argsort(term[held], kind="stable")
        self.row, self.weight, term = row[held][order], flat[held][order], term[held][order]
        self.start = np.searchsorted(term, np.arange(self.terms + 1))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[term], self.start[term + 1]
        return self.row[a:b], self.weight[a:b]


def _filled(at: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, weights.dtype)
    out[at] = weights
    return out


def accumulate(queries: Sparse, rows: Sparse) -> np.ndarray:
    """Dense integer scores [query, row]: each term's query weights scatter into its postings.

    Sums are held in 32 or 64 bits where they surely fit and as Python integers where they may
    not. Postings that have half of the rows or more are filled up with zeros.
    """
    terms = min(queries.terms, rows.terms)
    bound = terms * queries.most * rows.most
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object
    cast = (lambda w: np.array([int(x) for x in w], object)) if kind is object else (lambda w: w.astype(kind))
    scores = np.zeros((queries.n, rows.n), kind)
    term_scores = np.empty_like(scores)
    for t in range(terms):
        q, a = queries.postings(t)
        r, b = rows.postings(t)
        if not len(q) or not len(r):
            continue
        a, b = cast(a), cast(b)
        if 2 * len(r) >= rows.n:
            r, b = slice(None), _filled(r, b, rows.n)
            if 2 * len(q) >= queries.n:
                scores += np.multiply.outer(_filled(q, a, queries.n), b, out=term_scores)
                continue
        for i, w in zip(q.tolist(), a):
            scores[i, r] += w * b
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores; among equal ones, those that come first."""
    n = len(scores)
    if n <= k:
        return np.argsort(-scores, kind="stable")
    least = np.partition(scores, n - k)[n - k]
    above = np.flatnonzero(scores > least)
    level = np.flatnonzero(scores == least)[: k - len(above)]
    return np.concatenate([above, level])


def _wide(score: int) -> bytes | None:
    """What orders the scores that are held to one end of a long's range; None for any other."""
    return None if LONG_MIN < score < LONG_MAX else (score + (1 << 8 * WIDE_BYTES - 1)).to_bytes(WIDE_BYTES, "big")


def _search(queries: pa.Table, rows: pa.Table, k: int, scale: int) -> Iterator[dict]:
    order = np.lexsort((rows["vec_id"].fill_null(0).to_numpy(), rows["vec_id"].is_null().to_numpy(zero_copy_only=False)))
    rows = rows.take(pa.array(order))
    ids, times, vectors = rows["vec_id"].to_pylist(), rows["times"].to_numpy(), rows["embedding"].to_pylist()
    q_ids, q_vectors = queries["vec_id"].to_pylist(), queries["embedding"].to_pylist()
    by_id: dict = {}
    for r, i in enumerate(ids):
        by_id.setdefault(i, []).append(r)
    blocks = [(ra, Sparse(vectors[ra : ra + SCORE_ROWS], scale)) for ra in range(0, len(ids), SCORE_ROWS)]
    for qa in range(0, len(q_ids), SCORE_QUERIES):
        part = q_vectors[qa : qa + SCORE_QUERIES]
        asked = Sparse(part, scale)
        found: list[list[tuple[int, int]]] = [[] for _ in part]
        for ra, block in blocks:
            scores = accumulate(asked, block)
            for i in range(len(part)):
                mine = [r - ra for r in by_id.get(q_ids[qa + i], ()) if ra <= r < ra + SCORE_ROWS and times[r] == 1 and vectors[r] == part[i]]
                for c in best(scores[i], k + len(mine)):
                    if c not in mine:
                        found[i].append((int(scores[i, c]), ra + int(c)))
        for i, hits in enumerate(found):
            for score, r in sorted(hits, key=lambda x: (-x[0], x[1]))[:k]:
                n = int(times[r]) - (ids[r] == q_ids[qa + i] and vectors[r] == part[i])
                yield {"query_id": q_ids[qa + i], "q": queries["q"][qa + i].as_py(), "asked": queries["times"][qa + i].as_py(), "vec_id": ids[r], "score": min(max(score, LONG_MIN), LONG_MAX), "wide": _wide(score), "times": min(n, k)}


def exact_top_k(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k best other rows.

    Components become floor(scale * x); the score is the inner product, over the common
    length if lengths differ. Scores are ranked as they are and then held to the range of a
    long. Ties go to the smaller id, null ids last. Vectors that are null or hold a null or non-finite component take no
    part; an empty vector scores 0 everywhere. A row that repeats is as often a candidate, and
    a query, as it is there: each of its copies has rows of its own, and may find the others. An empty
    table, or one without a query, gives no rows; other columns aren't read.

    Equal rows are first counted together, so a very common vector is one row. Queries
    and rows then meet tile by tile: each tile holds a bounded number of both, and gives
    at most k rows a query.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    clean = table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding")).where(x.isNotNull() & ~bad)
    rows = stage(clean.groupBy("vec_id", "embedding").agg(F.count("*").alias("times")))
    n = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    across, down = -(-n["rows"] // TILE_ROWS) or 1, -(-n["queries"] // TILE_QUERIES) or 1
    part = F.xxhash64("vec_id", "embedding")
    each_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    one_of = lambda x, n: F.pmod(x, F.lit(n).cast("long"))
    # i and j are longs on both sides: Spark deals an int and the equal long to different tasks
    dealt = rows.withColumn("i", one_of(part, across)).withColumn("j", each_of(down)).withColumn("q", F.lit(None).cast("long"))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("q", part).withColumn("i", each_of(across)).withColumn("j", one_of(F.xxhash64("q"), down))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(_search(left, right, k, scale)), schema=pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("asked", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("wide", pa.binary()), ("times", pa.int64())]))

    met = asked.groupBy("i", "j").cogroup(dealt.groupBy("i", "j")).applyInArrow(tile, "query_id long, q long, asked long, vec_id long, score long, wide binary, times long")
    each = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).where("times > 0")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), F.desc("wide"), F.asc_nulls_last("vec_id"), "copy")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    each_copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("asked")))
    return ranked.withColumn("__copy", each_copy).select("query_id", "rank", "vec_id", "score")
