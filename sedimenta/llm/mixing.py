"""Mixing sources by temperature, realised as budgeted block permutations."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import release, small, stage

#: Blocks that a source's documents are dealt into by hash, and parts of the one block that is cut, as powers of two.
BLOCK_BITS = 12
#: Sources up to this number are weighed on the driver; more are weighed where they are.
DRIVER_SOURCES = 100_000
STEPS = 60


class Mix(NamedTuple):
    """The exponent, and for each source its weight: tokens ** exponent / norm."""

    exponent: float
    norm: float
    tokens: int
    budget: int
    entropy: float


def tokens_of(text: Column) -> Column:
    """The number of words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _sums(totals: DataFrame) -> tuple[int, int, Callable[[float], tuple[float, float]]]:
    """Sources and tokens, and a function from the exponent a to sum(s**a) and sum(s**a * log(s)) of the shares s."""
    held = totals.where("tokens > 0")
    head = held.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    n, t = head["n"], int(head["t"] or 0)
    if n <= DRIVER_SOURCES:
        logs = np.log(np.array(sorted(r["tokens"] for r in held.select("tokens").collect()), float) / max(t, 1))

        def sums(a: float) -> tuple[float, float]:
            return float(np.exp(a * logs).sum()), float((np.exp(a * logs) * logs).sum())
    else:

        def sums(a: float) -> tuple[float, float]:
            log = F.log(F.col("tokens") / t)
            r = held.agg(F.sum(F.exp(log * a)).alias("z"), F.sum(F.exp(log * a) * log).alias("m")).first()
            return r["z"], r["m"]

    return n, t, sums


def _bisect(wanted: Callable[[float], bool]) -> float:
    """The largest exponent in [0, 1] that is wanted, if small ones are."""
    if wanted(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if wanted(mid) else (low, mid)
    return low


def weigh(totals: DataFrame, target_entropy: float = 0.95, most_repeats: float = 4.0, budget: float = 1.0) -> Mix:
    """The mix for a table of `source` and `tokens`.

    The exponent is the largest one, so the one nearest the natural shares, at which
    the entropy of the weights reaches `target_entropy` of the most it can be; but no lower
    than the one at which some source would be seen more than `most_repeats` times.
    `budget` is the tokens of the mix as a multiple of all tokens, at most `most_repeats`.
    """
    n, t, sums = _sums(totals)
    if not n:
        return Mix(1.0, 1.0, 0, 0, 0.0)
    least_log = float(np.log(totals.where("tokens > 0").agg(F.min("tokens")).first()[0] / t))

    def entropy(a: float) -> float:
        z, m = sums(a)
        return float(np.log(z) - a * m / z)

    budget = min(budget, most_repeats)
    exponent = _bisect(lambda a: entropy(a) >= target_entropy * np.log(n) - 1e-12)
    # the smallest source is repeated most, and more often the smaller the exponent
    if budget * np.exp((exponent - 1) * least_log) / sums(exponent)[0] > most_repeats:
        low, high = exponent, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (low, mid) if budget * np.exp((mid - 1) * least_log) / sums(mid)[0] <= most_repeats else (mid, high)
        exponent = high
    return Mix(exponent, sums(exponent)[0], t, int(budget * t), entropy(exponent))


def _place(seed: int) -> Column:
    """A row's place in its source's permutation: 64 bits, by content only."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def _block(seed: int, epoch: Column) -> Column:
    """The position of a row's block in the permutation of blocks of its source and epoch."""
    bits = F.shiftrightunsigned("place", 64 - BLOCK_BITS)
    key = F.xxhash64(F.lit(seed), F.col("source"), epoch)
    step = F.pmod(key, F.lit(1 << 20)) * 2 + 1  # odd, so a permutation of the blocks
    shift = F.pmod(F.shiftrightunsigned(key, 24), F.lit(1 << BLOCK_BITS))
    return F.pmod(bits * step + shift, F.lit(1 << BLOCK_BITS)).cast("int")


def _part() -> Column:
    """Which part of its block a row is in, by the next bits of its place."""
    return F.shiftrightunsigned("place", 64 - 2 * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _cut(rows: DataFrame, by: str, room: str, names: tuple[str, str]) -> DataFrame:
    """For each source the first value of `by` at which its tokens exceed its room, and what room is left there.

    Sums are combined before the shuffle, and a source has at most 2**BLOCK_BITS of them.
    """
    sums = rows.groupBy("source", by).agg(F.sum("n_tokens").alias("tokens"), F.first(room).alias("room"))
    order = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    over = sums.withColumn("upto", F.sum("tokens").over(order)).where("upto > room")
    found = over.groupBy("source").agg(F.min(F.struct(by, (F.col("room") - F.col("upto") + F.col("tokens")).alias("left"))).alias("cut"))
    return found.select("source", F.col("cut")[by].alias(names[0]), F.col("cut.left").alias(names[1]))


def _within(rows: DataFrame, cuts: DataFrame, by: str, at: str) -> DataFrame:
    """The rows at the cut of their source."""
    return rows.join(small(cuts), rows["source"].eqNullSafe(cuts["source"]) & (rows[by] == cuts[at])).drop(cuts["source"])


def plan(rows: DataFrame, seed: int, **options) -> tuple[Mix, DataFrame]:
    """The mix of a table (source, n_tokens, place), and for each source its epochs and where the last one is cut.

    A source's budget gives whole epochs and a rest. The rest takes blocks in permuted
    order; within the block where it runs out, parts of it, and within the part where it
    runs out, rows by place. So only one row in 2**(2 * BLOCK_BITS) of a source is put in order in one
    place, whatever share of all rows the source has.
    """
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    totals = stage(totals)
    mix = weigh(totals, **options)
    weight = F.when(F.col("tokens") > 0, F.exp(mix.exponent * F.log(F.col("tokens") / max(mix.tokens, 1))) / mix.norm).otherwise(0.0)
    owed = F.floor(F.col("weight") * mix.budget * (1 + 1e-12) + 1e-9).cast("long")  # not a token less by rounding
    budgets = totals.withColumn("weight", weight).withColumn("owed", owed)
    budgets = budgets.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("owed") / F.col("tokens"))).otherwise(0).cast("long")).withColumn("rest", F.col("owed") - F.col("epochs") * F.col("tokens"))
    budgets = stage(budgets)
    dealt = rows.join(small(budgets.select("source", "epochs", "rest")), rows["source"].eqNullSafe(budgets["source"])).drop(budgets["source"])
    dealt = dealt.withColumn("block", _block(seed, F.col("epochs")))
    cuts = stage(_cut(dealt, "block", "rest", ("cut", "room")))
    edge = stage(_within(dealt, cuts, "block", "cut").select("source", "n_tokens", "place", "room", _part().alias("part")))
    parts = stage(_cut(edge, "part", "room", ("part_cut", "part_room")))
    end = _within(edge.select("source", "n_tokens", "place", "part"), parts, "part", "part_cut")
    running = Window.partitionBy("source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    last = end.withColumn("upto", F.sum("n_tokens").over(running)).where("upto <= part_room").groupBy("source").agg(F.max("place").alias("last"))
    joined = budgets
    for i, more in enumerate((cuts.drop("room"), parts.drop("part_room"), last)):
        joined = joined.join(more.withColumnRenamed("source", f"s{i}"), F.col("source").eqNullSafe(F.col(f"s{i}")), "left").drop(f"s{i}")
    return mix, stage(joined.select("source", "weight", "epochs", "cut", "part_cut", "last"))


def _counted(docs: DataFrame, made: DataFrame, seed: int) -> DataFrame:
    renamed = made.withColumnRenamed("source", "__source")
    met = docs.join(small(renamed), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    met = met.withColumn("block", _block(seed, F.col("epochs")))
    inside = (_part() < F.col("part_cut")) | ((_part() == F.col("part_cut")) & (F.col("place") <= F.col("last")))
    taken = F.col("cut").isNull() | (F.col("block") < F.col("cut")) | ((F.col("block") == F.col("cut")) & inside)
    return met.withColumn("copies", (F.col("epochs") + F.when(F.col("weight") > 0, F.coalesce(taken, F.lit(False)).cast("long")).otherwise(0)).cast("long"))


def _slim(docs: DataFrame, text: str, source: str, doc_id: str, seed: int) -> DataFrame:
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    return named.select("doc_id", "source", tokens_of(F.col("text")).alias("n_tokens"), _place(seed).alias("place"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 7, **options) -> DataFrame:
    """doc_id, source, n_tokens, weight (of the source), block and copies for each row of `docs`.

    copies is how often the mix holds the row: whole epochs of its source, and one more if
    its block comes before the source's budget runs out. A null source is a source; a null text
    has no tokens, and a source without tokens has weight 0 and no copies. Rows with the
    same id and text share a place, so they are taken together; a source falls short of its
    budget by less than the rows at one place, and never exceeds it. An empty table gives no
    rows; other columns aren't read.
    """
    slim = stage(_slim(docs, text, source, doc_id, seed))
    _, made = plan(slim, seed, **options)
    return _counted(slim, made, seed).select("doc_id", "source", "n_tokens", "weight", "block", "copies")


def drawn(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 7, **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with all columns as they are; see `mixed` for odd rows."""
    slim = stage(_slim(docs, text, source, doc_id, seed))
    _, made = plan(slim, seed, **options)
    release(slim)
    columns = docs.columns
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))
    counted = _counted(named.withColumn("place", _place(seed)), made, seed).where("copies > 0")
    return counted.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")
