"""Orders, running sums, ordered folds and next-fit grouping that don't end in a single task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from sedimenta.staging import small, stage

#: Rows of an ordered table that one task folds in a next-fit pass.
FOLD_ROWS = 1 << 20


def ordered(df: DataFrame, order: list, number: str | None = None, sums: dict[str, str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Adds a dense position from 0 and running sums before each row, over all rows or within `keys`.

    `sums` maps a new column to the one it sums. Rows are sorted once by range and
    written; each range then adds what the ranges before it hold of its key. No
    window sees more than one range, however many rows share a key.
    """
    keys, sums = keys or [], sums or {}
    by = [F.col(k) if isinstance(k, str) else k for k in [*keys, *order]]
    laid = stage(df.orderBy(*by).withColumn("__range", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    totals = laid.groupBy("__range", *keys).agg(F.count("*").alias("__n"), *[F.sum(src).alias(f"__s{i}") for i, src in enumerate(sums.values())])
    before = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *keys, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ["__n", *[f"__s{i}" for i in range(len(sums))]]])
    renamed = offsets.select("__n0", *[f"__s{i}0" for i in range(len(sums))], *[F.col(k).alias(f"__k{i}") for i, k in enumerate(["__range", *keys])])
    on: Column = F.lit(True)
    for i, k in enumerate(["__range", *keys]):
        on = on & laid[k].eqNullSafe(F.col(f"__k{i}"))
    met = laid.join(small(renamed), on)
    inside = Window.partitionBy("__range", *keys).orderBy("__row")
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = met
    if number:
        out = out.withColumn(number, (F.row_number().over(inside) - 1 + F.col("__n0")).cast("long"))
    for i, (name, src) in enumerate(sums.items()):
        out = out.withColumn(name, (F.coalesce(F.sum(src).over(prior), F.lit(0)) + F.col(f"__s{i}0")).cast("long"))
    return out.select(*df.columns, *([number] if number else []), *sums)


def lagged(df: DataFrame, keys: list[str], order: list, column: str, name: str) -> DataFrame:
    """Adds as `name` the value of `column` in the row before within `keys`, null in a key's first row.

    Like `ordered`, it looks at one range of the sorted table at a time, so a key that most rows share is no hot window.
    """
    by = [F.col(k) if isinstance(k, str) else k for k in [*keys, *order]]
    held = F.struct(F.col(column).alias("v"))  # so that a null value is told from no row
    laid = stage(df.orderBy(*by).withColumn("__range", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    ends = laid.groupBy("__range", *keys).agg(F.max_by(held, "__row").alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__range")
    entering = ends.select(F.lag("__end").over(before).alias("__entry"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(["__range", *keys])])
    on: Column = F.lit(True)
    for i, k in enumerate(["__range", *keys]):
        on = on & laid[k].eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy("__range", *keys).orderBy("__row")
    out = laid.join(small(entering), on).withColumn(name, F.coalesce(F.lag(held).over(inside), F.col("__entry"))["v"])
    return out.select(*df.columns, name)


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], reads: list[str], added: str, start: Callable[[], object], step: Callable[..., tuple[object, tuple]]) -> DataFrame:
    """Folds each key's rows in order, adding the columns that `step(state, *values of reads)` returns as a tuple.

    For folds whose state can't be a window function. Rows of a key reach one task in
    order and pass through it batch by batch, so only the state is held; a key's fold is
    sequential, so it takes time in proportion to the key's rows.
    """
    names = df.columns
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keyed = zip(*(batch.column(names.index(k)).to_pylist() for k in keys))
            values = zip(*(batch.column(names.index(c)).to_pylist() for c in reads))
            made = []
            for key, row in zip(keyed, values):
                if state is None or key != now:
                    now, state = key, start()
                state, more = step(state, *row)
                made.append(more)
            extra = [pa.array(column, f.type) for column, f in zip(zip(*made), schema)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, *schema.names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ", ".join([*types, added]))


def _next_starts(lengths: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums including each row, and for each row the start of the group after one that starts there."""
    upto = np.cumsum(lengths, dtype=np.int64)
    after = np.searchsorted(upto, upto - lengths + target, "right")
    return upto, np.maximum(after, np.arange(1, len(lengths) + 1))


class Lines(NamedTuple):
    """What consecutive rows do to a group that is open when they begin, of which only the room left matters.

    A line tells, from the bytes before it on: the first row that doesn't fit there, or after it, begins a group, and
    in the end `fill` bytes are open and `begun` groups have been begun. The last line that begins within
    the room holds; if all `total` bytes fit, none does. The first line also holds if no group is open.
    """

    before: np.ndarray
    fill: np.ndarray
    begun: np.ndarray
    total: int

    def after(self, fill: int, groups: int, target: int) -> tuple[int, int]:
        """Open bytes (-1: none) and groups begun after these rows, from those before them."""
        if 0 <= fill and fill + self.total <= target:
            return fill + self.total, groups
        at = 0 if fill < 0 else max(int(np.searchsorted(self.before, target - fill, "right")) - 1, 0)  # over the target nothing fits
        return int(self.fill[at]), groups + int(self.begun[at])

    def shortened(self) -> Lines:
        """Without lines that do the same as the one before them."""
        new = np.r_[True, (self.fill[1:] != self.fill[:-1]) | (self.begun[1:] != self.begun[:-1])]
        return Lines(self.before[new], self.fill[new], self.begun[new], self.total)


def summary(lengths: np.ndarray, target: int) -> Lines:
    """The lines of a run of rows: at most one for each row that could be the first not to fit."""
    n = len(lengths)
    upto, after = _next_starts(lengths, target)
    before = upto - lengths
    # from each row to the last group start that follows from it, by doubling
    up = np.where(after < n, after, np.arange(n))
    steps = (after < n).astype(np.int64)
    while (up[up] != up).any():
        steps, up = steps + steps[up], up[up]
    reach = min(n, int(np.searchsorted(before, target, "right")) + 1)  # an open group leaves at most `target` for the first row
    return Lines(before[:reach], (upto[-1] - before[up])[:reach], steps[:reach] + 1, int(upto[-1])).shortened()


def chained(first: Lines, then: Lines, target: int) -> Lines:
    """The lines of rows and others that follow them."""
    fits = first.fill + then.total <= target
    at = np.maximum(np.searchsorted(then.before, target - first.fill, "right") - 1, 0)
    fill, begun = np.where(fits, first.fill + then.total, then.fill[at]), first.begun + np.where(fits, 0, then.begun[at])
    reach = int(np.searchsorted(then.before, target - first.total, "right")) if first.total <= target else 0
    return Lines(np.r_[first.before, first.total + then.before[:reach]], np.r_[fill, then.fill[:reach]], np.r_[begun, then.begun[:reach]], first.total + then.total).shortened()


_LINES = "run long, line long, before long, fill long, begun long, total long"


def _as_table(run: int, lines: Lines) -> pa.Table:
    n = len(lines.before)
    return pa.table({"run": np.full(n, run), "line": np.arange(n), "before": lines.before, "fill": lines.fill, "begun": lines.begun, "total": np.full(n, lines.total)})


def _runs(table: pa.Table) -> Iterator[tuple[int, Lines]]:
    table = table.sort_by([("run", "ascending"), ("line", "ascending")])
    runs = table["run"].to_numpy()
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]][: len(runs)])
    columns = [table[c].to_numpy() for c in ("before", "fill", "begun", "total")]
    for a, b in zip(starts, [*starts[1:], len(runs)]):
        yield int(runs[a]), Lines(*(c[a:b] for c in columns[:3]), int(columns[3][a]))


def next_fit(df: DataFrame, position: str, length: str, target: int, group: str = "group_id", run_rows: int = FOLD_ROWS, fan: int = 64) -> DataFrame:
    """Adds the group of each row: a group ends before the first row that would bring it over `target`.

    `position` counts rows from 0 in order. A longer row is a group of its own, and a row of
    length 0 stays where it is unless its group is over the target. With target 0 each
    row is a group. Runs of rows are summarised in parallel for every group that could be
    open before them; summaries of `fan` runs are chained into one, level by level, until one is left; then
    what is open enters from the top down, and the runs number their groups. The driver sees none of it,
    and a task holds `fan` summaries, each of as many lines as rows that fit into a group.
    """
    if target <= 0:
        return df.withColumn(group, F.col(position).cast("long"))
    slim = df.select(F.col(position).alias("pos"), F.col(length).cast("long").alias("len")).withColumn("run", F.floor(F.col("pos") / run_rows).cast("long"))

    def summarise(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        return _as_table(table["run"][0].as_py(), summary(table["len"].to_numpy(), target))

    def chain(table: pa.Table) -> pa.Table:
        whole, parent = None, table["parent"][0].as_py()
        for _, lines in _runs(table):
            whole = lines if whole is None else chained(whole, lines, target)
        return _as_table(parent, whole)

    def enter(lines: pa.Table, state: pa.Table) -> pa.Table:
        fill, groups, out = state["open_fill"][0].as_py(), state["groups"][0].as_py(), []
        for run, mine in _runs(lines):
            out.append((run, fill, groups))
            fill, groups = mine.after(fill, groups, target)
        return pa.table(dict(zip(("run", "open_fill", "groups"), map(list, zip(*out)))))

    last = slim.agg(F.max("run")).first()[0]
    levels, count = [stage(slim.groupBy("run").applyInArrow(summarise, _LINES))], (last or 0) + 1
    parent = F.floor(F.col("run") / fan).cast("long")
    while count > fan:
        levels.append(stage(levels[-1].withColumn("parent", parent).groupBy("parent").applyInArrow(chain, _LINES)))
        count = -(-count // fan)
    opened = df.sparkSession.createDataFrame([(0, -1, 0)], "run long, open_fill long, groups long")
    for lines in reversed(levels):
        entering = opened.select(F.col("run").alias("parent"), "open_fill", "groups")
        opened = stage(lines.withColumn("parent", parent).groupBy("parent").cogroup(entering.groupBy("parent")).applyInArrow(lambda a, b: enter(a, b), "run long, open_fill long, groups long"))

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        lengths = table["len"].to_numpy()
        open_fill, groups = table["open_fill"][0].as_py(), table["groups"][0].as_py()
        upto, after = _next_starts(lengths, target)
        s = 0 if open_fill < 0 else int(np.searchsorted(upto, target - open_fill, "right"))
        starts, follow = np.zeros(len(lengths), np.int64), after.tolist()
        while s < len(lengths):
            starts[s] = 1
            s = follow[s]
        return pa.table({"pos": table["pos"], group: np.cumsum(starts) + (groups - 1)})

    numbered = slim.join(small(opened), "run").groupBy("run").applyInArrow(number, f"pos long, `{group}` long")
    return df.join(numbered.withColumnRenamed("pos", "__pos"), F.col(position) == F.col("__pos")).drop("__pos")
