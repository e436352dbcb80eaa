"""Passes over whole texts, and helpers that several operators use."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.staging import release, small, stage  # noqa: F401

#: Bytes of text that a Python worker takes at a time.
SLAB_BYTES = 2 << 20
#: Spark's own bound of the bytes in an Arrow batch, and the one that passes over texts set in its place.
_BATCH_CONF, _BATCH_DEFAULT, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def carried(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """The table with names that can't clash, its new name for each column, and the way back to the columns as they were."""
    new = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new, lambda df: df.select(*[F.col(n).alias(c) for c, n in new.items()])


def slabs(sizes: Iterable[int], limit: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about `limit`; a larger row is alone."""
    at = total = 0
    end = -1
    for end, n in enumerate(sizes):
        if total and total + n > limit:
            yield at, end
            at, total = end, 0
        total += n
    if end >= at:
        yield at, end + 1


def give_back() -> None:
    """Returns a Python worker's free memory to the system. Idle workers are kept for later stages, so
    without this each holds the most that any stage has needed, beside those that work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def per_text(
    docs: DataFrame,
    text: str,
    keep: list[str],
    added: str,
    work: Callable[[], Callable[[list], dict]],
    slab_bytes: int = SLAB_BYTES,
) -> DataFrame:
    """Adds columns that `work` derives from whole texts, in one pass and without a shuffle.

    `work()` runs once in each Python worker and returns a function from a list of
    texts (str or None, about `slab_bytes` together) to the new columns in order.
    """
    if docs.sparkSession.conf.get(_BATCH_CONF) == _BATCH_DEFAULT:  # a session's own choice stays
        docs.sparkSession.conf.set(_BATCH_CONF, _BATCH_BYTES)
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + (", " if keep else "") + added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = work()
        for batch in batches:
            texts = batch.column(len(keep))
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in slabs(sizes, slab_bytes):
                made = apply(texts.slice(a, b - a).to_pylist())
                arrays = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*arrays, *made.values()], names=[*keep, *made])
        del apply
        give_back()

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)
