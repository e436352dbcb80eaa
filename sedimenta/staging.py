"""Lineage cuts in the shared folder, and joins whose small side has been counted."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.errors import EngineError

#: A side is broadcast only if it has been counted and has at most this many rows.
BROADCAST_ROWS = 100_000

_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Where it isn't set a local session gets one of its own; on a cluster that would be a folder nobody else reads.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise EngineError("io", "spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="sedimenta-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back.

    A lost executor then costs no more than the tasks it ran, and a table that is
    used twice is computed once. The files go when `release` or the end of the
    program removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(df: DataFrame) -> None:
    """Removes the files behind a staged table that nothing reads any more."""
    _remove(getattr(df, "_staged_at", ""))


def _remove(path: str) -> None:
    if spark := _staged.pop(path, None):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_all() -> None:
    for path in list(_staged):
        try:
            _remove(path)
        except Exception:  # noqa: BLE001  the session may have gone before
            _staged.pop(path, None)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if a count shows that it is small; else Spark's own choice of join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
