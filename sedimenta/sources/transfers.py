"""Files in which ranges of bytes are handed out: named after the time at which they go."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: names of transfer files.
NAME = r"^range-([0-9]+)-([0-9A-Za-z]+)\.bin$"


def file_name(expires_at_ms: Column, transfer_id: Column) -> Column:
    return F.concat(F.lit("range-"), expires_at_ms.cast("string"), F.lit("-"), transfer_id, F.lit(".bin"))


def listed(names: DataFrame, now_ms: Column, name: str = "name") -> DataFrame:
    """Adds expires_at_ms and due to file names; both are null where a name isn't a transfer file's."""
    at = F.when(F.col(name).rlike(NAME), F.regexp_extract(name, NAME, 1).cast("long"))
    return names.withColumn("expires_at_ms", at).withColumn("due", at <= now_ms)


def _files(spark: SparkSession, folder: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def publish(spark: SparkSession, data: bytes, folder: str, expires_at_ms: int) -> str:
    """Writes the bytes beside the folder's files under a passing name, renames them, and returns the path."""
    fs, at = _files(spark, folder)
    fs.mkdirs(at)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    name = uuid.uuid4().hex
    part = new(f"{folder}/.{name}.part")
    out = fs.create(part, False)
    out.write(bytearray(data))
    out.close()
    path = f"{folder}/range-{expires_at_ms}-{name}.bin"
    if not fs.rename(part, new(path)):
        fs.delete(part, False)
        raise OSError(path)
    return path


def clean(spark: SparkSession, folder: str, now_ms: int) -> int:
    """Removes the transfer files whose time has come; returns how many. Other files stay. For use at the start and by a timer."""
    fs, at = _files(spark, folder)
    if not fs.exists(at):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    due = listed(spark.createDataFrame([(n,) for n in names], "name string"), F.lit(now_ms)).where("due").collect()
    for row in due:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['name']}"), False)
    return len(due)
