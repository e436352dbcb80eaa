"""File trees and corpus manifests as tables, and tables back to trees."""

from __future__ import annotations

import os
import shutil
import stat
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sedimenta.errors import EngineError
from sedimenta.functions.paths import path_problem, resolves_within

TREE = "path string, kind string, size long, modified_ns long, mode long, identity string, target string, local string"


class _Listing(InputPartition):
    def __init__(self, root: str, prefix: str):
        self.root, self.prefix = root, prefix


class TreeReader(DataSourceReader):
    """A partition for each top-level folder of each input."""

    def __init__(self, inputs: list[str]):
        self.inputs = inputs

    def partitions(self) -> list[InputPartition]:
        if len(self.inputs) == 1 and os.path.isdir(self.inputs[0]):
            root = self.inputs[0]
            return [_Listing(os.path.join(root, n), n) for n in sorted(os.listdir(root))] or [_Listing("", "")]
        return [_Listing(p, os.path.basename(os.path.normpath(p))) for p in self.inputs]

    def read(self, partition: _Listing) -> Iterator[tuple]:
        if partition.root:
            yield from _walk(partition.root, partition.prefix)


def _walk(local: str, name: str) -> Iterator[tuple]:
    at = os.lstat(local)
    mode, identity = at.st_mode & 0o7777, f"{at.st_dev}:{at.st_ino}" if at.st_nlink > 1 else None
    if stat.S_ISLNK(at.st_mode):
        yield name, "symlink", 0, at.st_mtime_ns, mode, None, os.readlink(local), local
    elif stat.S_ISDIR(at.st_mode):
        yield name, "directory", 0, at.st_mtime_ns, mode, None, None, local
        for n in sorted(os.listdir(local)):
            yield from _walk(os.path.join(local, n), f"{name}/{n}")
    elif stat.S_ISREG(at.st_mode):
        yield name, "file", at.st_size, at.st_mtime_ns, mode, identity, None, local
    else:
        raise EngineError("unsupported_file_type", name)


class TreeSource(DataSource):
    """spark.read.format("sedimenta_tree").option("inputs", paths joined by os.pathsep).load()"""

    @classmethod
    def name(cls) -> str:
        return "sedimenta_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["inputs"].split(os.pathsep))


def scan(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """All files, folders and symlinks under the inputs; of one folder the children, of several each by its name."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("sedimenta_tree").option("inputs", os.pathsep.join(inputs)).load()


def with_content(files: DataFrame, kind: str = "kind") -> DataFrame:
    """Adds the bytes of files that all workers can read."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = open(row["local"], "rb").read() if row[kind] == "file" else None
                yield pa.RecordBatch.from_pylist([{**row, "data": data}], schema=pa.schema([*batch.schema, pa.field("data", pa.binary())]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{fields}, data binary")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A corpus manifest of JSON rows; other fields or malformed rows fail."""
    schema = "id string, path string, family string, source string, license string, sha256 string, notes string"
    out = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    missing = out.where("id IS NULL OR path IS NULL OR family IS NULL OR source IS NULL OR license IS NULL")
    if missing.limit(1).count():
        raise EngineError("invalid_metadata", "a manifest row lacks a field")
    return out


def unpack_problems(rows: DataFrame) -> DataFrame:
    """path and problem of entries that must not be written: unsafe or repeated paths, and links that lead out of the tree."""
    path, kind = F.col("path"), F.col("kind")
    linked = path_problem(F.col("link_path"), devices=False)
    climbs = ~F.coalesce(resolves_within(path, F.col("target")), F.lit(False)) | F.col("target").contains("\0")
    problem = F.coalesce(path_problem(path, devices=False), F.when((kind == "hardlink") & linked.isNotNull(), "link"), F.when((kind == "symlink") & climbs, "target"))
    bad = rows.select("path", problem.alias("problem")).where("problem IS NOT NULL")
    twice = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("twice").alias("problem"))
    return bad.unionByName(twice)


def unpack(rows: DataFrame, target: str) -> None:
    """Writes entries (path, kind, content, link_path, target) as a tree: folders, files, hardlinks, symlinks, in a
    folder beside the target that is renamed at the end. An existing target fails and nothing is left behind.

    Rows are checked before anything is written: see `unpack_problems`. Symlinks come last, so no file is written
    through one. The target must lie where all workers and the driver write to the same folder; that all files
    have arrived there is checked before the rename.
    """
    if os.path.lexists(target):
        raise EngineError("output_exists", target)
    if bad := unpack_problems(rows).limit(1).collect():
        raise EngineError("unsafe_path", f"{bad[0]['path']!r}: {bad[0]['problem']}")
    staging = tempfile.mkdtemp(prefix=".unpack-", dir=os.path.dirname(os.path.abspath(target)))
    try:
        for row in rows.where("kind = 'directory'").select("path").toLocalIterator():
            os.makedirs(os.path.join(staging, row["path"]), exist_ok=True)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at = os.path.join(staging, path)
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    with open(at, "wb") as f:
                        f.write(content or b"")
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

        written = rows.where("kind = 'file'").select("path", F.col("content").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
        if written != sum(len(files) for _, _, files in os.walk(staging)):
            raise EngineError("io", "the workers write to another folder than the driver's")
        for kind, make in (("hardlink", lambda r, at: os.link(os.path.join(staging, r["link_path"]), at)), ("symlink", lambda r, at: os.symlink(r["target"], at))):
            for row in rows.where(F.col("kind") == kind).select("path", "link_path", "target").toLocalIterator():
                at = os.path.join(staging, row["path"])
                os.makedirs(os.path.dirname(at), exist_ok=True)
                make(row, at)
        os.rename(staging, target)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
