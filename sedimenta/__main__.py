"""The command line: pack, unpack, list, inspect, extract, verify and capabilities, for people or as JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.config import CODECS, GROUP_TARGETS
from sedimenta.errors import EngineError
from sedimenta.operators import catalog
from sedimenta.plans import archive
from sedimenta.sources import tree


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sedimenta", description=__doc__)
    top.add_argument("--json", action="store_true", help="one JSON value for a line")
    commands = top.add_subparsers(dest="command", required=True)
    pack = commands.add_parser("pack")
    pack.add_argument("inputs", nargs="+")
    pack.add_argument("-o", "--output", required=True)
    pack.add_argument("--profile", choices=sorted(GROUP_TARGETS), default="raw")
    unpack = commands.add_parser("unpack")
    unpack.add_argument("archive")
    unpack.add_argument("-o", "--output", required=True)
    for name in ("list", "inspect", "verify"):
        commands.add_parser(name).add_argument("archive")
    extract = commands.add_parser("extract")
    extract.add_argument("archive")
    extract.add_argument("entry")
    where = extract.add_mutually_exclusive_group(required=True)
    where.add_argument("-o", "--output")
    where.add_argument("--stdout", action="store_true")
    commands.add_parser("capabilities")
    return top


def _tree(tables: dict[str, DataFrame]) -> DataFrame:
    """The rows that `tree.unpack` writes: contents of files, the paths that hardlinks share, and symlink targets."""
    entries = tables["entries"]
    owners = entries.select(F.col("entry_id").alias("__owner"), F.col("path").alias("link_path"))
    content = archive.extract(tables, F.col("kind") == "file").select("entry_id", "content")
    if "target" not in entries.columns:
        entries = entries.withColumn("target", F.lit(None).cast("string"))
    met = entries.select("entry_id", "path", "kind", "target", "target_entry_id").join(owners, F.col("target_entry_id") == F.col("__owner"), "left")
    return met.join(content, "entry_id", "left").select("path", "kind", "content", "link_path", "target")


def _pack(spark: SparkSession, inputs: list[str], output: str, profile: str) -> dict:
    # entries of the tree keep their own kind; a file whose identity came before is a hardlink
    rows = tree.with_content(tree.scan(spark, inputs).withColumnRenamed("kind", "scanned"), kind="scanned")
    made = archive.pack_tables(rows.drop("local"), profile, "identity", kind="scanned")
    archive.publish(made, output)
    return archive.manifest(spark, output)


def run(spark: SparkSession, argv: list[str], out=None) -> int:
    """Runs one command; returns 0, or 1 if verification finds a problem."""
    out = out or sys.stdout
    args = _parser().parse_args(argv)

    def say(rows, line) -> None:
        for row in rows:
            print(json.dumps(row, ensure_ascii=False, default=str) if args.json else line(row), file=out)

    if args.command == "capabilities":
        say([{"profiles": sorted(GROUP_TARGETS), "codecs": sorted(CODECS), "version": archive.VERSION}], lambda r: "\n".join(f"{k}: {v}" for k, v in r.items()))
        return 0
    if args.command == "pack":
        say([_pack(spark, args.inputs, args.output, args.profile)], lambda r: f"{args.output}: {r['rows']['entries']} entries, {r['original_bytes']} bytes")
        return 0
    archive.manifest(spark, args.archive)
    tables = archive.open_archive(spark, args.archive)
    if args.command == "list":
        shown = catalog.listing(tables["entries"]) if args.json else catalog.lines(tables["entries"])
        say((r.asDict() for r in shown.orderBy("entry_id").toLocalIterator()), lambda r: r["line"])
    elif args.command == "inspect":
        say([catalog.inspection(tables["entries"], tables["groups"]).first().asDict()], catalog.inspection_lines)
    elif args.command == "verify":
        found = archive.verify_published(spark, args.archive)
        bad = 0
        for row in found.toLocalIterator():
            say([row.asDict()], lambda r: r["problem"] if r["id"] is None else f"{r['id']}: {r['problem']}")
            bad = 1
        if not bad:
            say([{"problems": 0}], lambda r: "no problems")
        return bad
    elif args.command == "unpack":
        tree.unpack(_tree(tables), args.output)
    elif args.stdout:
        archive.write_entry(tables, F.col("path") == args.entry, getattr(out, "buffer", out))
    else:
        with open(args.output, "xb") as file:
            archive.write_entry(tables, F.col("path") == args.entry, file)
    return 0


def main() -> int:
    from sedimenta.session import session

    try:
        return run(session(), sys.argv[1:])
    except EngineError as e:
        print(f"{e.public_kind}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
