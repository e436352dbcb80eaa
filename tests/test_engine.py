"""Operators and whole plans on small tables."""

import io
import json
import os
import random
import stat
import struct
import time

import pytest
from pyspark.sql import functions as F

from sedimenta import __main__ as command
from sedimenta.config import Chunking
from sedimenta.errors import EngineError
from sedimenta.functions import records
from sedimenta.functions.hashing import blake3, crc32c
from sedimenta.functions.kernels import cut_points
from sedimenta.operators import catalog, chunking, codecs, fingerprints, grouping, integrity, jobs, packing, sections
from sedimenta.operators.ordered import lagged, next_fit, ordered
from sedimenta.plans import archive
from sedimenta.plans.inputs import commands
from sedimenta.sources import transfers, tree
from sedimenta.streaming import joblog

MIB = 1 << 20


def test_ordered_with_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [(i, "hot" if rnd.random() < 0.7 else rnd.choice("abc"), rnd.randrange(5)) for i in range(500)] + [(500, None, 1), (501, None, 2)]
    df = spark.createDataFrame(rows, "i long, k string, n long").repartition(7)
    got = {r["i"]: (r["no"], r["before"]) for r in ordered(df, ["i"], number="no", sums={"before": "n"}, keys=["k"]).collect()}
    count, total, want = {}, {}, {}
    for i, k, n in rows:
        want[i] = (count.get(k, 0), total.get(k, 0))
        count[k], total[k] = count.get(k, 0) + 1, total.get(k, 0) + n
    assert got == want


@pytest.mark.parametrize("target", [0, 7, 40, 10_000])
def test_next_fit_across_runs(spark, target):
    rnd = random.Random(target)
    lengths = [rnd.choice([0, 0, 1, 3, 9, 50]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lengths)), "pos long, len long").repartition(5)
    got = [r["group_id"] for r in next_fit(df, "pos", "len", target, run_rows=11, fan=3).orderBy("pos").collect()]
    want, fill = [], None
    for n in lengths:
        new = fill is None or target == 0 or fill + n > target
        fill = n if new else fill + n
        want.append((want[-1] if want else -1) + new)
    assert got == want


def test_group_planner_fixtures(spark):
    def plan(profile, lengths):
        rows = spark.createDataFrame(list(enumerate(lengths)), "entry_id long, size long")
        return [(r["first_entry"], r["chunk_count"], r["uncompressed_len"]) for r in grouping.group_table(grouping.grouped(rows, profile)).orderBy("group_id").collect()]

    assert plan("stream", [2 * MIB, 2 * MIB, 1, 5 * MIB, 1]) == [(0, 2, 4 * MIB), (2, 1, 1), (3, 1, 5 * MIB), (4, 1, 1)]
    assert plan("raw", [3, 0, 5]) == [(0, 1, 3), (1, 1, 0), (2, 1, 5)]
    assert plan("stream", [3, 0, 5]) == [(0, 3, 8)]


def test_estimates_rise_with_the_profile(spark):
    measure = spark.createDataFrame([(128 * MIB, 32, MIB)], "bytes long, entries long, max_file long")
    got = {r["profile"]: r["memory_bytes"] for r in grouping.estimates(measure, grouping.profiles(spark)).collect()}
    order = [got[p] for p in ("raw", "stream", "random", "balanced", "archive_max")]
    assert order == sorted(set(order))


def test_chunk_drafts(spark):
    sizes = spark.createDataFrame([(1, 0, 2 * MIB + 17), (2, 0, 2 * MIB), (3, 0, 0)], "entry_id long, object_id long, size long")
    fixed = chunking.fixed(sizes)
    assert [(r["entry_id"], r["length"]) for r in fixed.orderBy("entry_id", "logical_offset").collect()] == [(1, MIB), (1, MIB), (1, 17), (2, MIB), (2, MIB)]
    assert all(r["covered"] for r in chunking.coverage(fixed, sizes).collect())
    broken = fixed.withColumn("length", F.when(F.col("logical_offset") == MIB, F.col("length") - 1).otherwise(F.col("length")))
    assert {r["entry_id"]: r["covered"] for r in chunking.coverage(broken, sizes).collect()} == {1: False, 2: False, 3: True}
    ids = {tuple(r)[:3]: r["chunk_id"] for r in chunking.with_ids(fixed.repartition(3)).collect()}
    assert ids == {tuple(r)[:3]: r["chunk_id"] for r in chunking.with_ids(fixed.orderBy(F.rand(3))).collect()} and sorted(ids.values()) == list(range(5))


def test_boundary_problems(spark):
    rows = [(1, 9, [3, 9]), (2, 9, [3, 3, 9]), (3, 9, [5, 4, 9]), (4, 9, [3, 12]), (5, 9, [0, 9]), (6, 9, []), (7, 9, [9])]
    got = {r["entry_id"]: r["problem"] for r in chunking.boundary_problems(spark.createDataFrame(rows, "entry_id long, size long, ends array<long>")).collect()}
    assert got == {1: None, 2: "not increasing", 3: "not increasing", 4: "not the size", 5: "not positive", 6: "empty", 7: None}


def test_pages_cut_like_the_whole(spark):
    small = Chunking(minimum=256, average=1024, maximum=4096)
    data = random.Random(2).randbytes(60_000)
    whole = spark.createDataFrame([(1, 0, bytearray(data)), (2, 0, bytearray(b""))], "entry_id long, object_id long, data binary")
    want = sorted(map(tuple, chunking.content_defined(whole, small).collect()))
    for size in (700, 9_000, 60_000):
        pages = spark.createDataFrame([(1, 0, k, bytearray(data[k : k + size])) for k in range(0, len(data), size)], "entry_id long, object_id long, page long, data binary")
        assert sorted(map(tuple, chunking.content_defined_pages(pages, small).collect())) == want
    regions = spark.createDataFrame([(1, 0, 0, 3000, bytearray(data[:3000])), (1, 0, 3000, 30_000, bytearray(data[3000:30_000]))], "entry_id long, object_id long, start long, end long, data binary")
    cut = chunking.structural(regions, small, "data").collect()
    assert {r["method"] for r in cut} == {"Structural"} and sum(r["length"] for r in cut) == 30_000 and len(cut) > 5


def test_escalation(spark):
    rows = spark.createDataFrame([(9, bytearray(b"same")), (2, bytearray(b"other")), (5, bytearray(b"same"))], "chunk_id long, data binary")
    prints = fingerprints.computed(rows)
    assert {r["chunk_id"] for r in fingerprints.escalated(prints).where("full_blake3 IS NOT NULL").collect()} == {5, 9}
    assert fingerprints.mismatches(prints, rows.withColumn("data", F.when(F.col("chunk_id") == 2, F.lit(b"othes")).otherwise(F.col("data")))).collect()[0]["chunk_id"] == 2
    classes = fingerprints.similar(prints.unionByName(prints.where("chunk_id = 2").withColumn("chunk_id", F.lit(7).cast("long"))))
    assert {tuple(r) for r in classes.collect()} == {(2, 2, 1), (7, 2, 1), (5, 5, 1), (9, 5, 1)}


def _inputs(spark, rows):
    full = [(i, p, s, t, m, iso, f, "", "", k) for i, p, s, t, m, iso, f, k in rows]
    df = spark.createDataFrame(full, "entry_id long, path string, size long, modified_ns long, mode long, requires_isolated_access boolean, f long, path_prefix_key string, extension_key string, k long")
    return df.withColumn("family_key", F.col("f").cast("decimal(20,0)")).withColumn("similarity_key", F.col("k").cast("decimal(20,0)")).drop("f", "k")


def test_micro_file_metadata(spark):
    inputs = _inputs(spark, [(10, "src/a.txt", 0, 100, 0o644, False, 1, 1), (11, "src/ab.txt", 5, 120, 0o600, False, 1, 1), (12, "src/abc.txt", 7, 90, 0o644, False, 1, 1)])
    members = packing.packed(inputs)
    rows = packing.with_metadata(members).orderBy("ordinal").collect()
    assert [r["entry_id"] for r in rows] == [11, 10, 12]
    assert [int(r["modified_ns_delta"]) for r in rows] == [30, 10, 0] and [r["mode_index"] for r in rows] == [0, 1, 1] and [r["content_offset"] for r in rows] == [0, 5, 5]
    coded = packing.front_coded(members)
    assert [r["path"] for r in packing.expanded(coded).orderBy("ordinal").collect()] == ["src/ab.txt", "src/a.txt", "src/abc.txt"]
    assert packing.pack_problems(members, packing.headers(members)).count() == 0


def test_micro_file_eligibility_and_times(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    inputs = _inputs(spark, [(1, "a", 65_536, low, 1, False, 1, 1), (2, "b", 65_535, high, 1, False, 1, 1), (4, "d", 65_536, 0, 1, True, 1, 1), (5, "e", 65_537, 0, 1, False, 1, 1)])
    assert {r["entry_id"]: r["reason"] for r in packing.excluded(inputs).collect()} == {4: "requires_isolated_access", 5: "too_large"}
    assert max(int(r["modified_ns_delta"]) for r in packing.with_metadata(packing.packed(inputs)).collect()) == (1 << 64) - 1
    many = _inputs(spark, [(i, f"f{i:02}", 65_536, 0, 1, False, 1, 1) for i in range(33)])
    assert [r["uncompressed_len"] for r in packing.headers(packing.packed(many, Chunking(pack_target=MIB))).orderBy("pack_id").collect()] == [MIB, MIB, 65_536]


def _files(spark):
    rows = [("b/x.txt", 3, b"abc"), ("a.txt", 0, b""), ("b/y.txt", 3, b"abc"), ("zz.bin", 4000, b"\x00\x01" * 2000), ("b/long.txt", 9000, b"compressible " * 692 + b"abcd")]
    return spark.createDataFrame([(p, len(d), 5, 420, bytearray(d)) for p, _, d in rows], "path string, size long, modified_ns long, mode long, data binary").withColumn("digest", F.sha2("data", 256))


@pytest.mark.parametrize("profile", ["raw", "stream", "balanced"])
def test_archive_round_trip(spark, tmp_path, profile):
    files = _files(spark)
    at = str(tmp_path / "archive")
    archive.publish(archive.pack_tables(files, profile, "digest"), at)
    opened = archive.open_archive(spark, at)
    assert archive.verify(opened).collect() == []
    kinds = {r["path"]: r["kind"] for r in catalog.listing(opened["entries"]).collect()}
    assert kinds["b/y.txt"] == "hardlink" and sum(k == "file" for k in kinds.values()) == 4
    got = {r["path"]: bytes(r["content"]) for r in archive.extract(opened, F.lit(True)).collect()}
    assert got == {r["path"]: bytes(r["data"]) for r in files.collect()}
    with pytest.raises(EngineError):
        archive.publish(opened, at)
    with pytest.raises(EngineError):
        archive.open_archive(spark, str(tmp_path / "none"))


def test_verification_sees_damage(spark):
    made = archive.pack_tables(_files(spark), "stream", "digest")
    bad = {**made, "entries": made["entries"].withColumn("blake3", F.when(F.col("path") == "zz.bin", F.lit(b"x")).otherwise(F.col("blake3")))}
    assert {r["problem"] for r in archive.verify(bad).collect()} == {"hash"}
    torn = {**made, "payload": made["payload"].withColumn("payload", F.concat("payload", F.lit(b"!")))}
    with pytest.raises(Exception, match="checksum_mismatch"):
        archive.verify(torn).collect()
    fewer = {**made, "restore_map": made["restore_map"].where("entry_id <> 0")}
    assert "missing" in {r["problem"] for r in archive.verify(fewer).collect()}


def test_many_small_groups_are_checked_together(spark):
    """4,000 files of a group each: hashed one at a time they take over ten seconds on four cores."""
    n = 4000
    rows = spark.range(0, n, 1, 4).select(F.col("id").alias("entry_id"), F.col("id").alias("group_id"), F.encode(F.concat(F.lit("file " * 500), F.col("id")), "UTF-8").alias("data"))
    groups = codecs.encoded(rows.select("group_id", "data"), "raw").localCheckpoint()
    places = rows.select("entry_id", "group_id", F.lit(0).cast("long").alias("group_offset"), F.octet_length("data").cast("long").alias("length"))
    began = time.time()
    got = {r["entry_id"]: (bytes(r["content"]), bytes(r["blake3"])) for r in codecs.members(groups, places).collect()}
    assert time.time() - began < 10
    assert len(got) == n and all(got[i][0] == b"file " * 500 + b"%d" % i for i in range(n))
    assert all(got[i][1] == blake3(b"file " * 500 + b"%d" % i) for i in range(0, n, 400))
    bad = groups.withColumn("payload", F.when(F.col("group_id") == 7, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="checksum_mismatch.*group 7"):
        codecs.members(bad, places).collect()


def test_reads_are_verified(spark):
    """A place that leads to other bytes, or an entry whose hash differs, never hands out bytes."""
    made = {n: t.cache() for n, t in archive.pack_tables(_files(spark), "stream", "digest").items()}
    out = io.BytesIO()
    assert archive.write_entry(made, F.col("path") == "b/x.txt", out) == 3 and out.getvalue() == b"abc"
    with pytest.raises(EngineError):
        archive.write_entry(made, F.col("path") == "none", out)
    row = archive.read_range(made, F.col("path") == "zz.bin", 2, 4).first()
    assert bytes(row["slice"]) == b"\x00\x01" * 2
    moved = {**made, "restore_map": made["restore_map"].withColumn("group_offset", F.when(F.col("length") == 4000, F.col("group_offset") - 1).otherwise(F.col("group_offset")))}
    flipped = {**made, "entries": made["entries"].withColumn("blake3", F.when(F.col("path") == "zz.bin", F.lit(bytes(32))).otherwise(F.col("blake3")))}
    for bad in (moved, flipped):
        with pytest.raises(Exception, match="checksum_mismatch"):
            archive.extract(bad, F.col("path") == "zz.bin").collect()
        with pytest.raises(Exception, match="checksum_mismatch"):
            archive.read_range(bad, F.col("path") == "zz.bin", 0, 1).collect()
        assert bytes(archive.extract(bad, F.col("path") == "b/x.txt").first()["content"]) == b"abc"


def test_paths_occur_once(spark):
    with pytest.raises(EngineError, match="duplicate_path"):
        archive.pack_tables(_files(spark).unionByName(_files(spark)), "stream")


@pytest.mark.parametrize(
    "row",
    [
        ("../evil.txt", "file", b"x", None, None), ("/tmp/evil-absolute.txt", "file", b"x", None, None), ("a/../../evil", "file", b"x", None, None), ("", "file", b"x", None, None), ("a\0b", "file", b"x", None, None),
        ("../dir", "directory", None, None, None), ("link", "symlink", None, None, "/etc/passwd"), ("a/link", "symlink", None, None, "../../out"), ("link", "symlink", None, None, None), ("hard", "hardlink", None, "../outside", None), ("fine.txt", "file", b"again", None, None),
    ],
)
def test_unpack_stays_inside(spark, tmp_path, row):
    rows = spark.createDataFrame([("fine.txt", "file", b"ok", None, None), row], "path string, kind string, content binary, link_path string, target string")
    (tmp_path / "in").mkdir()
    with pytest.raises(EngineError, match="unsafe_path"):
        tree.unpack(rows, str(tmp_path / "in/out"))
    assert sorted(p.name for p in tmp_path.rglob("*")) == ["in"] and not os.path.exists("/tmp/evil-absolute.txt")


def test_unpack_keeps_links_inside(spark, tmp_path):
    rows = [("d/f", "file", b"one", None, None), ("d/h", "hardlink", None, "d/f", None), ("d/s", "symlink", None, None, "../d/f")]
    tree.unpack(spark.createDataFrame(rows, "path string, kind string, content binary, link_path string, target string"), str(tmp_path / "out"))
    assert (tmp_path / "out/d/h").read_bytes() == (tmp_path / "out/d/s").read_bytes() == b"one"


def test_long_regions_need_their_bytes(spark):
    long = spark.createDataFrame([(1, 0, 0, 5 * MIB)], "entry_id long, object_id long, start long, end long")
    with pytest.raises(Exception, match="longer than the maximum"):
        chunking.structural(long).collect()


def test_batches_refuse_what_is_unclear(spark):
    rows = spark.createDataFrame([(1, b"a"), (2, b""), (1, b"b")], "chunk_id long, data binary")
    with pytest.raises(EngineError, match="more than once"):
        fingerprints.batch(rows)
    assert fingerprints.batch(rows.where("chunk_id = 2")).first()["length"] == 0
    with pytest.raises(Exception, match="no bytes"):
        fingerprints.computed(rows.withColumn("data", F.lit(None).cast("binary"))).collect()
    sized = spark.createDataFrame([(k,) for k in range(1, 13)], "length long")
    assert fingerprints.working_set(sized).first()[0] == sum(range(5, 13))


def test_group_bytes_in_order(spark):
    rows = [(g, i * 3, 10 * g + i, bytes([65 + i]) * 3) for g in range(3) for i in range(20)] + [(7, 0, 99, b"")]
    got = {r["group_id"]: bytes(r["data"]) for r in codecs.group_bytes(spark.createDataFrame(rows, "group_id long, group_offset long, entry_id long, data binary").repartition(5)).collect()}
    assert got == {**{g: b"".join(bytes([65 + i]) * 3 for i in range(20)) for g in range(3)}, 7: b""}


def test_listing_is_pruned(spark, tmp_path):
    at = str(tmp_path / "archive")
    archive.publish(archive.pack_tables(_files(spark), "stream"), at)
    plan = catalog.listing(archive.open_archive(spark, at)["entries"])._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in plan and "blake3" not in plan


def test_ranges(spark):
    rows = spark.createDataFrame([(1, bytearray(b"0123456789"))], "id long, content binary")
    assert bytes(catalog.read_range(rows, 3, 4).first()["slice"]) == b"3456"
    with pytest.raises(Exception, match="invalid_range"):
        catalog.read_range(rows, 8, 4).collect()


def test_trees(spark, tmp_path):
    root = tmp_path / "in"
    (root / "d/e").mkdir(parents=True)
    (root / "d/ü.txt").write_bytes(b"one")
    (root / "empty").write_bytes(b"")
    os.link(root / "d/ü.txt", root / "hard.txt")
    os.symlink("d/ü.txt", root / "soft")
    found = tree.with_content(tree.scan(spark, [str(root)]))
    made = {r["path"]: r for r in catalog.entries(found, "identity").collect()}
    assert {p: r["kind"] for p, r in found.select("path", F.struct("kind")).rdd.map(lambda r: (r[0], r[1])).collect() if r["kind"] != "file"} == {"d": "directory", "d/e": "directory", "soft": "symlink"}
    assert made["hard.txt"]["target_entry_id"] is None or made["d/ü.txt"]["target_entry_id"] is None
    out = str(tmp_path / "out")
    rows = found.withColumn("content", F.col("data")).withColumn("link_path", F.lit(None).cast("string"))
    tree.unpack(rows, out)
    assert (tmp_path / "out/d/ü.txt").read_bytes() == b"one" and os.readlink(f"{out}/soft") == "d/ü.txt" and stat.S_ISDIR(os.stat(f"{out}/d/e").st_mode)
    with pytest.raises(EngineError):
        tree.unpack(rows, out)


def test_registry_rules(spark):
    rows = spark.createDataFrame([(1, 0, True), (1, 1, True), (0, 2, True), (9, 77, True), (10, 78, False)], "chain_id int, codec_id int, required boolean")
    assert {(r["chain_id"], r["problem"]) for r in grouping.registry_problems(rows).collect()} == {(1, "duplicate"), (0, "reserved"), (9, "unknown")}


def test_choice_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(1, "zstd", 1, 10, 78), (1, "store", 0, 10, 78), (2, "store", 0, 30, 98), (2, "zstd", 1, 9, 77)], "group_id long, codec string, codec_id int, compressed_len long, total_cost long")
    assert {r["group_id"]: r["codec"] for r in codecs.chosen(rows).collect()} == {1: "store", 2: "zstd"}


def test_links_inside_the_root(spark):
    rows = spark.createDataFrame([(1, "a/b/l", "../../x"), (2, "a/l", "../../x"), (3, "l", "/x"), (4, "a/l", "../../a/x")], "entry_id long, path string, target string")
    assert {r["id"] for r in integrity.symlink_problems(rows).collect()} == {2, 3, 4}


def test_stream_equals_batch(spark, tmp_path):
    rows = commands(spark, "/root/testdata/sf0.001").select(F.concat_ws(":", "owner", "job_no").alias("job"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "command")
    files = str(tmp_path / "in")
    ordered_rows = rows.orderBy("ts", "event_id").collect()
    for k in range(3):
        part = ordered_rows[k * len(ordered_rows) // 3 : (k + 1) * len(ordered_rows) // 3]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(files)
        # each start goes on from the checkpoint of the one before
        stream = spark.readStream.schema(rows.schema).parquet(files)
        joblog.run_available(joblog.job_states(stream, late="365 days"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("job").agg(F.max_by("state", "sequence").alias("state"), F.count("*").alias("n")).collect()
    batch = jobs.applied(rows, ["job"], ["ts", "event_id"]).groupBy("job").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n")).collect()
    assert {r["job"]: (r["state"], r["n"]) for r in got} == {r["job"]: (r["state"], r["n"]) for r in batch}


def test_bucket_refills(spark):
    rows = spark.createDataFrame([(1, t) for t in (10, 10, 10, 1010, 1011)], "c long, t long")
    out = jobs.rate_limited(rows, ["c"], ["t"], "t", rate=1, burst=2).orderBy("t").collect()
    assert [r["allowed"] for r in out] == [True, True, False, True, False]


def test_lanes_take_turns(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate("aaabbc")], "n long, session string")
    assert [r["session"] for r in jobs.lane_order(rows, ["n"]).orderBy("turn").collect()] == list("abcaba")


def test_fair_order(spark):
    rows = [(i, "interactive_read", "a") for i in range(32)] + [(40, "interactive_read", "b"), (41, "benchmark", "c"), (42, "verify_requested", "d")]
    out = [(r["n"], r["session"]) for r in jobs.fair_order(spark.createDataFrame(rows, "n long, priority string, session string"), ["n"]).orderBy("place").collect()]
    # eight of the first lane, of which the other session has the second turn, then one each of the lanes below
    assert out[:10] == [(0, "a"), (40, "b"), *((i, "a") for i in range(1, 7)), (42, "d"), (41, "c")]
    assert out[10:] == [(i, "a") for i in range(7, 32)]


def test_before_in_a_hot_key(spark):
    rows = [(i, "hot" if i % 5 else "rare", None if i % 7 == 0 else i) for i in range(400)]
    got = {r["i"]: r["b"] for r in lagged(spark.createDataFrame(rows, "i long, k string, v long").repartition(6), ["k"], ["i"], "v", "b").collect()}
    last, want = {}, {}
    for i, k, v in rows:
        want[i], last[k] = last.get(k), v
    assert got == want


def test_requests_are_checked(spark):
    good = '{"jsonrpc":"2.0","id":"1","method":"submit","params":{"a":"[[[["}}'
    deep = '{"jsonrpc":"2.0","id":"1","method":"submit","params":' + "[" * 70 + "]" * 70 + "}"
    cases = {good: None, deep: "too deep", good.replace('"id":"1"', '"id":""'): "id", good.replace('"1"', f'"{"x" * 200}"'): "id", good.replace("submit", "drop"): "method", good[:-1]: "syntax"}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r["raw"]: r["p"] for r in rows.select("raw", jobs.request_problem(F.col("raw"), ("submit",)).alias("p")).collect()} == cases


def test_dependency_levels(spark):
    tasks = spark.createDataFrame([(i,) for i in range(4)], "task long")
    edges = spark.createDataFrame([(1, 0), (2, 1), (2, 0)], "task long, needs long")
    assert {r["task"]: r["level"] for r in jobs.levels(edges, tasks).collect()} == {0: 0, 3: 0, 1: 1, 2: 2}
    with pytest.raises(EngineError):
        jobs.levels(edges.unionByName(spark.createDataFrame([(0, 2)], "task long, needs long")), tasks).count()


_HEADER = {"major": 0, "minor": 1, "header_len": 96, "flags": 0, "original_total_size": 5_000_000_000, "entry_count": 7, "logical_chunk_count": 3, "group_count": 2, "section_directory_offset": 96, "footer_offset": 1 << 40, "section_count": 6}


def test_records_are_packed_like_structs(spark):
    one = spark.createDataFrame([(bytearray(range(16)), bytearray(32))], "archive_id binary, root binary")
    numbers = {n: F.lit(v) for n, v in _HEADER.items()}
    got = bytes(one.select(records.encoded(records.HEADER, {**numbers, "archive_id": F.col("archive_id")}).alias("r")).first()["r"])
    want = b"UDOC\r\n\x1a\n" + struct.pack("<HHIQ16s6Q", 0, 1, 96, 0, bytes(range(16)), 5_000_000_000, 7, 3, 2, 96, 1 << 40)
    assert got == want + struct.pack("<II", crc32c(want + struct.pack("<I", 6)), 6)
    footer = one.select(records.encoded(records.FOOTER, {"archive_length": F.lit(99), "blake3_root": F.col("root"), "directory_crc32c": F.lit((1 << 32) - 1), "version": F.lit(1)}).alias("r")).first()["r"]
    want = b"UFTR" + struct.pack("<Q32sIII", 99, bytes(32), (1 << 32) - 1, 1, 0)
    assert bytes(footer) == want + struct.pack("<II", crc32c(want + bytes(4)), 0)
    codec = one.select(records.encoded(records.CODEC, {"chain_id": F.lit(1), "codec_id": F.lit(3), "codec_version": F.lit(1), "level": F.lit(-5), "flags": F.lit(1)}).alias("r")).first()["r"]
    assert bytes(codec) == struct.pack("<IHHiI", 1, 3, 1, -5, 1)
    back = lambda layout, data: spark.createDataFrame([(data,)], "r binary").select(records.decoded(layout, F.col("r")).alias("d")).first()["d"]
    told = back(records.HEADER, bytearray(got)).asDict()
    assert {n: told[n] for n in _HEADER} == _HEADER and bytes(told["archive_id"]) == bytes(range(16))
    assert back(records.CODEC, codec)["level"] == -5 and back(records.CODEC, None) is None
    for bad, problem in ((got[:-1], "invalid_range"), (b"X" + got[1:], "invalid_magic"), (got[:50] + b"\xff" + got[51:], "checksum_mismatch")):
        with pytest.raises(Exception, match=problem):
            back(records.HEADER, bytearray(bad))
    with pytest.raises(Exception, match="integer_overflow"):
        one.select(records.encoded(records.CODEC, {"chain_id": F.lit(1), "codec_id": F.lit(1 << 16), "codec_version": F.lit(1), "level": F.lit(0), "flags": F.lit(1)})).collect()


def test_sections_are_checked(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "entry_id long, path string")
    bodies = sections.json_body(rows, ["entry_id"]).select(F.lit(2).alias("section_type"), "data").unionByName(spark.createDataFrame([(6, bytearray(b"payload"))], "section_type int, data binary")).cache()
    told = sections.directory(bodies).cache()
    assert [(r["offset"], r["length"]) for r in told.orderBy("section_type").collect()] == [(160, 80), (240, 7)]
    assert [tuple(r) for r in sections.json_rows(sections.checked(bodies, told), 2, "entry_id long, path string").collect()] == [(1, "a"), (2, "b"), (3, None)]
    for bad, problem in ((bodies.withColumn("data", F.concat("data", F.lit(b" "))), "checksum_mismatch"), (bodies.where("section_type = 2"), "missing_section")):
        with pytest.raises(Exception, match=problem):
            sections.checked(bad, told).collect()
    with pytest.raises(EngineError, match="duplicate_section"):
        sections.directory(bodies.unionByName(bodies))
    with pytest.raises(Exception, match="invalid_range"):
        sections.ranges(bodies, ["section_type"], F.lit(0), F.lit(8)).collect()
    assert [r["crc32c"] for r in sections.ranges(bodies.where("section_type = 6"), ["section_type"], F.lit(3), F.lit(4)).collect()] == [crc32c(b"load")]


#: Small enough for regions of some hundred bytes to be cut.
_SMALL = Chunking(minimum=64, average=128, maximum=256)


def test_structural_pages_equal_the_whole(spark, monkeypatch):
    monkeypatch.setattr(chunking, "_SPAN", 512)
    rnd = random.Random(3)
    whole, pages, ends, want = [], [], [], set()
    for entry in range(6):
        data = rnd.randbytes(rnd.choice([0, 100, 900, 6000]) if entry else 7000)
        at = sorted(rnd.sample(range(1, len(data)), min(3, len(data) // 60))) if data else []
        ends.append((entry, 0, [*at, len(data)] if data else []))
        cuts = [0, *sorted(rnd.randrange(len(data) + 1) for _ in range(9)), len(data)]
        pages += [(entry, 0, i, bytearray(data[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        for a, b in zip([0, *ends[-1][2]], ends[-1][2]):
            stops = [b - a] if b - a <= _SMALL.maximum else cut_points(data[a:b], _SMALL)
            want |= {(entry, 0, a + x, y - x, "Structural") for x, y in zip([0, *stops], stops)}
    frame = spark.createDataFrame(pages, "entry_id long, object_id long, page long, data binary").repartition(5)
    marks = spark.createDataFrame(ends, "entry_id long, object_id long, ends array<long>")
    got = [tuple(r) for r in chunking.structural_pages(frame, marks, _SMALL).collect()]
    assert set(got) == want and len(got) == len(want)
    short = marks.withColumn("ends", F.when(F.col("entry_id") == 0, F.concat("ends", F.array(F.lit(7001).cast("long")))).otherwise(F.col("ends")))
    long = marks.withColumn("ends", F.when(F.col("entry_id") == 0, F.slice("ends", 1, F.size("ends") - 1)).otherwise(F.col("ends")))
    falling = marks.withColumn("ends", F.when(F.col("entry_id") == 0, F.reverse("ends")).otherwise(F.col("ends")))
    for bad, problem in ((short, "short pages"), (long, "trailing bytes"), (falling, "structural boundaries"), (marks.where("entry_id <> 0"), "trailing bytes")):
        with pytest.raises(Exception, match=problem):
            chunking.structural_pages(frame, bad, _SMALL).collect()


def test_fingerprints_of_pages(spark):
    chunks = spark.createDataFrame([(1, 2500), (2, 0), (3, 1000)], "chunk_id long, length long")
    data = {1: random.Random(1).randbytes(2500), 2: b"", 3: bytes(1000)}
    pages = spark.createDataFrame([(k, i, bytearray(v[i * 700 : (i + 1) * 700])) for k, v in data.items() for i in range(4)], "chunk_id long, page long, data binary").repartition(3)
    whole = fingerprints.computed(spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "chunk_id long, data binary"))
    assert sorted(map(str, fingerprints.computed_pages(chunks, pages).collect())) == sorted(map(str, whole.collect()))
    for bad, problem in ((pages.where("NOT (chunk_id = 1 AND page = 2)"), "is short"), (pages.unionByName(pages.where("chunk_id = 3 AND page = 1")), "trailing"), (pages.unionByName(pages.where("chunk_id = 3").withColumn("chunk_id", F.lit(9).cast("long"))), "isn't listed")):
        with pytest.raises(Exception, match=problem):
            fingerprints.computed_pages(chunks, bad).collect()
    with pytest.raises(Exception, match="resource_limit"):
        fingerprints.computed_pages(chunks.withColumn("length", F.lit(5 * MIB).cast("long")), pages).collect()


def test_batch_budget(spark):
    chunks = spark.createDataFrame([(100,), (5000,)], "length long")
    held = 2 * 176 + 2 * (5000 + 576 + 12 * 80 + 65536)
    assert fingerprints.batch_budget(chunks).first()["held_bytes"] == held
    assert fingerprints.batch_budget(chunks.where("false")).first()["held_bytes"] == 0
    with pytest.raises(Exception, match="resource_limit"):
        fingerprints.batch_budget(chunks, most_bytes=held - 1).collect()


@pytest.mark.parametrize(("retained", "per_owner"), [(5, 2), (100, 3), (1, 1)])
def test_submission_caps_against_a_walk(spark, retained, per_owner):
    rnd = random.Random(retained)
    rows = [(i, rnd.randrange(4), rnd.randrange(5), rnd.randrange(2)) for i in range(120)]
    jobs_, want = {}, []
    for _, owner, key, params in rows:
        if (owner, key) in jobs_:
            want.append("replay" if jobs_[owner, key] == params else "conflict")
        elif len(jobs_) >= retained:
            want.append("retention")
        elif sum(o == owner for o, _ in jobs_) >= per_owner:
            want.append("quota")
        else:
            jobs_[owner, key] = params
            want.append("accepted")
    frame = spark.createDataFrame(rows, "seq long, owner long, idempotency_key long, params long").repartition(5)
    assert [r["outcome"] for r in jobs.capped(frame, ["seq"], retained, per_owner).orderBy("seq").collect()] == want


def test_sessions_rotate_their_tokens(spark):
    rows = [(0, "resume", "a", "b", 1), (1, "create", None, "a", 2), (2, "create", None, "x", 3), (3, "resume", "x", "y", 4), (4, "resume", "a", "b", 5), (5, "resume", "a", "c", 6), (6, "resume", "b", "c", 14), (7, "resume", "c", "d", 24), (8, "create", None, "e", 25)]
    frame = spark.createDataFrame([(n, "s", *r) for n, *r in rows], "n long, session string, action string, token string, next_token string, now_ms long")
    got = [r["outcome"] for r in jobs.session_log(frame, ["n"], ttl_ms=10).orderBy("n").collect()]
    assert got == ["denied", "created", "denied", "denied", "resumed", "denied", "resumed", "denied", "created"]
    live = spark.createDataFrame([(1,), (2,), (99,)], "created_ms long")
    assert tuple(jobs.session_capacity(live, F.lit(100), most=1).first()) == (3, True)


def test_publication_is_recorded_once(spark):
    rows = [("running", True, None, "a"), ("running", True, "a", "a"), ("cancelling", True, "a", "b"), ("queued", True, None, "a"), ("running", False, None, "a"), ("running", None, None, "a"), ("running", True, None, None)]
    got = jobs.published(spark.createDataFrame(rows, "state string, was_absent boolean, recorded string, seen string")).collect()
    assert [(r["outcome"], r["recorded_after"]) for r in got] == [("recorded", "a"), ("unchanged", "a"), ("integrity_mismatch", "a"), ("conflict", None), ("internal", None), ("internal", None), ("internal", None)]


def test_pieces_are_checked(spark):
    whole = spark.createDataFrame([(1, bytearray(b"0123456789")), (2, bytearray())], "id long, content binary")
    parts = catalog.pieces(whole, 4).cache()
    row = catalog.rejoined(parts, "id").collect()
    assert [(r["id"], bytes(r["content"]), r["pieces"]) for r in row] == [(1, b"0123456789", 3)]
    with pytest.raises(Exception, match="checksum_mismatch"):
        catalog.rejoined(parts.withColumn("content", F.reverse(F.hex("content")).cast("binary")), "id").collect()
    with pytest.raises(Exception, match="invalid_range"):
        catalog.rejoined(parts.where("offset <> 4"), "id").collect()


def test_transfer_files_go_in_time(spark, tmp_path):
    at = str(tmp_path / "ranges")
    first, second = transfers.publish(spark, b"one", at, 100), transfers.publish(spark, b"two", at, 200)
    (tmp_path / "ranges/other.bin").write_bytes(b"x")
    assert open(first, "rb").read() == b"one" and transfers.clean(spark, at, 150) == 1
    assert not os.path.exists(first) and os.path.exists(second) and os.path.exists(f"{at}/other.bin")
    assert transfers.clean(spark, str(tmp_path / "none"), 1) == 0


def test_command_line(spark, tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    (tmp_path / "in/d/ü.txt").write_bytes(b"one\n" * 50)
    (tmp_path / "in/empty").write_bytes(b"")
    os.link(tmp_path / "in/d/ü.txt", tmp_path / "in/hard")
    os.symlink("d/ü.txt", tmp_path / "in/soft")
    at, out = str(tmp_path / "archive"), str(tmp_path / "out")

    def told(*argv):
        text = io.StringIO()
        code = command.run(spark, list(argv), text)
        return code, text.getvalue()

    assert told("pack", str(tmp_path / "in"), "-o", at, "--profile", "stream") == (0, f"{at}: 5 entries, 400 bytes\n")
    assert told("list", at)[1].splitlines()[0] == "         0  Directory  d"
    assert "files: 2, directories: 1, hardlinks: 1, symlinks: 1" in told("inspect", at)[1]
    assert told("verify", at) == (0, "no problems\n")
    assert told("unpack", at, "-o", out)[0] == 0
    assert (tmp_path / "out/hard").read_bytes() == (tmp_path / "out/soft").read_bytes() == b"one\n" * 50
    assert os.stat(f"{out}/hard").st_ino == os.stat(f"{out}/d/ü.txt").st_ino and (tmp_path / "out/empty").read_bytes() == b""
    assert told("extract", at, "hard", "-o", str(tmp_path / "one"))[0] == 0 and (tmp_path / "one").read_bytes() == b"one\n" * 50
    told_ = archive.manifest(spark, at)
    moved = str(tmp_path / "moved")
    os.rename(at, moved)
    with open(f"{moved}/_MANIFEST", "w") as f:
        f.write(json.dumps({**told_, "rows": {**told_["rows"], "entries": 9}, "root": "00"}))
    if os.path.exists(crc := f"{moved}/._MANIFEST.crc"):
        os.remove(crc)
    assert told("verify", moved) == (1, "rows: entries\nroot hash\n")
