"""One query for each operator of the engine, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.config import CODECS, MIB, PRIORITIES, Chunking
from sedimenta.errors import PUBLIC_KIND
from sedimenta.functions import records
from sedimenta.functions.paths import link_target, path_problem, path_within, resolves_within
from sedimenta.operators import catalog, chunking, codecs, fingerprints, grouping, integrity, jobs, packing, sections
from sedimenta.operators.ordered import ordered
from sedimenta.plans import archive
from sedimenta.plans.inputs import commands, document_entries, document_files, language_objects, micro_files, table
from sedimenta.sources import transfers
from sedimenta.staging import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Files up to this size are packed in the queries, so that some documents are too large.
MICRO = Chunking(micro_file_max=8192, pack_target=MIB)


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


# --- catalogue -------------------------------------------------------------------------


@query
def catalog_list(spark, d):
    return catalog.listing(document_entries(spark, d))


@query
def catalog_inspect(spark, d):
    made = stage(document_entries(spark, d))
    return catalog.inspection(made, grouping.grouped(made.where("kind = 'file'").select("entry_id", "size"), "stream"))


@query
def catalog_sort_key_order(spark, d):
    return document_entries(spark, d, hardlinks=False).select("entry_id", "path", F.hex("sort_key").alias("sort_key"))


@query
def catalog_by_source(spark, d):
    made = document_entries(spark, d)
    return made.groupBy("source", "kind").agg(F.count("*").alias("entries"), F.sum("size").cast("long").alias("bytes"))


@query
def scan_budget(spark, d):
    return catalog.scan_budget(document_files(spark, d))


@query
def catalog_lines(spark, d):
    return catalog.lines(document_entries(spark, d))


@query
def kind_names(spark, d):
    """Entries of all four kinds, by name."""
    kinds = F.array(*map(F.lit, catalog.KINDS))
    made = document_files(spark, d).select(F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("kind"))
    return made.groupBy(catalog.kind_name(F.col("kind")).alias("name")).agg(F.count("*").alias("entries"))


@query
def range_read(spark, d):
    """Documents read in pieces whose digests are checked, put together again."""
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    back = catalog.rejoined(catalog.pieces(docs, 4096), "doc_id")
    return back.select("doc_id", "pieces", F.sha2("content", 256).alias("digest"))


@query
def transfer_files(spark, d):
    """Names of transfer files and of others: when each goes, and whether it's due."""
    named = transfers.file_name(F.col("doc_id") * 37 % 1000, F.substring("digest", 1, 32))
    odd = F.when(F.col("doc_id") % 5 == 2, F.concat(named, F.lit(".part"))).when(F.col("doc_id") % 5 == 3, F.col("path")).otherwise(named)
    return transfers.listed(document_files(spark, d).select("doc_id", odd.alias("name")), F.lit(500)).select("doc_id", F.coalesce("expires_at_ms", F.lit(-1)).alias("expires_at_ms"), F.coalesce("due", F.lit(False)).alias("due"))


@query
def measure_paths(spark, d):
    return catalog.measured(document_files(spark, d))


@query
def hardlink_resolve(spark, d):
    return catalog.resolved(document_entries(spark, d)).select("entry_id", "kind", "owner_id", "target_size")


@query
def restore_lookup(spark, d):
    made = stage(document_entries(spark, d))
    places = grouping.restore_map(grouping.grouped(made.where("kind = 'file'").select("entry_id", "size"), "stream"))
    owners = catalog.resolved(made).select("entry_id", "owner_id")
    return owners.join(places.select(F.col("entry_id").alias("owner_id"), "group_id", "group_offset", "length"), "owner_id")


@query
def kind_summary(spark, d):
    kind = F.when(F.col("kind") == "file", "regular").otherwise("link")
    return document_entries(spark, d).groupBy(kind.alias("summary")).agg(F.count("*").alias("entries"))


def _groups_with_text(spark, d, profile):
    """Placed files, and the bytes of their groups, without codecs."""
    files = document_files(spark, d, text=True).withColumn("data", F.encode("text", "UTF-8"))
    made = stage(catalog.entries(files))
    placed = grouping.grouped(made.select("entry_id", "size"), profile)
    return made, placed


@query
def extract_entry(spark, d):
    made, placed = _groups_with_text(spark, d, "raw")
    payload = codecs.group_bytes(placed.join(made.select("entry_id", "data"), "entry_id")).withColumnRenamed("data", "payload")
    out = catalog.extracted(made.drop("data", "text"), grouping.restore_map(placed), payload, F.col("path").startswith("src1/"))
    return out.select("entry_id", "path", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("digest"))


@query
def read_range_slice(spark, d):
    docs = table(spark, d, "documents").withColumn("content", F.encode("text", "UTF-8"))
    return catalog.ranged(docs, 100, 64).select("doc_id", F.hex("slice").alias("slice"), "digest", "problem")


@query
def range_plan(spark, d):
    return catalog.range_plan(document_files(spark, d).select("doc_id", "size"), piece=4096)


@query
def change_detection(spark, d):
    first = document_files(spark, d).select(F.col("doc_id").alias("entry_id"), "size", "modified_ns", F.col("path").alias("identity"), F.col("digest").alias("hash"))
    second = first.where("entry_id % 11 <> 5").withColumn("size", F.when(F.col("entry_id") % 13 == 4, F.col("size") + 1).otherwise(F.col("size")))
    return catalog.changed(first, second)


@query
def path_scope(spark, d):
    return document_files(spark, d).select("doc_id", "path", path_within(F.col("path"), F.lit("src1")).alias("granted"))


@query
def transfer_ttl(spark, d):
    files = document_files(spark, d).select("doc_id", ((F.col("doc_id") * 37) % 1000).alias("expires_at"))
    return files.where(F.col("expires_at") > 500)


# --- groups and codecs -----------------------------------------------------------------


@query
def estimate_resources_by_profile(spark, d):
    return grouping.estimates(catalog.measured(document_files(spark, d)), grouping.profiles(spark))


@query
def codec_memory_bounds(spark, d):
    names = spark.createDataFrame([(c,) for c in CODECS], "codec string")
    total = document_files(spark, d).groupBy("source").agg(F.sum("size").cast("long").alias("length"))
    return total.crossJoin(F.broadcast(names)).select("source", "codec", grouping.memory_bound(F.col("codec"), F.col("length")).alias("memory_bytes"))


@query
def profile_candidates(spark, d):
    return grouping.candidates(spark)


@query
def solid_groups_next_fit(spark, d):
    files = document_entries(spark, d, hardlinks=False).select("entry_id", (F.col("size") * 64).alias("size"))
    return grouping.group_table(grouping.grouped(files, "stream")).select("group_id", "first_entry", "chunk_count", "uncompressed_len")


@query
def solid_groups_raw(spark, d):
    files = document_entries(spark, d, hardlinks=False).select("entry_id", "size")
    return grouping.group_table(grouping.grouped(files, "raw")).select("group_id", "first_entry", "chunk_count", "uncompressed_len")


def _placed(spark, d):
    return grouping.grouped(document_entries(spark, d, hardlinks=False).select("entry_id", (F.col("size") * 64).alias("size")), "stream")


@query
def restore_map(spark, d):
    return grouping.restore_map(_placed(spark, d))


@query
def group_members_check(spark, d):
    placed = stage(_placed(spark, d))
    return integrity.member_checks(grouping.group_table(placed), grouping.restore_map(placed))


@query
def candidate_cost(spark, d):
    return document_files(spark, d).select("doc_id", grouping.total_cost(F.col("size")).alias("total_cost"))


@query
def codec_argmin(spark, d):
    each = document_files(spark, d).crossJoin(F.broadcast(grouping.candidates(spark).where("profile = 'balanced'")))
    cost = grouping.total_cost(F.when(F.col("codec") == "store", F.col("size")).otherwise(F.floor(F.col("size") / (F.col("codec_id") + 1)) + 30 * F.col("codec_id"))).cast("long")
    costs = each.select(F.col("doc_id").alias("group_id"), "codec", "codec_id", F.col("size").alias("compressed_len"), cost.alias("total_cost"))
    return codecs.chosen(costs).select("group_id", "codec_id", "total_cost")


@query
def codec_registry(spark, d):
    used = document_files(spark, d).select((F.col("doc_id") % 3).cast("int").alias("codec_id"))
    return grouping.registry(used)


@query
def codec_choice(spark, d):
    """Real encodings of the stream groups of all documents, and which codec wins each."""
    made, placed = _groups_with_text(spark, d, "stream")
    blobs = codecs.group_bytes(placed.join(made.select("entry_id", "data"), "entry_id"))
    return codecs.encoded(blobs, "stream").drop("payload")


@query
def codec_round_trip(spark, d):
    """Bytes of each group decoded again, as a digest that SQL can make from the documents."""
    made, placed = _groups_with_text(spark, d, "stream")
    placed = stage(placed)
    blobs = codecs.group_bytes(placed.join(made.select("entry_id", "data"), "entry_id"))
    back = codecs.members(codecs.encoded(blobs, "stream"), grouping.restore_map(placed))
    return back.select("entry_id", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("digest"))


@query
def verify_report(spark, d):
    """Pack, verify, extract: each problem that verification finds, and the number of entries that come back whole."""
    files = document_files(spark, d, text=True).withColumn("data", F.encode("text", "UTF-8")).drop("text")
    made = {n: stage(t) for n, t in archive.pack_tables(files, "stream", "digest").items()}
    problems = archive.verify(made).groupBy("problem").agg(F.count("*").alias("entries"))
    whole = archive.extract(made, F.lit(True)).join(made["entries"].select("entry_id", "digest"), "entry_id").where(F.sha2("content", 256) == F.col("digest"))
    return problems.unionByName(whole.agg(F.lit("none: whole").alias("problem"), F.count("*").alias("entries")))


@query
def verify_damage(spark, d):
    """What verification finds in an archive some of whose entries have another hash than their bytes."""
    files = document_files(spark, d, text=True).withColumn("data", F.encode("text", "UTF-8")).drop("text")
    made = archive.pack_tables(files, "raw", "digest")
    bad = made["entries"].withColumn("blake3", F.when(F.col("entry_id") % 17 == 3, F.reverse(F.hex("blake3")).cast("binary")).otherwise(F.col("blake3")))
    # payloads are read from the table that packing wrote
    return archive.verify({n: t if n == "payload" else stage(t) for n, t in {**made, "entries": bad}.items()}).select("id", "problem")


# --- chunks ----------------------------------------------------------------------------


@query
def fixed_chunks(spark, d):
    return chunking.fixed(language_objects(spark, d))


def _regions(spark, d):
    files = document_files(spark, d)
    entry = (F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1))).cast("long")
    laid = ordered(files.select(entry.alias("entry_id"), F.lit(0).cast("long").alias("object_id"), "doc_id", "size"), ["doc_id"], sums={"start": "size"}, keys=["entry_id", "object_id"])
    return laid.withColumn("end", F.col("start") + F.col("size"))


#: Regions over this size are cut by content in the query whose long regions are cut.
SHORT = Chunking(minimum=256, average=1024, maximum=4096)


@query
def structural_chunks(spark, d):
    return chunking.structural(_regions(spark, d))


@query
def structural_cut(spark, d):
    """Regions that are longer than the maximum: each is covered by chunks of allowed sizes, and the others stay whole."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), F.lit(0).cast("long").alias("object_id"), F.lit(0).cast("long").alias("start"), F.encode("text", "UTF-8").alias("data"))
    chunks = chunking.structural(rows.withColumn("end", F.octet_length("data").cast("long")), SHORT, "data")
    last = F.max(F.struct("logical_offset", "length"))["length"]
    odd = F.count_if((F.col("length") > SHORT.maximum) | (F.col("length") <= 0)) + F.count_if(F.col("length") < SHORT.minimum) - F.when(last < SHORT.minimum, 1).otherwise(0)
    per = chunks.groupBy("entry_id").agg(F.sum("length").cast("long").alias("bytes"), (F.count("*") > 1).alias("cut"), odd.cast("long").alias("odd_sizes"))
    covered = chunking.coverage(chunks, rows.select("entry_id", "object_id", F.octet_length("data").cast("long").alias("size")))
    return per.join(covered.select("entry_id", "covered"), "entry_id")


#: Regions over this size are cut by content in conversations.
TURNS = Chunking(minimum=64, average=128, maximum=256)


def turn_pages(spark, d):
    """Conversations as objects whose pages are their turns, and the ends of the turns that hold text."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("entry_id"), F.lit(0).cast("long").alias("object_id"), "turn", F.encode("text", "UTF-8").alias("data"))
    pages = ordered(turns, ["turn", "data"], number="page", keys=["entry_id", "object_id"]).drop("turn")
    laid = ordered(pages.select("entry_id", "object_id", "page", F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("n")), ["page"], sums={"at": "n"}, keys=["entry_id", "object_id"])
    ends = laid.groupBy("entry_id", "object_id").agg(F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.col("at") + F.col("n")))).alias("ends"))
    return pages, ends


@query
def structural_pages(spark, d):
    """Turns of conversations, read as pages: those over the maximum are cut, and each conversation is covered."""
    pages, ends = (stage(x) for x in turn_pages(spark, d))
    chunks = stage(chunking.structural_pages(pages, ends, TURNS))
    sizes = ends.select("entry_id", "object_id", F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("size"))
    per = chunks.groupBy("entry_id").agg(F.sum("length").cast("long").alias("bytes"), F.count_if(F.col("length") > TURNS.maximum).alias("odd_sizes"))
    return sizes.where("size > 0").select("entry_id").join(per, "entry_id", "left").join(chunking.coverage(chunks, sizes).select("entry_id", "covered"), "entry_id")


class _Sentences:
    """Regions that end with a full stop, and what follows the last one."""

    def probe(self, prefix: bytes) -> bool:
        return b"." in prefix

    def ends(self, data: bytes) -> list[int]:
        stops = [i + 1 for i, b in enumerate(data) if b == 46]
        return stops if stops and stops[-1] == len(data) else [*stops, len(data)]


@query
def structural_scan(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), F.lit(0).cast("long").alias("object_id"), F.encode("text", "UTF-8").alias("data"))
    found = chunking.boundary_problems(chunking.scanned(rows, _Sentences(), prefix=1 << 30))
    return found.select("entry_id", "size", F.size("ends").cast("long").alias("regions"), "problem")


@query
def chunk_coverage_check(spark, d):
    drafts = chunking.structural(_regions(spark, d))
    broken = drafts.withColumn("length", F.when((F.col("entry_id") == 25966) & (F.col("logical_offset") > 100_000), F.col("length") - 1).otherwise(F.col("length")))
    return chunking.coverage(broken, language_objects(spark, d))


@query
def chunk_ids_global(spark, d):
    drafts = chunking.structural(_regions(spark, d)).unionByName(chunking.fixed(language_objects(spark, d).withColumn("object_id", F.lit(1).cast("long"))))
    return chunking.with_ids(drafts)


@query
def chunk_limits(spark, d):
    return chunking.limits(chunking.structural(_regions(spark, d)))


@query
def chunk_id_violations(spark, d):
    drafts = chunking.structural(_regions(spark, d))
    return chunking.id_violations(drafts.unionByName(drafts.where("length % 17 = 3"))).groupBy("problem").agg(F.count("*").alias("places"))


@query
def boundary_validation(spark, d):
    ends = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("rows"))
    laid = ends.select("conv_id", F.transform("rows", lambda r: (r["n"] * F.when(r["turn"] % 5 == 3, 1).otherwise(r["turn"] + 1)).cast("long")).alias("ends"))
    return chunking.boundary_problems(laid.withColumn("size", F.array_max("ends"))).select("conv_id", "problem")


@query
def fastcdc_chunks(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), F.lit(0).cast("long").alias("object_id"), F.encode("text", "UTF-8").alias("data"))
    return chunking.with_ids(chunking.content_defined(rows, Chunking(minimum=1024, average=4096, maximum=16384)))


# --- fingerprints ----------------------------------------------------------------------


def _prints(spark, d):
    return fingerprints.computed(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.encode("text", "UTF-8").alias("data")))


@query
def fingerprint_table(spark, d):
    out = fingerprints.escalated(stage(_prints(spark, d)))
    return out.select("chunk_id", "length", "xxh3", F.hex("blake3_128").alias("blake3_128"), F.hex("full_blake3").alias("full_blake3"), "crc32c", "superfeatures")


@query
def fingerprint_pages(spark, d):
    """Fingerprints of documents that come as pages of 1,000 bytes are those of the whole ones."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.encode("text", "UTF-8").alias("content"))
    pages = catalog.pieces(docs, 1000).select("chunk_id", (F.col("offset") / 1000).cast("long").alias("page"), F.col("content").alias("data"))
    paged = fingerprints.computed_pages(docs.select("chunk_id", F.octet_length("content").alias("length")), pages)
    hashes = ["length", "xxh3", "full_blake3", "crc32c", "superfeatures"]
    both = _prints(spark, d).select("chunk_id", F.struct(*hashes).alias("whole")).join(paged.select("chunk_id", F.struct(*hashes).alias("paged")), "chunk_id", "full")
    return both.select("chunk_id", F.col("paged.length").alias("length"), F.col("whole").eqNullSafe(F.col("paged")).alias("same"))


@query
def fingerprint_budget(spark, d):
    return fingerprints.batch_budget(document_files(spark, d).select(F.col("size").alias("length")))


@query
def collision_groups(spark, d):
    out = fingerprints.escalated(stage(_prints(spark, d)))
    return out.select("chunk_id", F.col("full_blake3").isNotNull().alias("escalated"))


@query
def paranoid_policy(spark, d):
    out = fingerprints.escalated(_prints(spark, d), fingerprints.Fingerprinting(policy="paranoid"))
    return out.select("chunk_id", "length", F.col("full_blake3").isNotNull().alias("escalated"))


@query
def fingerprint_mismatches(spark, d):
    prints = stage(_prints(spark, d))
    now = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.encode(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "UTF-8").alias("data"))
    return fingerprints.mismatches(prints, now)


@query
def superfeature_candidates(spark, d):
    return fingerprints.similar(stage(_prints(spark, d)), at_least=2)


# --- micro-files -----------------------------------------------------------------------


@query
def microfile_eligibility(spark, d):
    return micro_files(spark, d).select("entry_id", "size", packing.exclusion(MICRO).isNull().alias("eligible"))


@query
def microfile_exclusions(spark, d):
    return packing.excluded(micro_files(spark, d), MICRO)


@query
def microfile_order(spark, d):
    return packing.packed(micro_files(spark, d), MICRO).select("entry_id", "position")


@query
def microfile_packs(spark, d):
    return packing.packed(micro_files(spark, d), MICRO).select("pack_id", "ordinal", "entry_id", "content_offset", "length")


@query
def microfile_mode_dictionary(spark, d):
    members = stage(packing.packed(micro_files(spark, d), MICRO))
    return packing.with_metadata(members).select("entry_id", "pack_id", F.col("mode_index").cast("long").alias("mode_index"))


@query
def microfile_timestamp_delta(spark, d):
    members = stage(packing.packed(micro_files(spark, d), MICRO))
    return packing.with_metadata(members).select("entry_id", F.col("modified_ns_delta").cast("long").alias("modified_ns_delta"))


@query
def microfile_front_coding(spark, d):
    coded = packing.front_coded(packing.packed(micro_files(spark, d), MICRO))
    return coded.select("pack_id", "ordinal", "shared_prefix_len", F.hex("suffix").alias("suffix"))


@query
def microfile_expand_paths(spark, d):
    return packing.expanded(stage(packing.front_coded(packing.packed(micro_files(spark, d), MICRO))))


@query
def microfile_chunks(spark, d):
    return chunking.with_ids(packing.as_chunks(packing.packed(micro_files(spark, d), MICRO)))


@query
def microfile_pack_check(spark, d):
    members = stage(packing.packed(micro_files(spark, d), MICRO))
    bad = members.withColumn("content_offset", F.when((F.col("pack_id") == 1) & (F.col("ordinal") == 2), F.col("content_offset") + 1).otherwise(F.col("content_offset")))
    return packing.pack_problems(bad, packing.headers(members))


@query
def plan_entry_uniqueness(spark, d):
    inputs = micro_files(spark, d)
    members = stage(packing.packed(inputs, MICRO))
    out = packing.excluded(inputs, MICRO).unionByName(members.where("entry_id % 50 = 7").select("entry_id", F.lit("too_large").alias("reason"), "position"))
    return packing.plan_problems(members, out)


@query
def microfile_input_check(spark, d):
    inputs = micro_files(spark, d).select("entry_id", F.when(F.col("entry_id") % 100 == 9, "").otherwise(F.col("path")).alias("path"))
    return packing.input_problems(inputs.unionByName(inputs.where("entry_id % 100 = 11")))


# --- integrity -------------------------------------------------------------------------


@query
def section_overlap_check(spark, d):
    total = table(spark, d, "conversations").groupBy("role").agg(F.sum(F.length("text")).cast("long").alias("length"))
    laid = total.withColumn("section", F.col("role")).withColumn("offset", (F.length("role") * 1000).cast("long"))
    return integrity.overlaps(laid.select("section", "offset", "length"))


@query
def group_records(spark, d):
    """Group records as bytes, and what they decode to."""
    groups = grouping.group_table(stage(_placed(spark, d)))
    crc = F.col("group_id") * 2654435761 % (1 << 32)
    own = {"group_id": F.col("group_id"), "codec_chain_id": F.col("group_id") % 4 + 1, "chunk_count": F.col("chunk_count"), "uncompressed_len": F.col("uncompressed_len"), "compressed_len": F.col("uncompressed_len"), "payload_crc32c": crc}
    made = groups.select("group_id", records.encoded(records.GROUP, {**own, "version": F.lit(1), "flags": F.lit(0), "descriptor_len": F.lit(0)}).alias("record"))
    return made.select("group_id", F.hex("record").alias("record"), records.decoded(records.GROUP, F.col("record")).alias("r")).select("group_id", "record", "r.chunk_count", "r.uncompressed_len", "r.payload_crc32c")


@query
def header_record(spark, d):
    """The header's bytes before its checksum, which decoding has compared."""
    total = document_files(spark, d).agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"), F.countDistinct("source").alias("sources"))
    values = {
        "major": F.lit(records.MAJOR), "minor": F.lit(records.MINOR), "header_len": F.lit(records.HEADER.size), "flags": F.lit(0), "archive_id": F.unhex(F.lpad(F.hex("n"), 32, "0")), "original_total_size": F.col("bytes"),
        "entry_count": F.col("n"), "logical_chunk_count": F.col("n"), "group_count": F.col("sources"), "section_directory_offset": F.lit(records.HEADER.size), "footer_offset": F.col("bytes") + 288, "section_count": F.lit(6),
    }
    made = total.select(records.encoded(records.HEADER, values).alias("record"))
    back = made.select(F.substring(F.hex("record"), 1, 176).alias("record"), records.decoded(records.HEADER, F.col("record")).alias("r"))
    return back.select("record", "r.entry_count", "r.footer_offset", "r.section_count")


@query
def section_directory(spark, d):
    bodies = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("int").alias("section_type"), F.encode("r_name", "UTF-8").alias("data"))
    return sections.directory(bodies).select("section_type", "offset", "length", F.hex(F.substring("record", 1, 24)).alias("record"))


@query
def section_rows(spark, d):
    """A table as a section of JSON rows, checked and read again."""
    body = sections.json_body(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), ["n_nationkey"])
    bodies = stage(body.select(F.lit(records.SECTIONS["entry_table"]).alias("section_type"), "data"))
    return sections.json_rows(sections.checked(bodies, sections.directory(bodies)), records.SECTIONS["entry_table"], "n_nationkey long, n_name string")


@query
def table_counts(spark, d):
    made, rows = table(spark, d, "documents"), table(spark, d, "nation")
    return integrity.table_counts({"documents": made.count(), "nation": rows.count() + 1}, {"documents": made, "nation": rows})


@query
def link_targets(spark, d):
    odd = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/"), F.col("path"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(".././"), F.col("path"))).when(F.col("doc_id") % 4 == 2, F.lit("./.")).otherwise(F.concat(F.col("path"), F.lit("//..")))
    return document_files(spark, d).select("doc_id", F.array_join(link_target(odd), ">").alias("parts"))


@query
def path_safety(spark, d):
    url = F.regexp_replace("url", r"^[a-z]+://", "")
    odd = F.when(F.col("page_id") % 7 == 1, F.concat(F.lit("/"), url)).when(F.col("page_id") % 7 == 2, F.concat(url, F.lit("/../x"))).when(F.col("page_id") % 7 == 3, F.concat(url, F.lit("/a\\b"))).when(F.col("page_id") % 7 == 4, F.concat(url, F.lit("/nul.txt"))).otherwise(url)
    return table(spark, d, "pages").select("page_id", odd.alias("path")).withColumn("problem", path_problem(F.col("path")))


@query
def symlink_depth(spark, d):
    ups = F.repeat(F.lit("../"), (F.col("doc_id") % 5).cast("int"))
    links = document_files(spark, d).select("doc_id", "path", F.concat(ups, F.lit("x/y")).alias("target"))
    return links.withColumn("inside", resolves_within(F.col("path"), F.col("target")))


@query
def entry_table_violations(spark, d):
    made = document_entries(spark, d).withColumn("group_id", F.when(F.col("kind") == "file", F.col("entry_id")))
    made = stage(made)
    groups = made.where("kind = 'file' AND entry_id % 97 <> 13").select("group_id")
    bad = made.withColumn("target_entry_id", F.when(F.col("entry_id") % 3 == 1, F.col("entry_id")).otherwise(F.col("target_entry_id")))
    return integrity.entry_problems(bad, groups)


@query
def restore_map_violations(spark, d):
    placed = stage(_placed(spark, d))
    entries = placed.select("entry_id", F.lit("file").alias("kind"), "group_id", "size")
    restore = grouping.restore_map(placed).where("entry_id % 89 <> 5").withColumn("length", F.when(F.col("entry_id") % 83 == 2, F.col("length") + 1).otherwise(F.col("length")))
    return integrity.restore_problems(entries, restore.unionByName(restore.where("entry_id % 79 = 3")))


@query
def group_table_violations(spark, d):
    placed = stage(_placed(spark, d))
    table_ = ordered(grouping.group_table(placed).withColumn("compressed_len", F.col("uncompressed_len")), ["group_id"], sums={"payload_offset": "compressed_len"})
    bad = table_.withColumn("codec_chain_id", (F.col("group_id") % 6).cast("int")).withColumn("payload_offset", F.col("payload_offset") + F.when(F.col("group_id") == 2, 1).otherwise(0))
    chains = spark.createDataFrame([(i,) for i in range(1, 5)], "chain_id int")
    return integrity.group_problems(bad, chains)


@query
def index_projection_check(spark, d):
    made = stage(document_entries(spark, d))
    index = made.select("entry_id", "path").withColumn("path", F.when(F.col("entry_id") == 7, "other").otherwise(F.col("path")))
    return integrity.projection_problems(made, index, made.where("entry_id <> 11").select("entry_id", "digest"))


@query
def original_bytes(spark, d):
    return integrity.original_bytes(document_entries(spark, d))


# --- job log ---------------------------------------------------------------------------

_ORDER = ["ts", "event_id"]


def _log(spark, d):
    return jobs.with_sequence(commands(spark, d).withColumnRenamed("ms", "occurred_at_ms"), ["owner", "job_no"], _ORDER)


@query
def job_idempotency(spark, d):
    requests = commands(spark, d).where("command = 'submit'").select("event_id", "ts", "owner", F.col("job_no").alias("idempotency_key"), (F.floor("value") % 3).cast("long").alias("params"))
    return jobs.submissions(requests, _ORDER).select("event_id", "owner", "idempotency_key", "outcome")


@query
def job_submission_caps(spark, d):
    """Submissions to a store of 200 jobs, 3 for each owner."""
    requests = commands(spark, d).where("command = 'submit'").select("event_id", "ts", "owner", F.col("job_no").alias("idempotency_key"), (F.floor("value") % 3).cast("long").alias("params"))
    return jobs.capped(requests, _ORDER, retained=200, per_owner=3).select("event_id", "outcome")


@query
def job_publication(spark, d):
    snap = jobs.snapshot(_log(spark, d), ["owner", "job_no"])
    seen = F.when(F.col("job_no") % 7 != 3, F.col("job_no") % 4)
    recorded = F.when(F.col("job_no") % 3 != 0, F.col("job_no") % 4 + F.col("sequence") % 2)
    named = snap.select("owner", "job_no", "state", (F.col("sequence") % 5 != 0).alias("was_absent"), recorded.alias("recorded"), seen.alias("seen"))
    return jobs.published(named).select("owner", "job_no", "outcome", F.coalesce("recorded_after", F.lit(-1)).alias("recorded_after"))


@query
def permit_use(spark, d):
    sign = F.when(F.col("command") == "start", 1).when(F.col("command").isin("complete", "fail"), -1).otherwise(0)
    log = commands(spark, d).select("event_id", "ts", sign.cast("long").alias("jobs"), (sign * F.floor("value")).cast("long").alias("memory"))
    return jobs.permit_use(log, _ORDER, {"jobs": 4, "memory": 4096}).select("event_id", "used_jobs", "used_memory", "within")


@query
def session_log(spark, d):
    action = F.when(F.col("command") == "submit", "create").otherwise("resume")
    rows = commands(spark, d).select("event_id", "ts", F.col("owner").alias("session"), action.alias("action"), (F.col("job_no") % 2).cast("string").alias("token"), (F.col("event_id") % 2).cast("string").alias("next_token"), F.col("ms").alias("now_ms"))
    return jobs.session_log(rows, _ORDER, ttl_ms=86_400_000).select("event_id", "outcome")


@query
def job_transitions_valid(spark, d):
    return jobs.transition_checks(commands(spark, d), ["owner", "job_no"], _ORDER).select("event_id", "before", "state", "valid")


@query
def job_state_machine(spark, d):
    rows = commands(spark, d).select("event_id", "ts", "owner", "job_no", "command")
    return jobs.applied(rows, ["owner", "job_no"], _ORDER).select("event_id", "state", "outcome")


@query
def job_event_sequence(spark, d):
    return _log(spark, d).select("event_id", "sequence", "completed_units")


@query
def job_event_retention(spark, d):
    return jobs.retained(stage(_log(spark, d)), ["owner", "job_no"], 2).select("event_id", "sequence")


@query
def job_event_cursor(spark, d):
    return jobs.since(stage(_log(spark, d)), ["owner", "job_no"], 2).select("event_id", "sequence", "latest_sequence", "terminal")


@query
def job_snapshot(spark, d):
    return jobs.snapshot(_log(spark, d), ["owner", "job_no"])


@query
def job_cancel_outcomes(spark, d):
    return jobs.cancelled(jobs.snapshot(_log(spark, d), ["owner", "job_no"])).select("owner", "job_no", "state", "outcome")


@query
def job_deadline_expiry(spark, d):
    snap = jobs.snapshot(_log(spark, d), ["owner", "job_no"]).withColumn("deadline_ms", F.col("updated_ms") + 86_400_000)
    return jobs.expired(snap, F.lit(1705276800000)).select("owner", "job_no", "state", "state_after")


@query
def job_recovery(spark, d):
    snap = jobs.snapshot(_log(spark, d), ["owner", "job_no"])
    named = snap.select(F.concat_ws(":", "owner", "job_no").alias("job_id"), "state", (F.col("sequence") % 3).alias("identity"))
    seen = named.where("identity <> 1").select("job_id", F.when(F.col("identity") == 2, 0).otherwise(F.col("identity")).alias("identity"))
    return jobs.recovered(named, seen).select("job_id", "state", "state_after")


@query
def job_close_all(spark, d):
    return jobs.closed(jobs.snapshot(_log(spark, d), ["owner", "job_no"])).groupBy("state", "state_after").agg(F.count("*").alias("jobs"))


@query
def job_ownership(spark, d):
    return jobs.owned(jobs.snapshot(_log(spark, d), ["owner", "job_no"]), 3).select("job_no", "state", "sequence")


@query
def job_store_validation(spark, d):
    events = stage(_log(spark, d))
    snap = jobs.snapshot(events, ["owner", "job_no"]).withColumn("next_sequence", F.col("sequence") + F.when(F.col("job_no") % 9 == 4, 2).otherwise(1))
    return jobs.store_problems(snap.select("owner", "job_no", "state", "next_sequence"), events.where("event_id % 101 <> 50"), ["owner", "job_no"])


@query
def job_quota(spark, d):
    asked = commands(spark, d).select("event_id", F.floor("value").cast("long").alias("asked"))
    return asked.withColumn("granted", jobs.quota_ok(F.col("asked"), 64))


@query
def job_permits(spark, d):
    return document_files(spark, d).select("doc_id", jobs.permits(F.col("size") * 1000).alias("permits"))


@query
def job_operation_hash(spark, d):
    rows = commands(spark, d).select("event_id", F.col("owner").cast("string").alias("owner"), "command")
    return rows.select("event_id", jobs.operation_hash("owner", "command").alias("key"))


@query
def session_expiry(spark, d):
    sessions = commands(spark, d).groupBy("owner").agg(F.min("ms").alias("created_ms"))
    return jobs.live_sessions(sessions, F.lit(1704106800000)).select("owner", "created_ms")


@query
def rate_limiter(spark, d):
    rows = commands(spark, d).select("event_id", "ts", "owner", F.expr("cast(ms div 60000 as bigint)").alias("now_ms"))
    return jobs.rate_limited(rows, ["owner"], _ORDER, "now_ms", rate=1, burst=2).select("event_id", "allowed", "tokens_milli")


@query
def lane_round_robin(spark, d):
    rows = commands(spark, d).where("command = 'submit'").select("event_id", "ts", F.col("owner").alias("session"))
    return jobs.lane_order(rows, _ORDER).select("event_id", "turn")


@query
def fair_queue(spark, d):
    """The order in which all requests are served if they wait from the start."""
    kinds = list(PRIORITIES)
    rows = commands(spark, d).select("event_id", "ts", F.element_at(F.array(*map(F.lit, kinds)), (F.col("owner") % 6 + 1).cast("int")).alias("priority"), F.col("job_no").alias("session"))
    return jobs.fair_order(rows, _ORDER).select("event_id", "priority", "cycle", "turn", "place")


@query
def dag_levels(spark, d):
    """A tree of tasks: each but the first needs the one halfway before it."""
    tasks = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("task"))
    edges = tasks.where("task > 0").select("task", F.floor((F.col("task") - 1) / 2).cast("long").alias("needs"))
    return jobs.levels(edges, tasks)


@query
def error_mapping(spark, d):
    return spark.createDataFrame(list(PUBLIC_KIND.items()), "error string, kind string")


@query
def request_validation(spark, d):
    e = commands(spark, d)
    raw = F.concat(F.lit('{"jsonrpc":"'), F.when(F.col("event_id") % 7 == 1, "1.0").otherwise("2.0"), F.lit('","id":"'), F.col("event_id").cast("string"), F.lit('","method":"'), "command", F.when(F.col("event_id") % 7 == 2, F.lit('","more":1}')).when(F.col("event_id") % 7 == 3, F.lit('"')).otherwise(F.lit('"}')))
    return e.select("event_id", jobs.request_problem(raw, ("submit", "start", "cancel", "complete")).alias("problem"))
