"""DuckDB SQL that gives the same rows as the queries, from the same tables."""

from __future__ import annotations

from sedimenta.config import CANDIDATES, CODECS, GROUP_TARGETS, MEMORY_BOUNDS, PRIORITIES
from sedimenta.errors import PUBLIC_KIND
from sedimenta.functions.paths import DEVICES

_FILES = """
files AS (
  SELECT doc_id, lang, source, text, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
    CAST(octet_length(encode(text)) AS BIGINT) AS size, 1700000000000000000 + doc_id * 1000003 AS modified_ns,
    CAST(CASE lang WHEN 'en' THEN 420 WHEN 'de' THEN 384 WHEN 'fr' THEN 493 ELSE 292 END AS BIGINT) AS mode, sha256(text) AS digest
  FROM documents
)"""
_LE = "substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)".replace("h,", "lpad(hex(octet_length(encode(c))), 16, '0'),")
_ENTRIES = f"""{_FILES}, keyed AS (
  SELECT *, array_to_string(list_transform(string_split(path, '/'), lambda c: '00' || {_LE} || hex(encode(c))), '') AS key_hex FROM files
), numbered AS (
  SELECT *, CAST(row_number() OVER (ORDER BY unhex(key_hex)) - 1 AS BIGINT) AS entry_id FROM keyed
), ent AS (
  SELECT *, CASE WHEN entry_id > first_id THEN 'hardlink' ELSE 'file' END AS kind, CASE WHEN entry_id > first_id THEN first_id END AS target_entry_id,
    coalesce(CASE WHEN entry_id > first_id THEN first_id END, entry_id) AS owner_id
  FROM (SELECT *, min(entry_id) OVER (PARTITION BY digest) AS first_id FROM numbered)
)"""


def _fit(source: str, target: int, name: str = "fit") -> str:
    """Next-fit over `source` (pos from 0, len) as a recursion."""
    return f"""{name}(pos, grp, used) AS (
  SELECT pos, CAST(0 AS BIGINT), len FROM {source} WHERE pos = 0
  UNION ALL
  SELECT s.pos, CASE WHEN f.used + s.len <= {target} THEN f.grp ELSE f.grp + 1 END, CASE WHEN f.used + s.len <= {target} THEN f.used + s.len ELSE s.len END
  FROM {name} f JOIN {source} s ON s.pos = f.pos + 1
)"""


_STREAM = 4 << 20
_LAID = f"""{_ENTRIES}, laid AS (SELECT entry_id, entry_id AS pos, size * 64 AS len FROM numbered), {_fit('laid', _STREAM)},
placed AS (
  SELECT l.entry_id, l.len AS size, f.grp AS group_id, CAST(coalesce(sum(l.len) OVER (PARTITION BY f.grp ORDER BY l.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS group_offset
  FROM laid l JOIN fit f USING (pos)
), grps AS (SELECT group_id, min(entry_id) AS first_entry, count(*) AS chunk_count, CAST(sum(size) AS BIGINT) AS uncompressed_len FROM placed GROUP BY group_id)"""

_FILE_GROUPS = f"""{_ENTRIES}, laid AS (SELECT entry_id, row_number() OVER (ORDER BY entry_id) - 1 AS pos, size AS len FROM ent WHERE kind = 'file'), {_fit('laid', _STREAM)},
placed AS (
  SELECT l.entry_id, l.len AS length, f.grp AS group_id, CAST(coalesce(sum(l.len) OVER (PARTITION BY f.grp ORDER BY l.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS group_offset
  FROM laid l JOIN fit f USING (pos)
)"""

_MICRO = f"""{_FILES}, micro AS (
  SELECT f.doc_id AS entry_id, f.path, f.size, f.modified_ns, f.mode, coalesce(l.toxic = 1, false) AS isolated, length(lang) AS family_key, lang AS prefix_key, doc_id % 7 AS similarity_key
  FROM files f LEFT JOIN (SELECT doc_id AS l_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.l_id = f.doc_id
), judged AS (
  SELECT *, CASE WHEN isolated THEN 'requires_isolated_access' WHEN size > 8192 THEN 'too_large' END AS reason FROM micro
), mlaid AS (
  SELECT *, CAST(row_number() OVER (ORDER BY family_key, prefix_key, mode, similarity_key, encode(path), entry_id) - 1 AS BIGINT) AS pos, size AS len FROM judged WHERE reason IS NULL
), mout AS (
  SELECT *, CAST(row_number() OVER (ORDER BY family_key, prefix_key, mode, similarity_key, encode(path), entry_id) - 1 AS BIGINT) AS position FROM judged WHERE reason IS NOT NULL
), {_fit('mlaid', 1 << 20, 'mfit')}, members AS (
  SELECT m.*, f.grp AS pack_id, row_number() OVER (PARTITION BY f.grp ORDER BY m.pos) - 1 AS ordinal,
    CAST(coalesce(sum(m.len) OVER (PARTITION BY f.grp ORDER BY m.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS content_offset
  FROM mlaid m JOIN mfit f USING (pos)
)"""

_OBJECTS = f"""{_FILES}, objects AS (
  SELECT CAST(ascii(lang) * 256 + ascii(substr(lang, 2, 1)) AS BIGINT) AS entry_id, CAST(0 AS BIGINT) AS object_id, CAST(sum(size) AS BIGINT) AS size FROM files GROUP BY lang
), regions AS (
  SELECT CAST(ascii(lang) * 256 + ascii(substr(lang, 2, 1)) AS BIGINT) AS entry_id, CAST(0 AS BIGINT) AS object_id, CAST(sum(size) OVER w AS BIGINT) - size AS logical_offset, size AS length, 'Structural' AS method
  FROM files WINDOW w AS (PARTITION BY lang ORDER BY doc_id)
), fixed AS (
  SELECT entry_id, object_id, o AS logical_offset, least(1048576, size - o) AS length, 'FixedHighEntropy' AS method FROM (SELECT *, unnest(range(0, size, 1048576)) AS o FROM objects)
)"""

_COMMANDS = """
cmd AS (
  SELECT event_id, ts, epoch_us(ts) // 1000 AS ms, user_id AS owner, CAST(json_extract_string(props, '$.k') AS BIGINT) AS job_no, value,
    CASE event_type WHEN 'view' THEN 'submit' WHEN 'click' THEN 'start' WHEN 'signup' THEN 'cancel' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' END AS command,
    CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'cancelling' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS state
  FROM events
), log AS (
  SELECT *, row_number() OVER (PARTITION BY owner, job_no ORDER BY ts, event_id) AS sequence, CAST(state IN ('completed', 'failed', 'cancelled') AS BIGINT) AS completed_units FROM cmd
), snap AS (
  SELECT owner, job_no, arg_max(state, sequence) AS state, max(sequence) AS sequence, max(ms) AS updated_ms FROM log GROUP BY owner, job_no
)"""


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


def _le(n: str, width: int) -> str:
    """Hex digits of a number, lowest byte first."""
    return " || ".join(f"substr(lpad(hex(CAST({n} AS BIGINT)), 16, '0'), {15 - 2 * k}, 2)" for k in range(width))


_ALLOWED = "queued>running queued>cancelled running>cancelling running>completed running>failed cancelling>cancelled cancelling>failed".split()
_DEVICES = ", ".join(f"'{d}'" for d in DEVICES)
_STEM = r"upper(string_split(regexp_replace(c, '[. ]+$', ''), '.')[1])"

ORACLE_SQL: dict[str, str] = {
    "catalog_list": _with(_ENTRIES, "SELECT entry_id, path, kind, size, modified_ns FROM ent"),
    "catalog_inspect": _with(
        _FILE_GROUPS,
        "SELECT count(*) AS entries, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'directory') AS directories, count(*) FILTER (kind = 'hardlink') AS hardlinks, count(*) FILTER (kind = 'symlink') AS symlinks, CAST(sum(size) AS BIGINT) AS original_bytes, (SELECT count(DISTINCT group_id) FROM placed) AS groups FROM ent",
    ),
    "catalog_sort_key_order": _with(_ENTRIES, "SELECT entry_id, path, upper(key_hex) AS sort_key FROM numbered"),
    "catalog_by_source": _with(_ENTRIES, "SELECT source, kind, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM ent GROUP BY source, kind"),
    "scan_budget": _with(_FILES, "SELECT count(*) AS entries, CAST(sum(512 + octet_length(encode(path)) + 32 * 3 + octet_length(encode(path)) - 2 + 27) AS BIGINT) AS held_bytes FROM files"),
    "catalog_lines": _with(_ENTRIES, "SELECT entry_id, printf('%10d  %s  %s', size, CASE kind WHEN 'file' THEN 'File' ELSE 'Hardlink' END, path) AS line FROM ent"),
    "kind_names": "SELECT CASE doc_id % 4 WHEN 0 THEN 'File' WHEN 1 THEN 'Directory' WHEN 2 THEN 'Hardlink' ELSE 'Symlink' END AS name, count(*) AS entries FROM documents GROUP BY 1",
    "range_read": _with(_FILES, "SELECT doc_id, (size + 4095) // 4096 AS pieces, digest FROM files WHERE size > 0"),
    "transfer_files": "SELECT doc_id, CASE WHEN doc_id % 5 NOT IN (2, 3) THEN doc_id * 37 % 1000 ELSE -1 END AS expires_at_ms, doc_id % 5 NOT IN (2, 3) AND doc_id * 37 % 1000 <= 500 AS due FROM documents",
    "structural_pages": "SELECT CAST(conv_id AS BIGINT) AS entry_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS odd_sizes, true AS covered FROM conversations GROUP BY conv_id HAVING sum(octet_length(encode(text))) > 0",
    "structural_scan": """SELECT doc_id AS entry_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, CAST(length(text) - length(replace(text, '.', '')) + CASE WHEN text LIKE '%.' THEN 0 ELSE 1 END AS BIGINT) AS regions, CAST(NULL AS VARCHAR) AS problem
FROM documents WHERE contains(text, '.')""",
    "fingerprint_pages": "SELECT doc_id AS chunk_id, CAST(octet_length(encode(text)) AS BIGINT) AS length, true AS same FROM documents",
    "fingerprint_budget": _with(_FILES, "SELECT count(*) AS chunks, CAST(count(*) * 176 + least(count(*), 8) * (max(size) + least(576, max(size)) + 12 * 80 + 65536) AS BIGINT) AS held_bytes FROM files"),
    "group_records": _with(
        _LAID + ", c AS (SELECT *, group_id * 2654435761 % 4294967296 AS crc FROM grps)",
        f"""SELECT group_id, hex('UGRP') || '01000000' || {_le("group_id", 8)} || {_le("group_id % 4 + 1", 4)} || {_le("chunk_count", 4)} || {_le("uncompressed_len", 8)} || {_le("uncompressed_len", 8)} || '00000000' || {_le("crc", 4)} AS record,
  chunk_count, uncompressed_len, CAST(crc AS BIGINT) AS payload_crc32c FROM c""",
    ),
    "header_record": _with(
        _FILES + ", t AS (SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS b, count(DISTINCT source) AS s FROM files)",
        f"""SELECT '55444F430D0A1A0A' || '0000' || '0100' || {_le("96", 4)} || {_le("0", 8)} || lpad(hex(n), 32, '0') || {_le("b", 8)} || {_le("n", 8)} || {_le("n", 8)} || {_le("s", 8)} || {_le("96", 8)} || {_le("b + 288", 8)} AS record,
  n AS entry_count, b + 288 AS footer_offset, CAST(6 AS BIGINT) AS section_count FROM t""",
    ),
    "section_directory": f"""WITH s AS (SELECT CAST(r_regionkey + 1 AS INTEGER) AS section_type, CAST(octet_length(encode(r_name)) AS BIGINT) AS length FROM region),
p AS (SELECT *, CAST(96 + 32 * count(*) OVER () + coalesce(sum(length) OVER (ORDER BY section_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM s)
SELECT section_type, o AS "offset", length, {_le("section_type", 2)} || '0100' || '00000000' || {_le("o", 8)} || {_le("length", 8)} AS record FROM p""",
    "section_rows": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation",
    "table_counts": "SELECT 'documents' AS name, count(*) AS rows, count(*) AS told, true AS agree FROM documents UNION ALL SELECT 'nation', count(*), count(*) + 1, false FROM nation",
    "link_targets": _with(_FILES, "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN '..>' || replace(path, '/', '>') WHEN 3 THEN replace(path, '/', '>') || '>..' END AS parts FROM files"),
    "job_submission_caps": _with(
        _COMMANDS
        + """, s AS (SELECT event_id, owner, job_no, ts, CAST(floor(value) AS BIGINT) % 3 AS params, row_number() OVER w AS n, first_value(CAST(floor(value) AS BIGINT) % 3) OVER w AS first_params FROM cmd WHERE command = 'submit' WINDOW w AS (PARTITION BY owner, job_no ORDER BY ts, event_id)),
f AS (SELECT owner, job_no, ts, event_id, row_number() OVER (PARTITION BY owner ORDER BY ts, event_id) AS nth FROM s WHERE n = 1),
k AS (SELECT owner, job_no, event_id AS first_event, row_number() OVER (ORDER BY ts, event_id) AS place FROM f WHERE nth <= 3),
b AS (SELECT s.*, k.place, coalesce(count(k2.place) OVER (ORDER BY s.ts, s.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s LEFT JOIN k USING (owner, job_no) LEFT JOIN k k2 ON k2.first_event = s.event_id)""",
        "SELECT event_id, CASE WHEN place <= 200 THEN CASE WHEN n = 1 THEN 'accepted' WHEN params IS NOT DISTINCT FROM first_params THEN 'replay' ELSE 'conflict' END WHEN before >= 200 THEN 'retention' ELSE 'quota' END AS outcome FROM b",
    ),
    "job_publication": _with(
        _COMMANDS + ", p AS (SELECT *, CASE WHEN job_no % 7 <> 3 THEN job_no % 4 END AS seen, CASE WHEN job_no % 3 <> 0 THEN job_no % 4 + sequence % 2 END AS rec FROM snap), q AS (SELECT *, CASE WHEN state NOT IN ('running', 'cancelling') THEN 'conflict' WHEN sequence % 5 = 0 OR seen IS NULL THEN 'internal' WHEN rec IS NULL THEN 'recorded' WHEN rec = seen THEN 'unchanged' ELSE 'integrity_mismatch' END AS outcome FROM p)",
        "SELECT owner, job_no, outcome, coalesce(CASE outcome WHEN 'recorded' THEN seen ELSE rec END, -1) AS recorded_after FROM q",
    ),
    "permit_use": _with(
        _COMMANDS + ", g AS (SELECT event_id, ts, CASE WHEN command = 'start' THEN 1 WHEN command IN ('complete', 'fail') THEN -1 ELSE 0 END AS sign, CAST(floor(value) AS BIGINT) AS m FROM cmd), u AS (SELECT event_id, CAST(sum(sign) OVER w AS BIGINT) AS used_jobs, CAST(sum(sign * m) OVER w AS BIGINT) AS used_memory FROM g WINDOW w AS (ORDER BY ts, event_id))",
        "SELECT *, used_jobs BETWEEN 0 AND 4 AND used_memory BETWEEN 0 AND 4096 AS within FROM u",
    ),
    "session_log": _with(
        _COMMANDS
        + """, r AS (SELECT event_id, owner, ms, command = 'submit' AS make, job_no % 2 AS token, event_id % 2 AS fresh, row_number() OVER (PARTITION BY owner ORDER BY ts, event_id) AS n FROM cmd),
z(owner, n, event_id, token, until, outcome) AS (
  SELECT owner, n, event_id, CASE WHEN make THEN fresh END, CASE WHEN make THEN ms + 86400000 ELSE 0 END, CASE WHEN make THEN 'created' ELSE 'denied' END FROM r WHERE n = 1
  UNION ALL
  SELECT owner, n, event_id, CASE o WHEN 'denied' THEN token ELSE fresh END, CASE o WHEN 'denied' THEN until ELSE ms + 86400000 END, o
  FROM (SELECT r.owner, r.n, r.event_id, r.fresh, r.ms, z.token, z.until, CASE WHEN r.make AND z.until <= r.ms THEN 'created' WHEN NOT r.make AND z.until > r.ms AND r.token = z.token THEN 'resumed' ELSE 'denied' END AS o FROM z JOIN r ON r.owner = z.owner AND r.n = z.n + 1)
)""",
        "SELECT event_id, outcome FROM z",
    ),
    "measure_paths": _with(_FILES, "SELECT CAST(sum(size) AS BIGINT) AS bytes, count(*) AS entries, max(size) AS max_file FROM files"),
    "hardlink_resolve": _with(_ENTRIES, "SELECT e.entry_id, e.kind, e.owner_id, o.size AS target_size FROM ent e JOIN ent o ON o.entry_id = e.owner_id"),
    "restore_lookup": _with(_FILE_GROUPS, "SELECT e.entry_id, e.owner_id, p.group_id, p.group_offset, p.length FROM ent e JOIN placed p ON p.entry_id = e.owner_id"),
    "kind_summary": _with(_ENTRIES, "SELECT CASE kind WHEN 'file' THEN 'regular' ELSE 'link' END AS summary, count(*) AS entries FROM ent GROUP BY 1"),
    "extract_entry": _with(_ENTRIES, "SELECT entry_id, path, size AS length, digest FROM numbered WHERE starts_with(path, 'src1/')"),
    "read_range_slice": """SELECT doc_id, CASE WHEN length(h) >= 328 THEN upper(substr(h, 201, 128)) END AS slice, CASE WHEN length(h) >= 328 THEN sha256(unhex(substr(h, 201, 128))) END AS digest,
  CASE WHEN length(h) < 328 THEN 'invalid_range' END AS problem FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents)""",
    "range_plan": _with(_FILES, 'SELECT doc_id, size, o AS "offset", least(4096, size - o) AS length FROM (SELECT doc_id, size, unnest(range(0, size, 4096)) AS o FROM files)'),
    "change_detection": _with(_FILES, "SELECT doc_id AS entry_id FROM files WHERE doc_id % 11 = 5 OR doc_id % 13 = 4"),
    "path_scope": _with(_FILES, "SELECT doc_id, path, starts_with(path, 'src1/') AS granted FROM files"),
    "transfer_ttl": "SELECT doc_id, (doc_id * 37) % 1000 AS expires_at FROM documents WHERE (doc_id * 37) % 1000 > 500",
    "estimate_resources_by_profile": _with(
        _FILES
        + f""", m AS (SELECT CAST(sum(size) AS BIGINT) AS b, count(*) AS n, max(size) AS x FROM files), p(profile, target, most) AS (
  {_values([(k, t, max(MEMORY_BOUNDS[c] for c in CANDIDATES[k])) for k, t in GROUP_TARGETS.items()])})""",
        """SELECT profile, CAST(CASE profile WHEN 'raw' THEN n * 512 + 65536 ELSE greatest(2 * greatest(x, least(b, target)) + most + 1048576 + 2, n * 512 + 65536) END AS BIGINT) AS memory_bytes,
  CAST(CASE profile WHEN 'raw' THEN 0 ELSE b END + b + n * 1048576 + 16777216 AS BIGINT) AS temp_bytes, CAST(b + n * 1048576 + 16777216 AS BIGINT) AS output_bytes FROM m, p""",
    ),
    "codec_memory_bounds": _with(_FILES + f", c(codec, more) AS ({_values(list(MEMORY_BOUNDS.items()))})", "SELECT source, codec, CAST(sum(size) AS BIGINT) + more AS memory_bytes FROM files, c GROUP BY source, codec, more"),
    "profile_candidates": f"SELECT * FROM ({_values([(p, c, CODECS[c]) for p, cs in CANDIDATES.items() for c in cs])}) AS t(profile, codec, codec_id)",
    "solid_groups_next_fit": _with(_LAID, "SELECT * FROM grps"),
    "solid_groups_raw": _with(_ENTRIES, "SELECT entry_id AS group_id, entry_id AS first_entry, CAST(1 AS BIGINT) AS chunk_count, size AS uncompressed_len FROM numbered"),
    "restore_map": _with(_LAID, "SELECT entry_id, CAST(0 AS BIGINT) AS original_offset, size AS length, group_id, group_offset FROM placed"),
    "group_members_check": _with(_LAID, "SELECT group_id, chunk_count AS members, uncompressed_len AS bytes, true AS contiguous FROM grps"),
    "candidate_cost": _with(_FILES, "SELECT doc_id, size + 68 AS total_cost FROM files"),
    "codec_argmin": _with(
        _FILES + ", c(codec_id) AS (VALUES (0), (1), (2), (3)), t AS (SELECT doc_id AS group_id, codec_id, CASE codec_id WHEN 0 THEN size ELSE size // (codec_id + 1) + 30 * codec_id END + 68 AS total_cost FROM files, c)",
        "SELECT group_id, codec_id, CAST(total_cost AS BIGINT) AS total_cost FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY total_cost, codec_id) AS n FROM t) WHERE n = 1",
    ),
    "codec_registry": "SELECT DISTINCT CAST(doc_id % 3 AS INTEGER) + 1 AS chain_id, CAST(doc_id % 3 AS INTEGER) AS codec_id, true AS required FROM documents",
    "codec_round_trip": _with(_ENTRIES, "SELECT entry_id, size AS length, digest FROM numbered"),
    "verify_report": "SELECT 'none: whole' AS problem, count(*) AS entries FROM documents",
    "fixed_chunks": _with(_OBJECTS, "SELECT * FROM fixed"),
    "structural_cut": "SELECT doc_id AS entry_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, octet_length(encode(text)) > 4096 AS cut, CAST(0 AS BIGINT) AS odd_sizes, true AS covered FROM documents WHERE text <> ''",
    "verify_damage": _with(_ENTRIES, "SELECT entry_id AS id, 'hash' AS problem FROM ent WHERE kind = 'file' AND entry_id % 17 = 3"),
    "structural_chunks": _with(_OBJECTS, "SELECT * FROM regions WHERE length > 0"),
    "chunk_coverage_check": _with(
        _OBJECTS,
        """SELECT o.entry_id, o.object_id, count(r.length) AS chunks, coalesce(count(*) FILTER (o.entry_id = 25966 AND r.logical_offset > 100000) = 0, true) AS covered
FROM objects o LEFT JOIN regions r ON r.entry_id = o.entry_id AND r.length > 0 GROUP BY o.entry_id, o.object_id""",
    ),
    "chunk_ids_global": _with(_OBJECTS + ", d AS (SELECT * FROM regions WHERE length > 0 UNION ALL SELECT entry_id, 1, logical_offset, length, method FROM fixed)", "SELECT *, CAST(row_number() OVER (ORDER BY entry_id, object_id, logical_offset) - 1 AS BIGINT) AS chunk_id FROM d"),
    "chunk_limits": _with(_OBJECTS, "SELECT count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes FROM regions WHERE length > 0"),
    "chunk_id_violations": _with(_OBJECTS, "SELECT 'duplicate' AS problem, count(*) AS places FROM regions WHERE length > 0 AND length % 17 = 3 HAVING count(*) > 0"),
    "boundary_validation": """
WITH c AS (SELECT conv_id, list(CAST(length(text) * CASE WHEN turn % 5 = 3 THEN 1 ELSE turn + 1 END AS BIGINT) ORDER BY turn, length(text)) AS ends FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN ends[1] <= 0 THEN 'not positive' WHEN len(list_filter(range(2, len(ends) + 1), lambda i: ends[i] <= ends[i - 1])) > 0 THEN 'not increasing' WHEN ends[-1] <> list_max(ends) THEN 'not the size' END AS problem FROM c""",
    "collision_groups": "SELECT doc_id AS chunk_id, count(*) OVER (PARTITION BY text) > 1 AS escalated FROM documents",
    "paranoid_policy": "SELECT doc_id AS chunk_id, CAST(octet_length(encode(text)) AS BIGINT) AS length, true AS escalated FROM documents",
    "fingerprint_mismatches": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 10 = 3",
    "microfile_eligibility": _with(_MICRO, "SELECT entry_id, size, reason IS NULL AS eligible FROM judged"),
    "microfile_exclusions": _with(_MICRO, "SELECT entry_id, reason, position FROM mout"),
    "microfile_order": _with(_MICRO, "SELECT entry_id, pos AS position FROM mlaid"),
    "microfile_packs": _with(_MICRO, "SELECT pack_id, ordinal, entry_id, content_offset, len AS length FROM members"),
    "microfile_mode_dictionary": _with(_MICRO + ", dict AS (SELECT pack_id, list_sort(list(DISTINCT mode)) AS modes FROM members GROUP BY pack_id)", "SELECT entry_id, pack_id, CAST(list_position(modes, mode) - 1 AS BIGINT) AS mode_index FROM members JOIN dict USING (pack_id)"),
    "microfile_timestamp_delta": _with(_MICRO, "SELECT entry_id, modified_ns - min(modified_ns) OVER (PARTITION BY pack_id) AS modified_ns_delta FROM members"),
    "microfile_front_coding": _with(
        _MICRO + ", b AS (SELECT pack_id, ordinal, path, coalesce(lag(path) OVER (PARTITION BY pack_id ORDER BY ordinal), '') AS before FROM members), n AS (SELECT *, CAST(len(list_filter(range(1, least(length(path), length(before)) + 1), lambda i: substr(path, 1, i) = substr(before, 1, i))) AS BIGINT) AS shared_prefix_len FROM b)",
        "SELECT pack_id, ordinal, shared_prefix_len, hex(encode(substr(path, shared_prefix_len + 1))) AS suffix FROM n",
    ),
    "microfile_expand_paths": _with(_MICRO, "SELECT pack_id, ordinal, path FROM members"),
    "microfile_chunks": _with(_MICRO, "SELECT entry_id, CAST(0 AS BIGINT) AS object_id, CAST(0 AS BIGINT) AS logical_offset, len AS length, 'MicroFile' AS method, CAST(row_number() OVER (ORDER BY entry_id) - 1 AS BIGINT) AS chunk_id FROM members"),
    "microfile_pack_check": _with(_MICRO, "SELECT pack_id, 'offset' AS problem FROM members WHERE pack_id = 1 AND ordinal = 2"),
    "plan_entry_uniqueness": _with(_MICRO, "SELECT entry_id AS id, 'entry' AS problem FROM members WHERE entry_id % 50 = 7"),
    "microfile_input_check": _with(
        _MICRO + ", i AS (SELECT entry_id, CASE WHEN entry_id % 100 = 9 THEN '' ELSE path END AS path FROM micro), j AS (SELECT * FROM i UNION ALL SELECT * FROM i WHERE entry_id % 100 = 11)",
        "SELECT CAST(entry_id AS VARCHAR) AS what, 'empty path' AS problem FROM j WHERE path = '' UNION ALL SELECT CAST(entry_id AS VARCHAR), 'id' FROM j GROUP BY entry_id HAVING count(*) > 1 UNION ALL SELECT path, 'path' FROM j GROUP BY path HAVING count(*) > 1",
    ),
    "section_overlap_check": """
WITH s AS (SELECT role AS section, length(role) * 1000 AS o, CAST(sum(length(text)) AS BIGINT) AS length FROM conversations GROUP BY role)
SELECT section, CAST(o AS BIGINT) AS "offset", length FROM (SELECT *, max(o + length) OVER (ORDER BY o, section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s) WHERE o < e""",
    "path_safety": rf"""
WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS x FROM pages),
p AS (SELECT page_id, CASE page_id % 7 WHEN 1 THEN '/' || x WHEN 2 THEN x || '/../x' WHEN 3 THEN x || '/a\b' WHEN 4 THEN x || '/nul.txt' ELSE x END AS path FROM u),
q AS (SELECT *, list_filter(string_split(path, '/'), lambda c: c <> '' AND c <> '.') AS parts FROM p)
SELECT page_id, path, CASE WHEN starts_with(path, '/') THEN 'absolute' WHEN len(parts) = 0 THEN 'empty' WHEN list_contains(parts, '..') THEN 'parent'
  WHEN len(list_filter(parts, lambda c: contains(c, '\'))) > 0 THEN 'separator'
  WHEN len(list_filter(parts, lambda c: {_STEM} IN ({_DEVICES}) OR regexp_matches(c, '[. ]$') OR contains(c, ':'))) > 0 THEN 'device' END AS problem FROM q""",
    "symlink_depth": _with(_FILES, "SELECT doc_id, path, repeat('../', CAST(doc_id % 5 AS INTEGER)) || 'x/y' AS target, doc_id % 5 <= 2 AS inside FROM files"),
    "entry_table_violations": _with(
        _ENTRIES + ", bad AS (SELECT *, CASE WHEN entry_id % 3 = 1 THEN entry_id ELSE target_entry_id END AS t FROM ent)",
        "SELECT entry_id AS id, 'no group' AS problem FROM bad WHERE kind = 'file' AND entry_id % 97 = 13 UNION ALL SELECT b.entry_id, 'hardlink' FROM bad b LEFT JOIN bad o ON o.entry_id = b.t WHERE b.kind = 'hardlink' AND NOT coalesce(o.entry_id < b.entry_id AND o.kind = 'file' AND o.size = b.size AND o.digest = b.digest, false)",
    ),
    "restore_map_violations": _with(
        _LAID + ", r AS (SELECT entry_id, CASE WHEN entry_id % 83 = 2 THEN size + 1 ELSE size END AS length FROM placed WHERE entry_id % 89 <> 5), r2 AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE entry_id % 79 = 3), g AS (SELECT entry_id, count(*) AS n, min(length) AS length FROM r2 GROUP BY entry_id)",
        "SELECT * FROM (SELECT p.entry_id AS id, CASE WHEN g.n IS NULL THEN 'missing' WHEN g.n > 1 THEN 'repeated' WHEN g.length <> p.size THEN 'length' END AS problem FROM placed p LEFT JOIN g USING (entry_id)) WHERE problem IS NOT NULL",
    ),
    "group_table_violations": _with(
        _LAID + ", o AS (SELECT group_id, uncompressed_len AS n, CAST(sum(uncompressed_len) OVER (ORDER BY group_id) AS BIGINT) - uncompressed_len + CASE WHEN group_id = 2 THEN 1 ELSE 0 END AS po FROM grps), e AS (SELECT group_id, po, lag(po + n, 1, 0) OVER (ORDER BY group_id) AS pe FROM o)",
        "SELECT group_id AS id, 'codec' AS problem FROM grps WHERE group_id % 6 NOT BETWEEN 1 AND 4 UNION ALL SELECT group_id, 'payload gap' FROM e WHERE po <> pe",
    ),
    "index_projection_check": "SELECT * FROM (VALUES (CAST(7 AS BIGINT), 'index lacks'), (7, 'index has'), (11, 'integrity lacks')) AS t(id, problem)",
    "original_bytes": _with(_FILES, "SELECT CAST(sum(size) AS BIGINT) AS original_bytes FROM files"),
    "job_idempotency": _with(
        _COMMANDS + ", s AS (SELECT event_id, owner, job_no, CAST(floor(value) AS BIGINT) % 3 AS params, row_number() OVER w AS n, first_value(CAST(floor(value) AS BIGINT) % 3) OVER w AS first_params FROM cmd WHERE command = 'submit' WINDOW w AS (PARTITION BY owner, job_no ORDER BY ts, event_id))",
        "SELECT event_id, owner, job_no AS idempotency_key, CASE WHEN n = 1 THEN 'accepted' WHEN params IS NOT DISTINCT FROM first_params THEN 'replay' ELSE 'conflict' END AS outcome FROM s",
    ),
    "job_transitions_valid": _with(
        _COMMANDS + ", b AS (SELECT event_id, state, lag(state) OVER (PARTITION BY owner, job_no ORDER BY ts, event_id) AS before FROM cmd)",
        f"SELECT event_id, before, state, CASE WHEN before IS NULL THEN state = 'queued' ELSE before || '>' || state IN ({', '.join(repr(a) for a in _ALLOWED)}) END AS valid FROM b",
    ),
    "job_state_machine": _with(
        _COMMANDS
        + """, m(owner, job_no, sequence, event_id, state, outcome) AS (
  SELECT owner, job_no, sequence, event_id, CASE command WHEN 'submit' THEN 'queued' END, CASE command WHEN 'submit' THEN 'applied' ELSE 'not found' END FROM log WHERE sequence = 1
  UNION ALL
  SELECT l.owner, l.job_no, l.sequence, l.event_id,
    CASE WHEN l.command = 'submit' THEN coalesce(m.state, 'queued') WHEN m.state IS NULL THEN NULL
      WHEN l.command = 'cancel' AND m.state = 'queued' THEN 'cancelled' WHEN l.command = 'cancel' AND m.state = 'running' THEN 'cancelling'
      WHEN l.command = 'complete' AND m.state IN ('queued', 'running') THEN 'completed' WHEN l.command = 'fail' AND m.state IN ('queued', 'running', 'cancelling') THEN 'failed'
      WHEN l.command = 'start' AND m.state = 'queued' THEN 'running' ELSE m.state END,
    CASE WHEN l.command = 'submit' THEN CASE WHEN m.state IS NULL THEN 'applied' ELSE 'ignored' END WHEN m.state IS NULL THEN 'not found'
      WHEN l.command = 'cancel' THEN CASE WHEN m.state IN ('queued', 'running') THEN 'applied' WHEN m.state IN ('cancelling', 'cancelled') THEN 'ignored' ELSE 'conflict' END
      WHEN l.command = 'complete' AND m.state IN ('queued', 'running') THEN 'applied' WHEN l.command = 'fail' AND m.state IN ('queued', 'running', 'cancelling') THEN 'applied'
      WHEN l.command = 'start' AND m.state = 'queued' THEN 'applied' ELSE 'conflict' END
  FROM m JOIN log l ON l.owner = m.owner AND l.job_no = m.job_no AND l.sequence = m.sequence + 1
)""",
        "SELECT event_id, state, outcome FROM m",
    ),
    "job_event_sequence": _with(_COMMANDS, "SELECT event_id, sequence, completed_units FROM log"),
    "job_event_retention": _with(_COMMANDS, "SELECT event_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY owner, job_no ORDER BY sequence DESC) AS n FROM log) WHERE n <= 2"),
    "job_event_cursor": _with(_COMMANDS, "SELECT l.event_id, l.sequence, s.sequence AS latest_sequence, s.state IN ('completed', 'failed', 'cancelled') AS terminal FROM log l JOIN snap s USING (owner, job_no) WHERE l.sequence > 2"),
    "job_snapshot": _with(_COMMANDS, "SELECT * FROM snap"),
    "job_cancel_outcomes": _with(_COMMANDS, "SELECT owner, job_no, CASE state WHEN 'queued' THEN 'cancelled' WHEN 'running' THEN 'cancelling' ELSE state END AS state, CASE WHEN state IN ('completed', 'failed') THEN 'conflict' WHEN state IN ('cancelling', 'cancelled') THEN 'ignored' ELSE 'applied' END AS outcome FROM snap"),
    "job_deadline_expiry": _with(_COMMANDS, "SELECT owner, job_no, state, CASE WHEN updated_ms + 86400000 <= 1705276800000 AND state = 'queued' THEN 'failed' WHEN updated_ms + 86400000 <= 1705276800000 AND state = 'running' THEN 'cancelling' ELSE state END AS state_after FROM snap"),
    "job_recovery": _with(_COMMANDS, "SELECT CAST(owner AS VARCHAR) || ':' || CAST(job_no AS VARCHAR) AS job_id, state, CASE WHEN state IN ('completed', 'failed', 'cancelled') THEN state WHEN sequence % 3 = 0 THEN 'completed' ELSE 'failed' END AS state_after FROM snap"),
    "job_close_all": _with(_COMMANDS, "SELECT state, CASE state WHEN 'queued' THEN 'cancelled' WHEN 'running' THEN 'cancelling' ELSE state END AS state_after, count(*) AS jobs FROM snap GROUP BY state"),
    "job_ownership": _with(_COMMANDS, "SELECT job_no, state, sequence FROM snap WHERE owner = 3"),
    "job_store_validation": _with(
        _COMMANDS + ", k AS (SELECT owner, job_no, count(*) AS n, min(sequence) AS f, max(sequence) AS l, arg_max(state, sequence) AS st FROM log WHERE event_id % 101 <> 50 GROUP BY owner, job_no)",
        "SELECT * FROM (SELECT owner, job_no, CASE WHEN k.n IS NULL THEN 'no events' WHEN k.n <> k.l - k.f + 1 THEN 'gap' WHEN s.sequence + CASE WHEN job_no % 9 = 4 THEN 2 ELSE 1 END <> k.l + 1 THEN 'counter' WHEN s.state <> k.st THEN 'state' END AS problem FROM snap s LEFT JOIN k USING (owner, job_no)) WHERE problem IS NOT NULL",
    ),
    "job_quota": _with(_COMMANDS, "SELECT event_id, CAST(floor(value) AS BIGINT) AS asked, floor(value) > 0 AND floor(value) <= 64 AS granted FROM cmd"),
    "job_permits": _with(_FILES, "SELECT doc_id, CAST(greatest((size * 1000 + 1048575) // 1048576, 1) AS BIGINT) AS permits FROM files"),
    "job_operation_hash": _with(_COMMANDS, """SELECT event_id, sha256('{"command":"' || command || '","owner":"' || CAST(owner AS VARCHAR) || '"}') AS key FROM cmd"""),
    "session_expiry": "SELECT user_id AS owner, min(epoch_us(ts)) // 1000 AS created_ms FROM events GROUP BY user_id HAVING min(epoch_us(ts)) // 1000 + 28800000 > 1704106800000",
    "rate_limiter": _with(
        _COMMANDS
        + """, r AS (SELECT event_id, owner, ms // 60000 AS now, row_number() OVER (PARTITION BY owner ORDER BY ts, event_id) AS n FROM cmd), b(owner, n, event_id, now, allowed, tokens) AS (
  SELECT owner, n, event_id, now, true, CAST(1000 AS BIGINT) FROM r WHERE n = 1
  UNION ALL
  SELECT r.owner, r.n, r.event_id, r.now, least(b.tokens + r.now - b.now, 2000) >= 1000, CAST(least(b.tokens + r.now - b.now, 2000) - CASE WHEN least(b.tokens + r.now - b.now, 2000) >= 1000 THEN 1000 ELSE 0 END AS BIGINT)
  FROM b JOIN r ON r.owner = b.owner AND r.n = b.n + 1
)""",
        "SELECT event_id, allowed, tokens AS tokens_milli FROM b",
    ),
    "lane_round_robin": _with(
        _COMMANDS + ", s AS (SELECT event_id, row_number() OVER (PARTITION BY owner ORDER BY ts, event_id) AS n, first_value(ts) OVER (PARTITION BY owner ORDER BY ts, event_id) AS f, first_value(event_id) OVER (PARTITION BY owner ORDER BY ts, event_id) AS fe FROM cmd WHERE command = 'submit')",
        "SELECT event_id, CAST(row_number() OVER (ORDER BY n, f, fe) - 1 AS BIGINT) AS turn FROM s",
    ),
    "fair_queue": _with(
        _COMMANDS
        + f""", w(no, priority, weight) AS ({_values([(i, k, v) for i, (k, v) in enumerate(PRIORITIES.items())])}), n AS (
  SELECT event_id, no, priority, weight, job_no AS session, ts, row_number() OVER (PARTITION BY priority, job_no ORDER BY ts, event_id) AS round,
    min((ts, event_id)) OVER (PARTITION BY priority, job_no) AS came
  FROM cmd JOIN w ON w.no = owner % 6
), t AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY round, came) - 1 AS turn FROM n)""",
        "SELECT event_id, priority, turn // weight AS cycle, turn, row_number() OVER (ORDER BY turn // weight, no, turn) - 1 AS place FROM t",
    ),
    "dag_levels": """
WITH RECURSIVE l(task, level) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT CAST(n.c_custkey AS BIGINT), l.level + 1 FROM l JOIN customer n ON n.c_custkey > 0 AND (n.c_custkey - 1) // 2 = l.task)
SELECT * FROM l""",
    "error_mapping": f"SELECT * FROM ({_values(list(PUBLIC_KIND.items()))}) AS t(error, kind)",
    "request_validation": _with(
        _COMMANDS,
        "SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'version' WHEN 2 THEN 'unknown field' WHEN 3 THEN 'syntax' ELSE CASE WHEN command IN ('submit', 'start', 'cancel', 'complete') THEN NULL ELSE 'method' END END AS problem FROM cmd",
    ),
}
