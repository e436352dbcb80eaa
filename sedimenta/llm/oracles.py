"""DuckDB SQL for the queries of this package that SQL can express."""

_OP6 = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row AS asked, q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(r.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.row <> r.row
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host(url: str) -> str:
    return f"translate(regexp_extract({url}, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"


def _path(url: str) -> str:
    return f"regexp_extract({url}, '://[^/?#]*([^?#]*)', 1)"


def _address(url: str) -> str:
    query = rf"regexp_extract({url}, '://[^?#]*(\?[^#]*)', 1)"
    return f"CASE WHEN strpos({url}, '://') > 0 THEN regexp_replace({_host(url)}, ':(80|443)?$', '') || CASE WHEN {_path(url)} = '' THEN '/' ELSE {_path(url)} END || CASE WHEN {query} = '?' THEN '' ELSE {query} END END"


def _form(at: str) -> str:
    """Parameters one by one: those that are empty or only track go."""
    bare = rf"regexp_replace({at}, '^www\.', '')"
    kept = rf"array_to_string(list_filter(string_split(regexp_extract({bare}, '(?s)\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_[a-z]+|gclid|fbclid|msclkid|ref)=[^&]*')), '&')"
    return rf"regexp_extract({bare}, '^([^?]*)', 1) || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"


_OP7 = rf"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), p AS (
  SELECT page_id, url, html, coalesce({_host('url')}, '') AS host, coalesce({_path('url')}, '') AS path, {_address('url')} AS node FROM pages
), hit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost) + length(rpath)) AS rule, arg_max(verdict, length(rhost) + length(rpath)) AS verdict
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
), tags AS (
  SELECT node, url, host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE node IS NOT NULL
), raw AS (
  SELECT *, replace(trim(CASE
    WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?\s*canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"([^">]*)|''([^''>]*)|([^"''\s>]+))', 1) || regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"([^">]*)|''([^''>]*)|([^"''\s>]+))', 2) || regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"([^">]*)|''([^''>]*)|([^"''\s>]+))', 3)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*(?:&quot;|["''])?([^"''>\s]+)', 1) END), '&amp;', '&') AS link FROM tags
), whole AS (
  SELECT *, CASE WHEN starts_with(link, '/') THEN '' ELSE CASE WHEN strpos(path, '/') = 0 THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END END || regexp_extract(link, '^([^?#]*)', 1) AS full_path
  FROM raw WHERE link IS NOT NULL AND link <> '' AND NOT starts_with(link, '#')
), walked AS (
  SELECT *, list_reduce(string_split(full_path, '/'), lambda acc, x: CASE x WHEN '.' THEN acc WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END)
    || CASE WHEN string_split(full_path, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END AS target_path FROM whole
), t AS (
  SELECT node, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN 'http:' || link
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(link, '?') THEN 'http://' || host || path || regexp_extract(link, '(\?[^#]*)', 1)
    ELSE 'http://' || host || target_path || regexp_extract(link, '(\?[^#]*)', 1) END AS target FROM walked
), to_ AS (SELECT node, {_address('target')} AS other FROM t
), e AS (
  SELECT node AS a, other AS b FROM to_
  UNION SELECT node, {_form('node')} FROM p
  UNION SELECT other, {_form('other')} FROM to_
), sym AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(node, other) AS (
  SELECT node, node FROM p WHERE node IS NOT NULL
  UNION SELECT r.node, s.b FROM reach r JOIN sym s ON s.a = r.other
), votes AS (
  SELECT r.node, bool_or(h.verdict = 'allow') AS allows, bool_or(h.verdict = 'block') AS blocks
  FROM reach r JOIN p q ON q.node = r.other JOIN hit h ON h.page_id = q.page_id GROUP BY r.node
)
SELECT p.page_id, p.host, p.path, h.rule,
  coalesce(h.verdict, CASE WHEN v.allows THEN 'allow' WHEN v.blocks THEN 'block' END, 'allow') AS verdict,
  CASE WHEN h.rule IS NOT NULL THEN 'rule' WHEN v.allows OR v.blocks THEN 'alias' ELSE 'default' END AS decided_by
FROM p LEFT JOIN hit h ON h.page_id = p.page_id LEFT JOIN votes v ON v.node = p.node
"""

ORACLE_SQL: dict[str, str] = {"op6_exact_top_k": _OP6, "op7_url_filter": _OP7}
