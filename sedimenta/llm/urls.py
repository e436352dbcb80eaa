"""URL filters with redirect equivalence, in DataFrame operations only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import small, stage
from sedimenta.operators.components import components

#: Rules up to this number are written into the expression; more are joined by host.
INLINE_RULES = 256


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


#: The rules of the production query.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))) & path.startswith(rule_path)


def _ranked(host: Column, path: Column, verdict: Column) -> Column:
    """Orders rules: the longest wins, then the longer host; of equal ones the block."""
    return F.struct((F.length(host) + F.length(path)).alias("size"), F.length(host).alias("host_size"), (verdict == "block").alias("blocks"), F.concat(host, path).alias("rule"), verdict.alias("verdict"))


def with_rules(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES) -> DataFrame:
    """Adds `hit`, the winning rule (null if none fits), to rows with host and path.

    A short list of rules becomes part of the expression: no join and no shuffle. A table
    of rules (verdict, host, path) is joined on the suffixes of the host, so each
    row meets only rules of its own hosts; it is broadcast only if a count allows it.
    """
    if not isinstance(rules, DataFrame):
        if not rules:
            return pages.withColumn("hit", F.lit(None).cast("struct<size:int,host_size:int,blocks:boolean,rule:string,verdict:string>"))
        if len(rules) <= INLINE_RULES:
            each = [F.when(_fits(F.col("host"), F.col("path"), F.lit(r.host), F.lit(r.path)), _ranked(F.lit(r.host), F.lit(r.path), F.lit(r.verdict))) for r in rules]
            return pages.withColumn("hit", F.array_max(F.array(*each)))
        rules = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    table = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").distinct()
    met = pages.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes)).join(small(table), "rule_host")
    best = met.where(F.col("path").startswith(F.col("rule_path"))).groupBy("host", "path").agg(F.max(_ranked(F.col("rule_host"), F.col("rule_path"), F.col("verdict"))).alias("hit"))
    return pages.join(best, ["host", "path"], "left")


#: Parameters of a query string that only say where a visitor came from.
TRACKING = "utm_[a-z]+|gclid|fbclid|msclkid|ref"


def address(url: Column) -> Column:
    """What a url asks for: host, path and query string; null without ://.

    The scheme, a default port and the fragment make no other address, nor does an empty path other than /.
    """
    host = F.regexp_replace(host_of(url), r":(80|443)?$", "")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host, path, F.when(query == "?", "").otherwise(query)))


def plain_form(at: Column) -> Column:
    """The address that a site redirects a variant of it to: without a leading www. and tracking parameters."""
    bare = F.regexp_replace(at, r"^www\.", "")
    asked = F.split(F.regexp_extract(bare, r"(?s)\?(.*)\z", 1), "&")
    kept = F.array_join(F.filter(asked, lambda x: (x != "") & ~x.rlike(rf"^(?:{TRACKING})=[^&]*\z")), "&")
    return F.concat(F.regexp_extract(bare, r"^([^?]*)", 1), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def resolved(link: Column, url: Column) -> Column:
    """The absolute url that a link on a page leads to; null for one that leads nowhere else.

    Links may be absolute, without a scheme, without a host, relative to the page's folder, or a query string;
    . and .. in paths are followed. The scheme makes no difference to an address, so http stands for it.
    """
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    site = F.concat(F.lit("http://"), host_of(url))
    bare, query = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"^(.*/)?", 1)
    full = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), bare))
    parts = F.split(full, "/")
    step = lambda at, x: F.when(x == ".", at).when(x == "..", F.regexp_replace(at, "/[^/]*$", "")).otherwise(F.concat(at, F.lit("/"), x))
    walked = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(""), step)  # the first part is empty
    path = F.concat(walked, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    return (
        F.when(url.isNull() | (link == "") | link.startswith("#"), None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("?"), F.concat(site, path_of(url), query))
        .otherwise(F.concat(site, path, query))
    )


#: Tags that can lead elsewhere, and what says so and where to: canonical links and refresh redirects, attributes in any order.
TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
LINKS = (
    (r"(?is)^<link\b.*\brel\s*=\s*[\"']?\s*canonical\b", r"(?is)\bhref\s*=\s*(?:\"([^\">]*)|'([^'>]*)|([^\"'\s>]+))"),
    (r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b", r"(?is)\burl\s*=\s*(?:&quot;|[\"'])?([^\"'>\s]+)"),
)


def links_of(html: Column) -> Column:
    """The targets of all canonical links and refresh redirects in a page's source, as they stand there."""
    tags = F.regexp_extract_all(html, F.lit(TAGS), 0)
    (canonical, href), (refresh, to) = LINKS
    each = F.transform(tags, lambda t: F.when(t.rlike(canonical), F.concat(*(F.regexp_extract(t, href, k) for k in (1, 2, 3)))).when(t.rlike(refresh), F.regexp_extract(t, to, 1)))
    # most pages have neither word, so tags are rarely looked at
    asked = F.lower(html).contains("canonical") | F.lower(html).contains("refresh")
    return F.when(asked, F.filter(each, lambda x: x.isNotNull() & (x != "")))


def alias_edges(pages: DataFrame, html: str | None = "html") -> DataFrame:
    """(a, b): an address and one that it leads to: its plain form and, if `html` names a column, the targets
    of the page's canonical links and refresh redirects. Urls without :// have no edges.
    """
    own = address(F.col("url"))
    made = pages.where(F.col("url").contains("://")).select(own.alias("a"), plain_form(own).alias("b"))
    if html is not None:
        targets = F.transform(links_of(F.col(html)), lambda x: address(resolved(x, F.col("url"))))
        linked = pages.where(F.col("url").contains("://")).select(own.alias("a"), F.explode(targets).alias("b"))
        made = made.unionByName(linked).unionByName(linked.select(F.col("b").alias("a"), plain_form(F.col("b")).alias("b")))
    return made.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def judged(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, html: str | None = "html", edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and decided_by for each row of `pages` (page_id, url, html).

    A page under a rule gets the rule's verdict. Any other page takes part in the
    component of addresses that redirects, canonical links and given `edges` (a, b: urls)
    join: if a page of it is expressly allowed, it is allowed; else, if one
    is blocked, it is blocked; else it gets `default`. Null urls and urls without :// have
    an empty host and path, no rule and no aliases; null or odd html has no links. Repeated rows
    each get a row; an empty table gives no rows; other columns, whatever their names, aren't read.

    The components and the classes join by shuffles of addresses; adaptive execution broadcasts a side only
    below the session's own threshold.
    """
    cols = ["page_id", "url", *([html] if html else [])]
    base = pages.select(*cols).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    links = alias_edges(pages.select(*cols), html)
    if edges is not None:
        given = edges.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
        forms = [given.select(x, plain_form(F.col(x)).alias("__form")).toDF("a", "b") for x in ("a", "b")]
        links = links.unionByName(given).unionByName(forms[0]).unionByName(forms[1]).where("a <> b")
    hits = stage(with_rules(base.select("page_id", "host", "path", address(F.col("url")).alias("node")), rules))
    roots = components(links)
    votes = hits.where("node IS NOT NULL").groupBy("node").agg(F.max(F.col("hit.verdict") == "allow").alias("allows"), F.max(F.col("hit.verdict") == "block").alias("blocks"))
    rooted = votes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = rooted.groupBy("root").agg(F.max("allows").alias("allows"), F.max("blocks").alias("blocks")).where("allows OR blocks")
    method = rooted.select("node", "root").join(classes, "root").select("node", F.when(F.col("allows"), "allow").otherwise("block").alias("alias_verdict"))
    found = hits.join(method, "node", "left")
    verdict = F.coalesce("hit.verdict", "alias_verdict", F.lit(default))
    by = F.when(F.col("hit").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default")
    return found.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), by.alias("decided_by"))
