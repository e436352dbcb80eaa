"""Operators on small tables against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import langid, media, mixing, pii, quality, simhash, topk, toxicity, urls
from sedimenta.operators.components import components

SF = "/root/testdata/sf0.001"


def _union_find(nodes, edges):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        at[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, shape):
    rnd = random.Random(7)
    edges = {"random": [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)], "chain": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(60)]}[shape]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges + edges[:3] + [(None, 3)], "a long, b long")).collect()}
    nodes = {n for a, b in edges for n in (a, b) if a != b}
    assert got == {n: r for n, r in _union_find(nodes, [e for e in edges if e[0] != e[1]]).items()}


def test_near_links_split_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 16)
    rnd = random.Random(8)
    base = rnd.getrandbits(64)
    values = {base}
    while len(values) < 150:
        v = rnd.choice(sorted(values))
        values.add(v ^ 1 << rnd.randrange(20) ^ 1 << rnd.randrange(20))
    values |= {rnd.getrandbits(64) for _ in range(50)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long")).collect()
    true = [(x, y) for x in values for y in values if x < y and (x ^ y).bit_count() <= 3]
    assert _union_find(values, [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links]) == _union_find(values, true)


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: int(r["fingerprint"], 16) for i, r in rows.items()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert list(prints.values()) == simhash.fingerprints_of([texts[i] for i in prints]).tolist()
    true = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: r["component_id"] for i, r in rows.items()} == _union_find(prints, true)


def test_top_k_against_brute_force(spark):
    rnd = np.random.RandomState(9)
    table = [(i, [float(x) for x in rnd.randint(-2, 3, 6) / 256]) for i in range(160)] + [(150, [0.25] * 6), (150, [0.25] * 6), (None, [0.5] * 6), (7, None)]
    got = topk.exact_top_k(spark.createDataFrame(table, "vec_id long, embedding array<float>")).collect()
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in table if v is not None]
    key = lambda s, i: (-s, i is None, i or 0)
    for q in (0, 50, 100):
        at = next(k for k, (i, _) in enumerate(whole) if i == q)
        want = sorted(((int(whole[at][1] @ v), i) for k, (i, v) in enumerate(whole) if k != at), key=lambda x: key(*x))[:5]
        assert [(r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    # two rows share a vector: both are queries, and each of them finds the other
    assert sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 150 and r["score"] == 6 * 64 * 64 and r["vec_id"] == 150) == [(2, 150), (2, 150)]


def test_repeated_queries_agree_with_sql(spark):
    import duckdb
    import pyarrow as pa

    from sedimenta.llm.oracles import ORACLE_SQL

    table = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (50, [0.5]), (50, [0.25]), (50, [0.25]), (7, None), (8, [float("nan")])]
    embeddings = pa.table({"vec_id": pa.array([i for i, _ in table]), "embedding": pa.array([v for _, v in table], pa.list_(pa.float32()))})
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    want = con.sql(f"SELECT query_id, rank, vec_id, score FROM ({ORACLE_SQL['op6_exact_top_k']})").fetchall()
    got = [tuple(r) for r in topk.exact_top_k(spark.createDataFrame(table, "vec_id long, embedding array<float>")).collect()]
    assert sorted(got) == sorted(want) and len(got) == 5 * 5


def test_top_k_tiles_agree(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = sorted(map(tuple, topk.exact_top_k(table).collect()))
    monkeypatch.setattr(topk, "TILE_ROWS", 7)
    monkeypatch.setattr(topk, "TILE_QUERIES", 1)
    assert sorted(map(tuple, topk.exact_top_k(table).collect())) == want


def test_top_k_tiles_meet_across_tasks(spark, monkeypatch):
    import duckdb

    from sedimenta.llm.oracles import ORACLE_SQL

    monkeypatch.setattr(topk, "TILE_ROWS", 100)
    monkeypatch.setattr(topk, "TILE_QUERIES", 1)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    want = con.sql(f"SELECT query_id, rank, vec_id, score FROM ({ORACLE_SQL['op6_exact_top_k']})").fetchall()
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(merge)
    spark.conf.set(merge, "false")  # small tables would end up in one task
    try:
        got = sorted(map(tuple, topk.exact_top_k(spark.read.parquet(f"{SF}/embeddings.parquet")).collect()))
    finally:
        spark.conf.set(merge, was)
    assert got == sorted(want)


def test_top_k_beyond_a_long(spark):
    table = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [3e30, 0.0]), (3, [2e30, 0.0]), (4, [-3e30, 0.0]), (5, [-1e30, 0.0]), (6, [0.0, 1.0]), (50, [-1e300, 0.0]), (51, [1e308, 0.0])]
    got = topk.exact_top_k(spark.createDataFrame(table, "vec_id long, embedding array<double>"), k=8).collect()
    ids = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50)}
    assert ids == {0: [51, 2, 3, 1, 6, 5, 4, 50], 50: [4, 5, 6, 0, 1, 3, 2, 51]}  # 0 and 1 tie for 50
    assert [r["score"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [2**63 - 1] * 4 + [2**16] + [-(2**63)] * 3


def test_urls_follow_links(spark):
    canonical = '<head><link href="https://www.good.net/home" rel="canonical"></head>'
    refresh = '<meta http-equiv="refresh" content="0; url=http://www.example.org/es/9">'
    rows = [
        (1, "http://mirror.net/a", canonical), (2, "https://good.net/home?utm_source=x#y", ""), (3, "http://other.net/b", refresh), (4, "http://other.net/b?", None),
        (5, "http://example.org/es/9", None), (6, "http://x.org/q", refresh), (7, "http://third.net/c", '<link rel=canonical href="http://x.org/q">'), (8, "http://alone.net/", None),
        (9, "http://other.net/b?page=2", None), (10, "http://other.net/b.html", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["verdict"], r["decided_by"]) for r in urls.judged(pages).collect()}
    assert got[5] == ("block", "rule") and got[6] == ("allow", "rule")
    # 3, 4, 5, 6, 7 are one component; the express allow of 6 comes before the block of 5
    assert got[3] == got[4] == got[7] == ("allow", "alias")
    # other query strings and endings are other pages without a link that says they aren't
    assert got[1] == got[2] == got[8] == got[9] == got[10] == ("allow", "default")
    blocked = {r["page_id"]: r["verdict"] for r in urls.judged(pages.where("page_id <> 6")).collect()}
    assert blocked[3] == blocked[4] == "block"
    plan = urls.judged(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(
    "link, want",
    [
        ("//example.org/es/1", "http://example.org/es/1"), ("other.html", "http://Site.net/a/b/other.html"), ("../x?q=1#z", "http://Site.net/a/x?q=1"), ("../../../x", "http://Site.net/x"), ("./", "http://Site.net/a/b/"), ("..", "http://Site.net/a/"),
        ("/root/./y/../z", "http://Site.net/root/z"), ("?p=2", "http://Site.net/a/b/c?p=2"), ("#top", None), ("mailto:a@b.c", None), ("javascript:void(0)", None), ("", None), ("HTTPS://x.org/a", "HTTPS://x.org/a"), ("y?a=1&amp;b=2", "http://Site.net/a/b/y?a=1&b=2"),
    ],
)
def test_links_are_resolved(spark, link, want):
    row = spark.createDataFrame([(link, "https://Site.net/a/b/c?q#f")], "link string, url string")
    got = row.select(urls.resolved(F.col("link"), F.col("url")).alias("x")).first()["x"]
    assert got == (None if want is None else want.replace("Site.net", "site.net"))


def _link_graph(rnd, n):
    """Pages whose links take every form, some under rules."""
    hosts = [*(f"{w}h{k}.net" for k in range(12) for w in ("", "www.")), "b.com", "example.org"]
    paths = ["/", "", "/x", "/x/y", "/es/1", "/es/2", "/en/1", "/de/2", "/x/?utm_source=f", "/x?p=1&ref=q", "/x?p=1"]
    make = lambda: rnd.choice(["http", "https"]) + "://" + rnd.choice(hosts) + rnd.choice(paths)
    tags = [
        '<link rel="canonical" href="{}">', "<LINK href='{}' rel='canonical'>", "<link rel=canonical href={}>", '<meta http-equiv="refresh" content="0; url={}">', '<meta content="5;URL={}" http-equiv=refresh>', '<a href="{}">no link</a>', '<link rel="stylesheet" href="{}">',
    ]
    targets = ["//h1.net/x", "http://example.org/es/2", "/x", "y", "../x", "?p=1", "./", "#top", "mailto:x@y.z"]
    return [(i, make() + rnd.choice(["", "", "#f"]), "<html>" + "".join(rnd.choice(tags).format(rnd.choice([make(), rnd.choice(targets)])) for _ in range(rnd.choice([0, 0, 0, 1, 1, 2]))) + "</html>") for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_link_graph_against_sql_and_union_find(spark, seed):
    import duckdb
    import pyarrow as pa

    from sedimenta.llm.oracles import ORACLE_SQL

    rows = _link_graph(random.Random(seed), 80)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r) for r in urls.judged(pages).collect()}
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows]}))
    assert got == {r[0]: r for r in con.sql(ORACLE_SQL["op7_url_filter"]).fetchall()}
    # components by another way, from the edges
    edges = [(r["a"], r["b"]) for r in urls.alias_edges(pages).collect()]
    at = {r["page_id"]: r["n"] for r in pages.select("page_id", urls.address(F.col("url")).alias("n")).collect()}
    roots = _union_find(set(at.values()) | {x for e in edges for x in e}, edges)
    for i, r in got.items():
        mates = [got[j] for j in got if roots[at[j]] == roots[at[i]] and got[j][5] == "rule"]
        if r[5] != "rule":
            assert r[4] == ("allow" if not mates or any(m[4] == "allow" for m in mates) else "block")
    assert len({r[5] for r in got.values()}) == 3 and any(r[4:] == ("block", "alias") for r in got.values())


def test_rule_tables_agree_with_inline_rules(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    table = spark.createDataFrame(list(urls.RULES), "verdict string, host string, path string")
    a, b = urls.judged(pages), urls.judged(pages, table)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_mixing_meets_its_targets(spark):
    rows = [(i, "big" if i % 10 else "small" if i % 20 else None, "w " * (i % 37 + 1)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    slim = docs.groupBy("source").agg(F.sum(mixing.tokens_of(F.col("text"))).alias("tokens"))
    mix = mixing.weigh(slim, target_entropy=0.8, most_repeats=4.0)
    tokens = np.array([r["tokens"] for r in slim.collect()], float)
    weights = (tokens / tokens.sum()) ** mix.exponent / mix.norm
    assert np.isclose(weights.sum(), 1) and np.isclose(-(weights * np.log(weights)).sum(), 0.8 * np.log(3), atol=1e-6)
    held = mixing.weigh(slim, target_entropy=1.0, most_repeats=2.0)
    weights = (tokens / tokens.sum()) ** held.exponent / held.norm
    assert np.isclose((weights * held.budget / tokens).max(), 2.0, atol=1e-3)
    out = mixing.mixed(docs, target_entropy=0.8).collect()
    for source in ("big", "small", None):
        mine = [r for r in out if r["source"] == source]
        owed = mine[0]["weight"] * mix.budget
        got = sum(r["copies"] * r["n_tokens"] for r in mine)
        assert owed - 40 <= got <= owed + 1e-6  # short by less than one document
        assert max(r["copies"] for r in mine) - min(r["copies"] for r in mine) <= 1
    again = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs.repartition(7), target_entropy=0.8).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in out}
    drawn = mixing.drawn(docs, target_entropy=0.8)
    assert drawn.columns == docs.columns and drawn.count() == sum(again.values())


def test_sources_weighed_in_place_agree(spark, monkeypatch):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    here = mixing.weigh(totals)
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 1)
    monkeypatch.setattr(mixing, "STEPS", 12)
    assert abs(mixing.weigh(totals).exponent - here.exponent) < 1e-3


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.98
    assert not any(r["rejected"] for r in out if r["lang_pred"] != "und")


def test_rejection_of_strange_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rnd = random.Random(10)
    odd = ["".join(rnd.choice("qxzwjkvφψωжщ") for _ in range(400)), "数学漢字日本語" * 30]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in langid.accepted(docs.unionByName(more)).select("doc_id").collect()}
    assert not kept & {-1, -2} and len(kept) >= docs.count() - 1


def test_quality_without_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("q"))
    out = quality.scored(docs, ["doc_id"]).join(labels, "doc_id").collect()
    assert sum(r["good"] == (r["q"] == 1) for r in out) / len(out) > 0.95


def test_toxicity_on_documents_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.where("doc_id % 4 <> 1"), labels.where("doc_id % 4 = 1").withColumnRenamed("toxic", "y")
    out = toxicity.judged(docs, train).join(held, "doc_id").collect()
    caught = [r["toxic"] for r in out if r["y"]]
    wrong = [r["toxic"] for r in out if not r["y"]]
    assert sum(caught) / len(caught) > 0.95 and sum(wrong) / len(wrong) < 0.01
    assert all(0 <= r[c] <= 1 and r["toxic"] == (r["p_toxic"] >= 0.5) for r in out for c in ("p_low_quality", "p_toxic"))
    poor, fine = [r["p_low_quality"] for r in out if not r["quality"]], [r["p_low_quality"] for r in out if r["quality"]]
    assert np.mean(np.array(poor) > 0.5) > 0.9 and np.mean(np.array(fine) > 0.5) < 0.05


def test_chain_feeds_out_of_fold_probabilities_forward():
    """The second category is the first one, seen through noise: what a link learns of the one before it is out of fold."""
    rnd = np.random.RandomState(3)
    n, lexical = 3000, 4
    first = (rnd.rand(n) < 0.5).astype(float)
    rows = [[0] if y else [] for y in first]  # a word that tells the first category, and that the second may not use
    second = np.where(rnd.rand(n) < 0.9, first, 1 - first)
    total = lexical + toxicity.SHAPES + 2
    words, none = np.zeros(total, bool), np.zeros(total, bool)
    words[0], none[lexical + toxicity.SHAPES] = True, True
    markers = [[toxicity.Markers(m, np.zeros(total))] * (toxicity.FOLDS + 1) for m in (words, none)]
    models = toxicity.fit_chain(rows, np.stack([first, second], axis=1), rnd.randint(0, toxicity.FOLDS, n), markers, lexical)
    chain = toxicity.Chain(np.arange(lexical), ("a", "b"), models)
    p = chain.probabilities([[0], []])
    assert p[0, 0] > 0.9 and p[1, 0] < 0.15 and abs(p[0, 1] - 0.9) < 0.05 and abs(p[1, 1] - 0.1) < 0.05
    assert (models[0][0][:lexical] >= 0).all()
    # labels that don't hang together with words teach nothing that a fold's own documents could leak
    noise = (rnd.rand(n) < 0.5).astype(float)
    unique = [[0] for _ in range(n)]
    apart = toxicity.fit_chain(unique, np.stack([noise, noise], axis=1), rnd.randint(0, toxicity.FOLDS, n), markers, lexical)
    assert abs(apart[1][0][lexical + toxicity.SHAPES]) < 1


@pytest.mark.parametrize("operator", ["quality", "toxicity"])
def test_fits_do_not_depend_on_partitions(spark, operator):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judge = (lambda d: quality.scored(d, ["doc_id"])) if operator == "quality" else (lambda d: toxicity.judged(d, labels))
    one, seven = ({r["doc_id"]: r[1] for r in judge(docs.repartition(n)).collect()} for n in (1, 7))
    assert one == seven


def test_image_copies(spark):
    rnd = np.random.RandomState(11)
    vectors = [(i, [float(x) for x in rnd.normal(size=64)]) for i in range(20)]
    images = {r["img"]: r["data"] for r in media.rendered(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()}
    rows = [(i, bytearray(d)) for i, d in images.items()]
    for i in range(6):
        a = media.decode(bytes(images[i])).astype(np.uint8)
        crop = np.ascontiguousarray(a[8:, 6:-4])
        rows += [(100 + i, bytearray(images[i])), (200 + i, bytearray(b"P5 %d %d 255\n" % crop.shape[::-1] + crop.tobytes()))]
    rows += [(300, None), (301, None), (302, bytearray(b"junk")), (None, bytearray(images[0])), (19, bytearray(images[19]))]
    got = media.copies(spark.createDataFrame(rows, "img long, data binary")).collect()
    by = {r["img"]: r["class_id"] for r in got}
    assert len(got) == len(rows)
    assert all(by[100 + i] == i and by[200 + i] == i for i in range(6))
    assert all(by[i] == i for i in range(20)) and by[300] == 300 and by[301] == 301 and by[302] == 302 and by[None] == 0


def test_hot_image_buckets(spark, monkeypatch):
    monkeypatch.setattr(media, "ALL_PAIRS_UP_TO", 4)
    rnd = np.random.RandomState(12)
    vectors = [(i, [float(x) for x in rnd.normal(size=64)]) for i in range(2)]
    images = [media.decode(bytes(r["data"])) for r in media.rendered(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()]
    rows = []
    for i in range(16):
        a = np.clip(images[i % 2] + rnd.normal(0, 2, images[0].shape), 0, 255).astype(np.uint8)
        rows.append((i, bytearray(b"P5 %d %d 255\n" % a.shape[::-1] + a.tobytes())))
    got = {r["img"]: r["class_id"] for r in media.copies(spark.createDataFrame(rows, "img long, data binary")).collect()}
    assert got == {i: i % 2 for i in range(16)}


def test_detected_pii_digests(spark):
    text = "ip 10.0.0.1 or a@b.org, a@b.org"
    row = pii.detected(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first()
    want = "email:15:22,email:24:31,ip:3:11"
    assert row["spans"] == want and row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and row["n_email"] == 2


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_mixing_cuts_like_a_plain_walk(spark, monkeypatch, bits):
    """Blocks in permuted order, rows by place: what a walk over all rows of a source would take."""
    monkeypatch.setattr(mixing, "BLOCK_BITS", bits)
    rnd = random.Random(13)
    rows = [(i, rnd.choice(["a"] * 8 + ["b", None]), "w " * rnd.choice([0, 1, 5, 30])) for i in range(1500)] + [(3, "a", "w w")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    slim = mixing._slim(docs, "text", "source", "doc_id", 7)
    mix, _ = mixing.plan(slim, 7, target_entropy=0.9)
    out = mixing._counted(slim, mixing.plan(slim, 7, target_entropy=0.9)[1], 7).select("source", "n_tokens", "place", "block", "weight", "epochs", "copies").collect()
    for source in ("a", "b", None):
        mine = sorted((r for r in out if r["source"] == source), key=lambda r: (r["block"], r["place"]))
        left = int(mine[0]["weight"] * mix.budget * (1 + 1e-12) + 1e-9) - mine[0]["epochs"] * sum(r["n_tokens"] for r in mine)
        places = {}
        for r in mine:
            places.setdefault((r["block"], r["place"]), []).append(r)
        walking = True
        for at in sorted(places):
            size = sum(r["n_tokens"] for r in places[at])
            walking = walking and size <= left
            left -= size * walking
            assert {r["copies"] for r in places[at]} == {mine[0]["epochs"] + walking}
