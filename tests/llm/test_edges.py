"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every query and stage."""

import hashlib
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from sedimenta.llm.queries import QUERIES

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("score", pa.string()), ("fp", pa.int64()), ("lang_pred", pa.string()), ("copies", pa.int64()), ("spans", pa.string())])
EXTRA = {"score": "s", "fp": 5, "lang_pred": "x", "copies": 9, "spans": "y"}
EN = "the cat sat on the mat and then the dog ran over to the house while it was raining in the street again"
DE = "der hund lief über die straße und die katze schläft auf dem sofa während es draußen stark regnet heute"

OTHER = "ein ganz anderer satz mit vielen worten die sonst nirgends stehen und der lang genug dafür ist"


def _docs():
    rows = [
        (1, EN, "en", "a"), (1, EN, "en", "a"), (2, EN, "en", "a"), (3, None, None, None), (4, "", "en", "a"), (5, "   \n\t ", "de", "b"), (6, "123 456", None, "b"),
        (None, DE, "de", "b"), (None, DE, "de", "b"), (None, None, None, None), (7, OTHER, "de", "b"), (8, "one", "en", None), (9, "x" * 300_000, "en", "a"),
        (10, (EN + " ") * 2_000, "en", "a"), (11, "mail a.b@c.org call +1 (415) 555-2671 ip 10.0.0.1 card 4111 1111 1111 1111", "en", "c"), (12, "数学 is 漢字 😀 é", None, "c"), (14, "9" * 10_000, "en", "c"), (15, "@" * 5_000 + "1." * 5_000, "en", "c"),
    ]
    return [{"doc_id": i, "text": t, "lang": lang, "source": s, "n_chars": None if t is None else len(t), **EXTRA} for i, t, lang, s in rows]


def _write(at, docs):
    at.mkdir()
    pq.write_table(pa.Table.from_pylist(docs, DOCS), at / "documents.parquet")
    some = bool(docs)
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "quality": 1, "toxic": t} for i, t in ((1, 0), (7, 1), (7, 0), (99, 1), (None, 1), (2, None))] if some else [], pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), at / "labels.parquet")
    v = [1.0, -0.5, 0.25]
    vectors = [(0, v), (0, v), (1, v), (50, [0.0, 0.0, 0.0]), (51, None), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0]), (None, v), (54, []), (100, [1e30, 1e30, 1e30]), (55, [float("inf"), 0.0, 0.0])]
    pq.write_table(pa.Table.from_pylist([{"vec_id": i, "embedding": x, "label": 0, "score": "s", "img": 1} for i, x in vectors] if some else [], pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("score", pa.string()), ("img", pa.int64())])), at / "embeddings.parquet")
    urls = ["http://a.org/x", "http://a.org/x", None, "", "no scheme", "://", "HTTP://WWW.Example.ORG/es/1?x#y", "https://b.com", "http://u:p@c.com:80/fr/?", "http://d.net/p#f"]
    html = '<link rel="canonical" href="http://a.org/x">'
    pq.write_table(pa.Table.from_pylist([{"page_id": None if i == 9 else i, "url": u, "html": None if i % 2 else html, "host": "clash", "rule": "clash"} for i, u in enumerate(urls)] if some else [], pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("host", pa.string()), ("rule", pa.string())])), at / "pages.parquet")
    return str(at)


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("edges") / "t", _docs())


@pytest.fixture(scope="module")
def nothing(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("nothing") / "t", [])


PER_ROW = {"op1_simhash_dedup": 18, "op2_pii": 18, "op3_language_id": 18, "op4_byte_bpe": 18, "op5_source_mixing": 18, "op8_quality": 18, "op10_toxicity": 18, "op7_url_filter": 10, "op9_image_copies": 11}


@pytest.mark.parametrize("name", list(QUERIES))
def test_odd_rows(spark, edges, name):
    rows = QUERIES[name](spark, edges).collect()
    if name in PER_ROW:
        assert len(rows) == PER_ROW[name]


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).collect() == []


def test_mixing_results(spark, edges):
    rows = QUERIES["op5_source_mixing"](spark, edges).collect()
    n = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert (n[3], n[4], n[5], n[6], n[8], n[9], n[10]) == (0, 0, 0, 2, 1, 1, 46_000) and sum(r["doc_id"] == 1 for r in rows) == 2
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    assert set(sources) == {"a", "b", "c", None}
    assert abs(sum(rs[0]["weight"] for rs in sources.values()) - 1) < 1e-9
    total = sum(r["n_tokens"] for r in rows)
    for rs in sources.values():
        assert len({r["weight"] for r in rs}) == 1
        assert sum(r["copies"] * r["n_tokens"] for r in rs) <= rs[0]["weight"] * total * (1 + 1e-9)
        assert max(r["copies"] for r in rs) - min(r["copies"] for r in rs) <= 1
    assert len({r["copies"] for r in rows if r["doc_id"] == 1}) == 1  # repeated rows are taken together


def test_top_k_results(spark, edges):
    """Brute force over all rows that take part: vectors of any length, a null id, ties, a row that is there twice."""
    got = [tuple(r) for r in QUERIES["op6_exact_top_k"](spark, edges).collect()]
    rows = [(r["vec_id"], [math.floor(256 * x) for x in r["embedding"]]) for r in spark.read.parquet(f"{edges}/embeddings.parquet").collect() if r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    want = []
    for k, (q, v) in enumerate(rows):
        if q is not None and q % 50 == 0:
            scores = [(-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63)), i is None, i or 0) for j, (i, w) in enumerate(rows) if j != k]
            want += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scores)[:5])]
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3])
    assert sorted(got, key=key) == sorted(want, key=key) and sum(r[0] == 0 for r in got) == 10


def test_quality_and_toxicity_results(spark, edges):
    quality = {r["doc_id"]: r for r in QUERIES["op8_quality"](spark, edges).collect()}
    assert all(0 <= r["quality"] <= 1 and r["good"] == (r["quality"] >= 0.5) for r in quality.values())
    assert quality[1]["quality"] == quality[2]["quality"] and quality[3]["quality"] == quality[4]["quality"]  # equal texts; null as empty
    toxic = QUERIES["op10_toxicity"](spark, edges).collect()
    assert not any(r["toxic"] for r in toxic if r["doc_id"] != 7) and all(0 <= r[c] <= 1 for r in toxic for c in ("p_low_quality", "p_toxic"))
    by = {r["doc_id"]: r["p_toxic"] for r in toxic}
    assert by[1] == by[2] and by[3] == by[4]


def test_image_results(spark, edges):
    rows = {}
    for r in QUERIES["op9_image_copies"](spark, edges).collect():
        rows.setdefault(r["vec_id"], []).append((r["decoded"], r["n_corners"] > 0, r["class_id"]))
    assert rows[0] == [(True, True, 0)] * 2 and rows[1] == rows[None] == [(True, True, 0)]  # the same vector, so the same image
    assert rows[50] == [(True, False, 50)]  # without weight: flat
    assert rows[51] == [(False, False, 51)] and rows[54] == [(False, False, 54)]  # no vector, no image
    assert all(rows[k][0][0] for k in (52, 53, 55, 100))


def test_bpe_results(spark, edges):
    rows = {r["doc_id"]: r for r in QUERIES["op4_byte_bpe"](spark, edges).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    texts = {d["doc_id"]: d["text"] or "" for d in _docs()}
    for i in (3, 4):
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (0, nothing, nothing)
    for i in (5, 8, 9, 12, 14, 15):
        assert rows[i]["decoded_sha256"] == hashlib.sha256(texts[i].encode()).hexdigest()


def test_simhash_results(spark, edges):
    rows = QUERIES["op1_simhash_dedup"](spark, edges).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert by[1] == by[2] and next(iter(by[1]))[1] == 1
    zero = "0" * 16
    assert by[3] == by[4] == by[5] == {(zero, 3)}
    assert (zero, 3) in by[None]  # a null text links like any other


def test_language_results(spark, edges):
    rows = QUERIES["op3_language_id"](spark, edges).collect()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {3, 4, 5, 6, 14, 15} <= und and not und & {1, 2, 7, 8, 9}
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_pii_results(spark, edges):
    row = [r for r in QUERIES["op2_pii"](spark, edges).collect() if r["doc_id"] == 11][0]
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)


def test_url_results(spark, edges):
    rows = {r["page_id"]: r for r in QUERIES["op7_url_filter"](spark, edges).collect()}
    assert rows[0]["rule"] == "org/" and rows[0]["verdict"] == "allow"
    assert rows[6]["host"] == "www.example.org" and rows[6]["path"] == "/es/1" and rows[6]["verdict"] == "block"
    for i in (2, 3, 4):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == ("", "", None)


def test_stages_keep_columns(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, docs, edges)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert (r["score"], r["fp"], r["lang_pred"], r["copies"], r["spans"]) == ("s", 5, "x", 9, "y")


def test_dedup_keeps_one_of_repeated_and_nameless_rows(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, edges).collect()
    assert sum(r["doc_id"] == 1 for r in kept) == 1 and not any(r["doc_id"] == 2 for r in kept)
    assert sum(r["doc_id"] is None for r in kept) == 1


def test_empty_pipeline(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0
