"""Language models of very many languages."""

import random

from sedimenta.llm import langid


def _texts(n):
    """n made-up languages, each with syllables of its own; the later ones have fewer documents."""
    rnd = random.Random(41)
    rows = []
    for k in range(n):
        syllables = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)]
        for _ in range(30 - k // 5):
            rows.append((len(rows), " ".join("".join(rnd.choices(syllables, k=2)) for _ in range(60)), f"l{k:02d}"))
    return rows


def test_more_than_64_languages(spark):
    docs = spark.createDataFrame(_texts(80), "doc_id long, text string, lang string")
    got = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for k in range(80):
        mine = [r for r in got if r["lang"] == f"l{k:02d}"]
        assert sum(r["lang_pred"] == r["lang"] for r in mine) >= 0.9 * len(mine)
    assert sum(r["rejected"] for r in got) <= 0.02 * len(got)


def test_a_model_depends_on_its_own_language():
    counts = {}
    for _, text, lang in _texts(5):
        for w in text.split():
            counts.setdefault(lang, {}).setdefault(w, 0)
            counts[lang][w] += 1
    models = langid.Models.fit(counts)
    assert models.languages == sorted(counts)
    alone = langid.Model.fit(counts["l02"], models.floor)
    assert all((a == b).all() for a, b in zip(alone.grams, models.models[2].grams))
    assert all((g[1:] > g[:-1]).all() for m in models.models for g in m.grams)
