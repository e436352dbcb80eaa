"""Toxicity by a classifier chain: each category's model sees the probabilities of those before it."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import per_text, release, small, stage
from sedimenta.llm.langid import words_of
from sedimenta.llm.quality import BINS, BUCKETS as SHAPES_FROM, MEASURES, bins, measures
from sedimenta.llm.weak import Rows, fit_linear, sigmoid


class Category(NamedTuple):
    name: str
    label: str
    value: int
    shaped: bool  # whether its model sees the shape of a text besides its words


#: Categories in chain order, as far as they are labelled: what is below quality, and what is toxic.
#: The last one's probability, into which all before have gone, is the verdict.
CATEGORIES = (Category("low_quality", "quality", 0, True), Category("toxic", "toxic", 1, False))
#: Buckets of hashed features, how many are kept of a category, and the bounds of the labelled sample.
BUCKETS, KEPT, TRAIN_TOXIC, TRAIN_OTHER = 1 << 20, 2_048, 6_000, 12_000
FOLDS = 5
#: Pulls the weight of a marker towards the logarithm of its lift, so that a document with a single
#: marker is judged by it even if toxic ones usually have several.
RIDGE = 1e-3
#: A feature is kept if so many documents of the category have it, and its share of them exceeds that of
#: others by so many standard errors and times: what others have is no evidence.
SUPPORT, SIGNIFICANT, LIFT = 4, 4.0, 30.0
#: Bytes of words whose features a worker remembers, beyond which it starts anew, and the longest one that is.
KNOWN_BYTES, KNOWN_WORD = 8 << 20, 64
SHAPES = BINS * len(MEASURES)


def word_features(word) -> list[int]:
    """Buckets of a word and of its beginnings of four to six letters."""
    text = word if isinstance(word, str) else word.decode("latin-1")
    names = [f"w{text}", *(f"p{text[:n]}" for n in (4, 5, 6) if len(text) > n)]
    return [xxhash.xxh32_intdigest(x.encode()) % BUCKETS for x in names]


class Lexicon:
    """Which of the kept features a text has, by their places among them, with a bounded memory of words."""

    def __init__(self, kept: np.ndarray):
        self.index = {int(b): i for i, b in enumerate(kept)}
        self.known: dict = {}
        self.held = 0

    def _of(self, word) -> tuple:
        if (hit := self.known.get(word)) is None:
            hit = tuple({self.index[b] for b in word_features(word) if b in self.index})
            if len(word) <= KNOWN_WORD:
                if self.held > KNOWN_BYTES:
                    self.known.clear()
                    self.held = 0
                self.known[word] = hit
                self.held += len(word) + 64
        return hit

    def of(self, text: str) -> list[int]:
        found: set[int] = set()
        for w in set(words_of(text)):
            found.update(self._of(w))
        return sorted(found)


def shapes(text: str) -> list[int]:
    """Where each measure of the text lies, as features from 0."""
    return [b - SHAPES_FROM for b in bins(measures(text))]


class Chain(NamedTuple):
    """Kept features, and for each category weights (features, shapes, earlier categories) and a bias."""

    kept: np.ndarray
    names: tuple[str, ...]
    models: list[tuple[np.ndarray, float]]

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """[row, category], each fed with those before. Shapes come after the kept features."""
        out = np.zeros((len(rows), len(self.models)))
        own, n = Rows(rows), len(self.kept) + SHAPES
        for k, (w, b) in enumerate(self.models):
            out[:, k] = sigmoid(own.dot(w[:n]) + out[:, :k] @ w[n : n + k] + b)
        return out


class Markers(NamedTuple):
    """For a category and a choice of folds: which features it may use, and the weights they are pulled to."""

    allowed: np.ndarray
    centre: np.ndarray


def fit_link(rows: Rows, target: np.ndarray, markers: Markers, lexical: int) -> tuple[np.ndarray, float]:
    """One model of the chain. The same for a fold and for all: a word doesn't speak for a document, so weights
    of words below zero are zero."""
    if not len(target) or target.min() == target.max():  # labels of one kind tell nothing
        return np.zeros(len(markers.allowed)), -10.0
    w, b = fit_linear(rows.where(markers.allowed), target, len(markers.allowed), ridge=RIDGE, centre=markers.centre)
    w[:lexical] = np.maximum(w[:lexical], 0)
    w[~markers.allowed] = 0
    return w, b


def fit_chain(rows: list[list[int]], targets: np.ndarray, folds: np.ndarray, markers: list[list[Markers]], lexical: int) -> list[tuple[np.ndarray, float]]:
    """A linear model for each category in order; earlier ones enter as out-of-fold probabilities.

    targets: [row, category], NaN where a label is missing. markers[c][f]: what the other folds than f
    give for category c; markers[c][FOLDS]: what all give.
    """
    n, k = targets.shape
    out_of_fold, models = np.zeros((n, k)), []
    base = lexical + SHAPES
    for c in range(k):
        fed = Rows([[*r, *range(base, base + c)] for r in rows], [[*[1.0] * len(r), *e] for r, e in zip(rows, out_of_fold[:, :c])])
        known = ~np.isnan(targets[:, c])
        for f in range(FOLDS):
            train, test = np.flatnonzero((folds != f) & known), np.flatnonzero(folds == f)
            w, b = fit_link(fed.only(train), targets[train, c], markers[c][f], lexical)
            out_of_fold[test, c] = sigmoid(fed.only(test).dot(w) + b)
        train = np.flatnonzero(known)
        models.append(fit_link(fed.only(train), targets[train, c], markers[c][FOLDS], lexical))
    return models


def _selected(sample: DataFrame, n_categories: int) -> tuple[list, dict[tuple[int, int], int]]:
    """(c, f, b, lift) of the features that mark category c without fold f, or in all if f is FOLDS.

    Counts are made where the texts are, once for all folds; the driver gets KEPT for each c and f at most.
    """

    def hash_work():
        return lambda texts: {"buckets": pa.array([sorted({b for w in set(words_of(t)) for b in word_features(w)}) for t in texts], pa.list_(pa.int32()))}

    ys = [f"y{c}" for c in range(n_categories)]
    each = per_text(sample, "text", [*ys, "fold"], "buckets array<int>", hash_work).select(*ys, "fold", F.explode("buckets").alias("b"))
    count = lambda c, f, yes: F.count_if((F.col("fold") == f) & (F.col(f"y{c}") == yes))
    names = [(f"n{c}_{f}_{int(yes)}", c, f, yes) for c in range(n_categories) for f in range(FOLDS) for yes in (True, False)]
    totals = sample.agg(*[count(c, f, yes).alias(n) for n, c, f, yes in names]).first().asDict()
    seen = each.groupBy("b").agg(*[count(c, f, yes).alias(n) for n, c, f, yes in names])
    choices = []
    for c in range(n_categories):
        for out in range(FOLDS + 1):
            mine = lambda yes: [n for n, x, f, y in names if x == c and y == yes and f != out]  # noqa: B023, E731
            n1, n0 = sum(totals[n] for n in mine(True)), sum(totals[n] for n in mine(False))
            if not n1 or not n0:
                continue
            t, u = sum((F.col(n) for n in mine(True)), F.lit(0)), sum((F.col(n) for n in mine(False)), F.lit(0))
            pooled = (t + u + 1) / (n1 + n0 + 2)
            z = (t / n1 - u / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
            choices.append(F.struct(F.lit(c).alias("c"), F.lit(out).alias("f"), t.alias("t"), z.alias("z"), ((t + 0.5) / n1 / ((u + 0.5) / n0)).alias("lift")))
    if not choices:
        return [], totals
    told = seen.select("b", F.inline(F.array(*choices))).where((F.col("z") >= SIGNIFICANT) & (F.col("t") >= SUPPORT) & (F.col("lift") >= LIFT))
    best = Window.partitionBy("c", "f").orderBy(F.desc("z"), "b")
    rows = told.withColumn("k", F.row_number().over(best)).where(F.col("k") <= KEPT).select("c", "f", "b", "lift").collect()
    return sorted(map(tuple, rows)), totals


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", categories: tuple[Category, ...] = CATEGORIES) -> Chain:
    """A chain from a hash sample of labelled documents: about TRAIN_TOXIC of the last category and TRAIN_OTHER others.

    Each different text is used once; one labelled both ways counts as of the category. A missing label (or column)
    of an earlier category leaves the document out of that category's model only. Features are chosen anew
    for each fold, so nothing of a document goes into its out-of-fold probabilities.
    """
    names, k = tuple(c.name for c in categories), len(categories)
    ys = [f"y{c}" for c in range(k)]
    told = labels.select(F.col(f"`{doc_id}`").alias("id"), *[((F.col(f"`{c.label}`") if c.label in labels.columns else F.lit(None)).cast("int") == c.value).alias(y) for c, y in zip(categories, ys)])
    known = told.where(F.col("id").isNotNull() & F.col(ys[-1]).isNotNull()).groupBy("id").agg(*[F.max(y).alias(y) for y in ys])
    counts = {r[ys[-1]]: r["count"] for r in known.groupBy(ys[-1]).count().collect()}
    share = F.when(F.col(ys[-1]), min(1.0, TRAIN_TOXIC / max(counts.get(True, 0), 1))).otherwise(min(1.0, TRAIN_OTHER / max(counts.get(False, 0), 1)))
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30) < share)
    named = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    once = named.join(small(picked), "id").groupBy("text").agg(*[F.max(y).alias(y) for y in ys])
    sample = stage(once.withColumn("key", F.xxhash64("text")).withColumn("fold", F.pmod("key", F.lit(FOLDS)).cast("int")))
    chosen, _ = _selected(sample, k)
    kept = np.array(sorted({b for _, _, b, _ in chosen}), np.int64)

    def row_work():
        lexicon = Lexicon(kept)
        return lambda texts: {"features": pa.array([[*lexicon.of(t), *(len(kept) + s for s in shapes(t))] for t in texts], pa.list_(pa.int32()))}

    rows = per_text(sample, "text", [*ys, "key", "fold"], "features array<int>", row_work).toArrow()
    release(sample)
    rows = rows.append_column("size", pa.array([len(x) for x in rows.column("features").to_pylist()], pa.int64())).sort_by([("key", "ascending"), ("size", "ascending")])
    if not rows.num_rows:
        return Chain(kept, names, [(np.zeros(len(kept) + SHAPES + k), -10.0) for _ in names])
    total, place = len(kept) + SHAPES + k, {int(b): i for i, b in enumerate(kept)}
    markers = []
    for c in range(k):
        markers.append([])
        for f in range(FOLDS + 1):
            allowed, centre = np.zeros(total, bool), np.zeros(total)
            for _, _, b, lift in (x for x in chosen if x[:2] == (c, f)):
                allowed[place[b]], centre[place[b]] = True, np.log(lift)
            allowed[len(kept) : len(kept) + SHAPES] = categories[c].shaped
            allowed[len(kept) + SHAPES : len(kept) + SHAPES + c] = True
            markers[c].append(Markers(allowed, centre))
    targets = np.array([[np.nan if v is None else float(v) for v in rows.column(y).to_pylist()] for y in ys]).T
    models = fit_chain(rows.column("features").to_pylist(), targets, rows.column("fold").to_numpy(), markers, len(kept))
    for c, category in enumerate(categories):
        if not category.shaped and not markers[c][FOLDS].allowed[: len(kept)].any():  # no word marks it, so no text shows it
            models[c] = (np.zeros(total), -10.0)
    return Chain(kept, names, models)


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic_at: float = 0.5, categories: tuple[Category, ...] = CATEGORIES) -> DataFrame:
    """doc_id, a probability p_ for each category of the chain, and toxic, the verdict of its last link, for each whole text.

    Words are runs of letters in lower case. A null or empty text has the probabilities of a
    text without any word. Without labels of both kinds, or words that mark toxic ones, nothing is toxic. Repeated rows
    each get a row, equal texts the same probabilities; null labels and labels of unknown
    documents are left out; an empty table gives no rows. Other columns of `docs` aren't read.
    """
    chain = fit(docs, labels, doc_id, text, categories)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{n}" for n in chain.names]

    def work():
        model = shared.value
        lexicon, n = Lexicon(model.kept), len(model.kept)

        def apply(texts: list) -> dict:
            p = model.probabilities([[*lexicon.of(t or ""), *(n + s for s in shapes(t or ""))] for t in texts])
            return {**{name: pa.array(p[:, k], pa.float64()) for k, name in enumerate(names)}, "toxic": pa.array(p[:, -1] >= toxic_at, pa.bool_())}

        return apply

    out = per_text(docs, text, [doc_id], ", ".join(f"{n} double" for n in names) + ", toxic boolean", work)
    return out.withColumnRenamed(doc_id, "doc_id")
