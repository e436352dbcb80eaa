"""Quality: heuristic labellers vote, expectation-maximisation weighs them, posteriors train a hashed linear scorer."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import per_text, release, stage
from sedimenta.llm.weak import Labellers, Rows, fit_linear, sigmoid

#: Buckets of hashed byte trigrams, and the bound of the sample that the scorer is trained on.
BUCKETS, TRAIN_DOCS = 1 << 12, 4_000
#: Sum of a text's trigram features, whatever its length.
TRIGRAM_MASS = 20.0
#: Bytes of a text that are taken at a time.
PART_BYTES = 1 << 20

#: For each measure, the highest (or, if first > second, lowest) value of an
#: unsuspicious text and the value from which it speaks against one. A measure's labeller doesn't
#: speak for a text: kinds of bad texts differ, so one absent sign says little.
MEASURES = {
    "symbols": (0.02, 0.08),
    "capitals": (0.15, 0.45),
    "word_length": (8.5, 14.0),
    "few_words": (20.0, 4.0),
    "variety": (0.6, 0.45),
    "repeated_lines": (0.1, 0.5),
    "bars": (0.01, 0.03),
    "sentences": (0.04, 0.02),
}
#: Labellers that speak for texts: those unsuspicious in all measures but these.
SPEAK_FOR = {"plain": ("few_words",), "plain_and_long": ()}
LABELLERS = (*MEASURES, *SPEAK_FOR)
BINS = 8

_LOWER, _UPPER, _DIGIT, _SPACE, _POINT, _SYMBOL, _BAR = range(7)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z" or b >= 128:
            out[b] = _LOWER
        elif "A" <= c <= "Z":
            out[b] = _UPPER
        elif "0" <= c <= "9":
            out[b] = _DIGIT
        elif c in " \t\r\n\v\f":
            out[b] = _SPACE
        elif c in ".,;:?'\"()-":
            out[b] = _POINT
        elif c == "|":
            out[b] = _BAR
    return out


_CLASS = _byte_classes()


def _parts(data: bytes):
    for k in range(0, max(len(data), 1), PART_BYTES):
        yield data[k : k + PART_BYTES + 2], len(data) > k + PART_BYTES


def measures(text: str) -> list[float]:
    """The values of MEASURES for one text; shares are of its bytes, words or lines."""
    data = text.encode()
    counts = np.zeros(7, np.int64)
    for k in range(0, len(data), PART_BYTES):
        counts += np.bincount(_CLASS[np.frombuffer(data[k : k + PART_BYTES], np.uint8)], minlength=7)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, w = max(len(data), 1), len(words)
    letters = max(int(counts[_LOWER] + counts[_UPPER]), 1)
    variety = len(set(words)) / max(w, 1) * max(1.0, np.log1p(w) / 6)  # long texts repeat words anyway
    ends = data.count(b". ") + data.count(b".\n") + data.endswith(b".") + data.count(b"? ") + data.count(b"; ")
    return [
        counts[_SYMBOL] / n,
        counts[_UPPER] / letters,
        (n - counts[_SPACE]) / max(w, 1),
        float(w),
        variety,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        counts[_BAR] / n,
        ends / max(w, 1),
    ]


def vote(values: list[float]) -> list[int]:
    """For each of LABELLERS 1 for a text, -1 against it, or 0."""
    against = [-int(x >= bad if good < bad else x <= bad) for x, (good, bad) in zip(values, MEASURES.values())]
    fine = {n: x <= good if good < bad else x >= good for x, (n, (good, bad)) in zip(values, MEASURES.items())}
    return [*against, *(int(all(ok for n, ok in fine.items() if n not in leave)) for leave in SPEAK_FOR.values())]


def bins(values: list[float]) -> list[int]:
    """A feature for each measure: where between its two marks the value lies."""
    out = []
    for j, (x, (good, bad)) in enumerate(zip(values, MEASURES.values())):
        k = int(np.clip((x - good) / (bad - good) * 4 + 2, 0, BINS - 1))
        out.append(BUCKETS + j * BINS + k)
    return out


def _trigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(20)).astype(np.int64)


def features(text: str) -> tuple[list[int], list[float]]:
    """Hashed byte trigrams by share, and the bins of the measures."""
    counts = np.zeros(BUCKETS)
    for part, _ in _parts(text.encode()):
        if len(part) > 2:
            counts += np.bincount(_trigrams(part), minlength=BUCKETS)
    held = np.flatnonzero(counts)
    share = counts[held] * (TRIGRAM_MASS / max(counts.sum(), 1))
    extra = bins(measures(text))
    return [*held.tolist(), *extra], [*share.tolist(), *[1.0] * len(extra)]


class Scorer(NamedTuple):
    weights: np.ndarray
    bias: float
    reliability: dict[str, float]

    def score(self, text: str) -> float:
        total, n = 0.0, 0
        for part, _ in _parts(text.encode()):
            if len(part) > 2:
                at = _trigrams(part)
                total += float(self.weights[at].sum())
                n += len(at)
        linear = TRIGRAM_MASS * total / max(n, 1) + float(self.weights[bins(measures(text))].sum()) + self.bias
        return float(sigmoid(np.array(linear)))


def votes(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and the votes of LABELLERS on each whole text (null: an empty one)."""

    def work():
        return lambda texts: {"votes": pa.array([vote(measures(t or "")) for t in texts], pa.list_(pa.int32()))}

    return per_text(docs, text, keep, "votes array<int>", work)


def fit(docs: DataFrame, text: str = "text") -> tuple[Scorer, Labellers | None]:
    """Reliabilities and the share of good texts from the votes on all texts, and a scorer trained on the posteriors
    of different texts picked by hash, about TRAIN_DOCS at most.

    Rows reach the driver in no order and are put in one, so the fit is the same however the table is partitioned.
    """
    named = docs.select(F.col(f"`{text}`").alias("text"))
    cast = stage(votes(named, []))
    patterns = sorted((tuple(r["votes"]), r["n"]) for r in cast.groupBy("votes").agg(F.count("*").alias("n")).collect())  # at most 2 to the number of labellers
    release(cast)
    if not patterns:
        return Scorer(np.zeros(BUCKETS + len(MEASURES) * BINS), 0.0, {}), None
    model = Labellers([p for p, _ in patterns], [n for _, n in patterns])
    share = min(1.0, TRAIN_DOCS / sum(n for _, n in patterns))
    key = F.xxhash64("text")

    def work():
        def apply(texts: list) -> dict:
            made = [features(t or "") for t in texts]
            return {
                "votes": pa.array([vote(measures(t or "")) for t in texts], pa.list_(pa.int32())),
                "features": pa.array([m[0] for m in made], pa.list_(pa.int32())),
                "shares": pa.array([m[1] for m in made], pa.list_(pa.float32())),
            }

        return apply

    picked = named.where(F.pmod(key, F.lit(1 << 30)) / (1 << 30) < share).dropDuplicates(["text"]).withColumn("key", key).withColumn("size", F.length("text"))
    rows = per_text(picked, "text", ["key", "size"], "votes array<int>, features array<int>, shares array<float>", work).toArrow().sort_by([("key", "ascending"), ("size", "ascending")])
    target = model.posterior(np.array(rows.column("votes").to_pylist(), int).reshape(-1, len(LABELLERS)))
    held = Rows([x.values.to_numpy() for x in rows.column("features")], [x.values.to_numpy() for x in rows.column("shares")]) if rows.num_rows else Rows([])
    weights, bias = fit_linear(held, target, BUCKETS + len(MEASURES) * BINS)
    return Scorer(weights, bias, dict(zip(LABELLERS, model.reliability().tolist()))), model


def scored(docs: DataFrame, keep: list[str], text: str = "text", good_at: float = 0.5) -> DataFrame:
    """`keep`, quality (0 to 1) and good for each whole text.

    No labels are used: heuristics vote for and against texts, and their agreement over all of
    them shows how reliable each is and how many texts are good. A null text is an empty one.
    Texts of any length are measured in parts, and equal ones get the same score. Repeated rows
    each get a row; an empty table gives no rows. Other columns, whatever their names, aren't read.
    """
    model, _ = fit(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        score = shared.value.score

        def apply(texts: list) -> dict:
            values = np.array([score(t or "") for t in texts])
            return {"quality": pa.array(values, pa.float64()), "good": pa.array(values >= good_at, pa.bool_())}

        return apply

    return per_text(docs, text, keep, "quality double, good boolean", work)
