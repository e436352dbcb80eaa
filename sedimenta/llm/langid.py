"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import carried, per_text, release, stage

#: Symbols of the longest n-gram, and the discount of all orders.
ORDER, DISCOUNT = 5, 0.75
#: Bounds of the labelled sample that the models are fitted on: characters and distinct
#: words of a language, and documents to calibrate on.
TRAIN_CHARS, TRAIN_WORDS, CALIBRATION_DOCS = 1_500_000, 120_000, 1_000
#: Beyond so many languages the bounds above are scaled, so that they hold in all.
FULL_LANGUAGES = 64
#: Bytes of words and scores that a worker remembers, beyond which it starts anew, and the longest word that is.
KNOWN_BYTES, KNOWN_WORD = 24 << 20, 64
#: Characters of new words, and symbols of them, that are scored together.
CHARS_AT_ONCE, SYMBOLS_AT_ONCE = 1 << 19, 1 << 17
#: A text is rejected when its cross-entropy lies this share of the way from what is usual in
#: the language to what texts of the other languages need there, but within so many standard deviations never.
REJECT_AT, NEVER_WITHIN = 0.8, 6.0
UNKNOWN = "und"

_EDGE_BEFORE, _EDGE_AFTER = 1, 2
#: Letters are the characters of category L; marks go on with a word.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _latin_words_table() -> bytes:
    """Latin-1 letters to lower case, all else to spaces; letters whose lower case isn't Latin-1 stay."""
    out = bytearray(b" " * 256)
    for code in range(256):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 and ord(low) < 256 else code
    return bytes(out)


_FOLD = _latin_words_table()


def words_of(text: str) -> list:
    """Runs of letters in lower case: bytes of Latin-1, or str where the text has other characters."""
    try:
        return text.encode("latin-1").translate(_FOLD).split()
    except UnicodeEncodeError:
        return [_latin_or_str(w) for w in _LETTERS.findall(text.lower())]


def _latin_or_str(word: str):
    try:
        return word.encode("latin-1")
    except UnicodeEncodeError:
        return word


def _as_str(word) -> str:
    return word.decode("latin-1") if isinstance(word, bytes) else word


def _events(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """[event, ORDER] symbols: each character of each padded word with what stands before it; and the word of each.

    Events come in parts of a bounded size, however long a word is.
    """
    pad = np.full(ORDER - 1, _EDGE_BEFORE, np.uint32)
    lengths = np.array([len(w) + 1 for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    line = np.empty(int((lengths + ORDER - 1).sum()), np.uint32)
    whose = np.repeat(np.arange(len(words)), lengths)
    at = starts[whose] + ORDER - 1 + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    line[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = np.tile(pad, len(words))
    last = np.zeros(len(at), bool)
    last[np.cumsum(lengths) - 1] = True
    line[at[last]] = _EDGE_AFTER
    line[at[~last]] = codes
    for k in range(0, len(at), SYMBOLS_AT_ONCE):
        yield line[at[k : k + SYMBOLS_AT_ONCE, None] + np.arange(1 - ORDER, 1)], whose[k : k + SYMBOLS_AT_ONCE]


def _hashes(symbols: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash of the last symbols of each event."""
    out, h = [], np.zeros(len(symbols), np.uint64)
    for k in range(ORDER):
        h = (h ^ (symbols[:, ORDER - 1 - k].astype(np.uint64) + np.uint64(k + 1))) * _A
        h ^= h >> np.uint64(29)
        out.append(h * _B)
    return out


def _context_hashes(symbols: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash of the symbols before the last one; order 1 has an empty context."""
    shifted = np.concatenate([np.zeros((len(symbols), 1), symbols.dtype), symbols[:, :-1]], axis=1)
    return [np.zeros(len(symbols), np.uint64), *_hashes(shifted)[: ORDER - 1]]


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


@dataclass
class Model:
    """One language: for each order its n-grams as sorted hashes with interpolated probabilities, and its contexts with backoffs."""

    grams: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]

    @classmethod
    def fit(cls, counts: dict[str, int], floor: float) -> Model:
        """From word counts. The longest n-grams have their counts; a shorter one counts the different symbols seen before it."""
        words = sorted(counts) or [""]
        times = np.array([counts.get(w, 0) for w in words], float)
        parts = list(_events(words))
        symbols, whose = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        hashes, ctx = _hashes(symbols), _context_hashes(symbols)
        top, rows, back = np.unique(hashes[-1], return_index=True, return_inverse=True)
        levels = [(top, rows, np.bincount(back, times[whose], len(top)))]
        for k in range(ORDER - 2, -1, -1):
            _, rows, seen = levels[-1]
            short, where, back = np.unique(hashes[k][rows], return_index=True, return_inverse=True)
            levels.append((short, rows[where], np.bincount(back, seen > 0, len(short))))
        out = cls([], [], [], [])
        below, lower = np.zeros(0, np.uint64), np.zeros(0)
        for k, (keys, rows, seen) in enumerate(reversed(levels)):
            ctx_keys, back = np.unique(ctx[k][rows], return_inverse=True)
            mass, kinds = np.bincount(back, seen, len(ctx_keys)), np.bincount(back, seen > 0, len(ctx_keys))
            left = np.where(mass > 0, DISCOUNT * kinds / np.maximum(mass, 1), 1.0)
            shorter = lower[np.searchsorted(below, hashes[k - 1][rows])] if k else floor
            below, lower = keys, np.maximum(seen - DISCOUNT, 0) / np.maximum(mass[back], 1) + left[back] * shorter
            out.grams.append(keys)
            out.probs.append(lower.astype(np.float32))
            out.contexts.append(ctx_keys)
            out.backoff.append(left.astype(np.float32))
        return out

    def probabilities(self, grams: list[tuple], contexts: list[tuple], floor: float) -> np.ndarray:
        """Of each event: that of its longest known n-gram, times the backoffs of the contexts of longer ones.

        grams and contexts: for each order the different hashes in order, and which of them each event has.
        """
        p: np.ndarray | float = floor
        for k in range(ORDER):
            (keys, which), (ctx_keys, ctx_which) = grams[k], contexts[k]
            at, hit = _find(self.contexts[k], ctx_keys)
            left = np.where(hit, self.backoff[k][at], np.float32(1.0))
            at, hit = _find(self.grams[k], keys)
            own = np.where(hit, self.probs[k][at], np.float32(0.0))[which]
            p = np.where(own > 0, own, left[ctx_which] * p)
        return p


@dataclass
class Models:
    """A model for each language, and the calibration of all."""

    languages: list[str]
    models: list[Model]
    floor: float
    usual: np.ndarray | None = None
    slack: np.ndarray | None = None
    sharpness: float = 10.0

    @classmethod
    def fit(cls, counts: dict[str, dict[str, int]]) -> Models:
        """From the word counts of each language; a language's model depends on others only by the number of symbols."""
        languages = sorted(counts)
        floor = 1.0 / (len(set().union(*(w for c in counts.values() for w in c))) + 2)
        return cls(languages, [Model.fit(counts[x], floor) for x in languages], floor)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """[word, language + 1]: the bits that each language needs for the padded word, and its number of symbols."""
        out = np.zeros((len(words), len(self.languages) + 1))
        for symbols, whose in _events(words):
            grams, contexts = ([np.unique(h, return_inverse=True) for h in made(symbols)] for made in (_hashes, _context_hashes))
            for c, m in enumerate(self.models):
                out[:, c] += np.bincount(whose, -np.log2(m.probabilities(grams, contexts, self.floor)), len(words))
            out[:, -1] += np.bincount(whose, minlength=len(words))
        return out.astype(np.float32)

    def scorer(self):
        """A function from texts to [text, language + 1] sums of bits and of symbols, with a bounded memory of words."""
        known: dict = {}
        table = np.zeros((0, len(self.languages) + 1), np.float32)
        held = 0
        scale = min(1.0, FULL_LANGUAGES / max(len(self.languages), 1))
        most_words, most_of_text = (max(int(scale * n), 1) for n in (150_000, 100_000))

        def scored(new: list) -> np.ndarray:
            parts, at, chars = [table[:0]], 0, 0
            for i, w in enumerate(new):
                if i > at and chars + len(w) > scale * CHARS_AT_ONCE:
                    parts.append(self.word_scores([_as_str(x) for x in new[at:i]]))
                    at, chars = i, 0
                chars += len(w)
            if new[at:]:
                parts.append(self.word_scores([_as_str(x) for x in new[at:]]))
            return np.concatenate(parts)

        def size_of(new: list) -> int:
            return sum(map(len, new)) + len(new) * (100 + 4 * table.shape[1])

        def bulk(words: list) -> np.ndarray:
            nonlocal table, held
            different = set(words)
            long = [w for w in different if len(w) > KNOWN_WORD]
            different.difference_update(long)
            new = list(different.difference(known))
            if known and held + size_of(new) > KNOWN_BYTES:
                known.clear()
                table, held, new = table[:0], 0, list(different)
            if new:
                table = np.concatenate([table, scored(new)])
                known.update(zip(new, range(len(known), len(known) + len(new))))
                held += size_of(new)
            if not long:
                return table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
            place = known | dict(zip(long, range(len(table), len(table) + len(long))))
            return np.concatenate([table, scored(long)])[np.fromiter(map(place.__getitem__, words), np.int64, len(words))]

        def score(texts: list) -> np.ndarray:
            out = np.zeros((len(texts), len(self.languages) + 1))
            words, rows, sizes = [], [], []

            def flush() -> None:
                if words:
                    starts = np.cumsum(sizes) - sizes
                    out[rows] += np.add.reduceat(bulk(words), starts, axis=0, dtype=np.float64)
                    words.clear(), rows.clear(), sizes.clear()

            for i, t in enumerate(texts):
                mine = words_of(t or "")
                for k in range(0, len(mine), most_of_text):
                    part = mine[k : k + most_of_text]
                    if len(words) + len(part) > most_words:
                        flush()
                    words.extend(part)
                    rows.append(i)
                    sizes.append(len(part))
                    if len(mine) > most_of_text:
                        flush()
            flush()
            return out

        return score

    def decide(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: none), score, bits a symbol and rejection for sums from `scorer`."""
        n = sums[:, -1]
        ok = (n > 0) & bool(self.languages)
        if not self.languages:
            zero = np.zeros(len(sums))
            return np.full(len(sums), -1), zero, zero, np.ones(len(sums), bool)
        bits = sums[:, :-1] / np.maximum(n, 1)[:, None]
        first = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), first]
        score = 1 / np.exp2(-np.minimum(self.sharpness * (bits - least[:, None]), 1000)).sum(axis=1)
        reject = ~ok
        if self.usual is not None:
            reject |= least > self.usual[first] + self.slack[first] * (1 + 3 / np.sqrt(np.maximum(n, 1)))
        return np.where(ok, first, -1), np.where(ok, score, 0.0), np.where(ok, least, 0.0), reject


def _train_fold(doc_id: str):
    """Documents to learn from; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) != 1


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Models:
    """Models and calibration from a bounded sample of the labelled documents of the training folds.

    Shares of each language are counted over all of them; then a hash picks documents up to
    TRAIN_CHARS characters of each, and CALIBRATION_DOCS others to calibrate on. With more than
    FULL_LANGUAGES languages all are kept, with so much less of each that the whole stays bounded.
    The driver receives word counts and calibration sums only.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & _train_fold("doc_id"))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).where("chars > 0").collect()
    if not sizes:
        return Models([], [], 1.0)
    pick = F.pmod(F.xxhash64("lang", "doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    scale = min(1.0, FULL_LANGUAGES / len(sizes))
    shares = {r["lang"]: min(0.75, scale * TRAIN_CHARS / r["chars"]) for r in sizes}
    # each document to calibrate on has a sum for every language
    more = {r["lang"]: min(0.25, scale**2 * CALIBRATION_DOCS / r["n"]) for r in sizes}
    table = docs.sparkSession.createDataFrame([(k, shares[k], shares[k] + more[k]) for k in shares], "lang string, train double, upto double")
    part = rows.join(F.broadcast(table), "lang").withColumn("pick", pick).where("pick < upto")
    sample = stage(part.select("lang", "text", (F.col("pick") < F.col("train")).alias("train")))

    def count_work():
        return lambda texts: {"words": pa.array([[_as_str(w) for w in words_of(t or "")] for t in texts], pa.list_(pa.string()))}

    words = per_text(sample.where("train"), "text", ["lang"], "words array<string>", count_work).select("lang", F.explode("words").alias("word"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    kept = words.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= max(int(scale * TRAIN_WORDS), 1))
    found = kept.select("lang", "word", "n").toArrow()
    counts: dict[str, dict[str, int]] = {}
    for x, w, n in zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n"))):
        counts.setdefault(x, {})[w] = n
    models = Models.fit(counts) if counts else Models([], [], 1.0)
    if counts:
        _calibrate(models, sample.where("NOT train"))
    release(sample)
    return models


def _calibrate(models: Models, rows: DataFrame) -> None:
    """Usual bits a symbol and the slack above them for each language, and the sharpness under which scores are most truthful."""
    sums = per_text(rows, "text", ["lang"], "sums array<double>", _sums_work(rows.sparkSession, models)).toArrow()
    index = {x: i for i, x in enumerate(models.languages)}
    truth = np.array([index.get(x, -1) for x in sums.column("lang").to_pylist()], int)
    values = np.array(sums.column("sums").to_pylist(), float).reshape(len(truth), len(models.languages) + 1)
    held = (truth >= 0) & (values[:, -1] > 0)
    truth, values = truth[held], values[held]
    n = len(models.languages)
    bits = values[:, :-1] / np.maximum(values[:, -1:], 1)
    own = bits[np.arange(len(bits)), truth]
    models.usual = np.full(n, float(own.mean()) if len(own) else 4.0)
    models.slack = np.full(n, NEVER_WITHIN * (float(own.std()) + 0.1 if len(own) else 1.0))
    for k in range(n):
        mine, others = own[(truth == k) & (values[:, -1] >= 50)], bits[truth != k, k]
        if len(mine) >= 20:
            models.usual[k], models.slack[k] = mine.mean(), NEVER_WITHIN * max(float(mine.std()), 0.1)
        if len(others) >= 20:
            models.slack[k] = max(models.slack[k], REJECT_AT * float(others.mean() - models.usual[k]))
    if len(own) and n > 1:
        least = bits.min(axis=1)

        def loss(s: float) -> float:
            return float(np.mean(s * (own - least) + np.log2(np.exp2(-np.minimum(s * (bits - least[:, None]), 1000)).sum(axis=1))))

        models.sharpness = min((2.0**k for k in range(0, 8)), key=loss)


def _sums_work(spark, models: Models):
    shared = spark.sparkContext.broadcast(models)

    def work():
        score = shared.value.scorer()
        return lambda texts: {"sums": pa.array(list(score(texts)), pa.list_(pa.float64()))}

    return work


def predictions(docs: DataFrame, models: Models, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, lang_pred, score, bits (cross-entropy a symbol) and rejected for each whole text.

    lang_pred is the language whose model needs the fewest bits a symbol, ties going to
    the smaller name; a null text, or one without a letter, is `und` with score 0 and is
    rejected, as is a text far from all languages. Repeated rows each get a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def work():
        m = shared.value
        score = m.scorer()

        def apply(texts: list) -> dict:
            best, sure, bits, reject = m.decide(score(texts))
            names = [m.languages[b] if b >= 0 else UNKNOWN for b in best]
            return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(sure, pa.float64()), "bits": pa.array(bits, pa.float64()), "rejected": pa.array(reject, pa.bool_())}

        return apply

    return per_text(docs, text, keep, "lang_pred string, score double, bits double, rejected boolean", work)


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits and rejected; see `fit` and `predictions`.

    Only text and non-null lang of documents whose crc32(doc_id as text) mod 3 isn't 1 are
    learned from. Without any of them every document is `und`.
    """
    models = fit(docs, doc_id, text, lang)
    out = predictions(docs, models, [doc_id], text)
    return out.select(F.col(doc_id).alias("doc_id"), (~_train_fold(doc_id)).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def accepted(docs: DataFrame, text: str = "text", **names) -> DataFrame:
    """The rows of `docs` that aren't rejected, with all columns as they are.

    Null texts, texts without a letter and those far from all languages go, as do all without any row to
    learn from. Repeated rows all stay or go; texts of any length are judged whole; an empty table stays empty.
    """
    models = fit(docs, text=text, **names)
    bare, new, back = carried(docs)
    return back(predictions(bare, models, bare.columns, new[text]).where("NOT rejected"))
