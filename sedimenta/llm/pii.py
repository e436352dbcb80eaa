"""Personal data: labellers vote on candidate spans, their reliabilities train a span classifier."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import carried, per_text, release, stage
from sedimenta.llm.weak import Labellers, Rows, fit_linear, sigmoid

#: Kinds in the order of digests; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Hashed features, and the bound of the sample of candidates that trains the classifier.
FEATURES, TRAIN_CANDIDATES = 1 << 12, 20_000
#: Probability at which a span beyond the base ones is added.
ADD_AT = 0.5
#: Characters on either side that labellers and features see.
NEAR = 32

# Base patterns. A run can't begin where the one before could have gone on, so the
# look-behinds change no match and keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Candidates beyond them. Runs are possessive and can't begin inside themselves, so all are linear.
_DOT = r"(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s)"
_AT = r"(?:\(at\)|\[at\]|\{at\})"
#: A written-out email. After a plain "at", a full stop and a space end a sentence.
_WRITTEN_EMAIL = re.compile(rf"(?<![\w.%+-])[A-Za-z0-9._%+-]++(?:\s?{_AT}\s?[A-Za-z0-9-]++(?:\s?(?:{_DOT}|\.)\s?[A-Za-z0-9-]{{2,}}+)+|\s?\sat\s\s?[A-Za-z0-9-]++(?:(?:\s?{_DOT}\s?|\.)[A-Za-z0-9-]{{2,}}+)+)(?![\w-])")
#: What any written-out email holds.
_WRITTEN_AT = re.compile(rf"(?:{_AT}|\sat\s)\s?[A-Za-z0-9-]++\s?(?:{_DOT}|\.)\s?[A-Za-z0-9-]{{2}}")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")
#: What secrets of known forms hold, and their patterns; a group is the secret itself. A name and
#: a value may be anything, so they come last.
_SECRETS = tuple(
    (held, re.compile(pattern))
    for held, pattern in (
        ("-----BEGIN ", r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,.]|-(?!----))*+(?:-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----)?"),
        ("IA", r"(?<![A-Za-z0-9])A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])"),
        ("sk-", r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}+"),
        ("gh", r"(?<![A-Za-z0-9])gh[oprsu]_[A-Za-z0-9]{30,}+"),
        ("github_pat_", r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{30,}+"),
        ("glpat-", r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{20,}+"),
        ("xox", r"(?<![A-Za-z0-9])xox[abeprs]-[A-Za-z0-9-]{10,}+"),
        ("AIza", r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
        ("eyJ", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
        ("://", r"://[^\s/:@]++:([^\s/@]++)@"),
    )
)
_KNOWN_SECRET = re.compile(r"A[KS]IA|sk-|gh[oprsu]_|github_pat_|glpat-|xox[abeprs]-|AIza|eyJ|-----BEGIN|[0-9a-f]{16,}+\Z")
_NAMED_SECRET = re.compile(r"(?<![A-Za-z0-9])(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|(?:access|private|secret)[_-]?key)[\"']?\s*+[=:]\s*+[\"']?([^\s\"']{6,}+)|(?<![A-Za-z0-9])(?i:bearer)\s++([A-Za-z0-9._~+/=-]{16,}+)")

#: Gazetteers and cue words.
_TOP_DOMAINS = frozenset("com net org edu gov mil int info biz io co de fr es it uk us ca au nl be ch at pl se no dk fi pt br mx ar in jp cn ru eu example test".split())
_CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_CUES = {
    "email": frozenset("mail email e-mail contact write reach address correo courriel kontakt".split()),
    "ip": frozenset("ip host server address addr client from login serveur servidor".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte carte tarjeta".split()),
    "phone": frozenset("tel phone call fax mobile cell telephone telefon telefono téléphone ruf llama".split()),
    "secret": frozenset("password passwd secret token key credential aws login".split()),
}
_COUNTER_CUES = frozenset("version v release section chapter page figure table isbn issn license licence order ticket serial".split())


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in linear time."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            past = m.end()
        at = text.find("@", max(at + 1, past))


def base_spans(text: str) -> list[Span]:
    """The spans of the four base patterns that pass their tests, by kind and start."""
    out = [Span(0, a, b, True) for a, b in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(Span(1, m.start(), m.end(), True))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append(Span(2, m.start(), m.end(), True))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(Span(3, m.start(), m.end(), True))
    return out


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for held, pattern in _SECRETS:
        if held in text:
            yield from (m.span(m.lastindex or 0) for m in pattern.finditer(text))
    if ":" in text or "=" in text or "earer" in text.lower():
        yield from (m.span(m.lastindex) for m in _NAMED_SECRET.finditer(text))


def _apart(base: list[Span], more: list[Span]) -> Iterator[Span]:
    """Those of `more`, all of one kind, that overlap no base span and none before them; in one pass over both in order."""
    k, past = 0, 0
    for s in sorted(more):
        while k < len(base) and base[k].end <= s.start:
            k += 1
        if s.start >= past and (k == len(base) or base[k].start >= s.end):
            yield s
            past = s.end


def candidates(text: str) -> list[Span]:
    """Base spans, and others that overlap none of the same kind: written-out emails, short cards, phones without +, secrets."""
    out = base_spans(text)
    more: dict[int, list[Span]] = {}
    if _WRITTEN_AT.search(text):
        more[0] = [Span(0, m.start(), m.end(), False) for m in _WRITTEN_EMAIL.finditer(text)]
    if re.search("[0-9]", text):
        short = ((m, _digits(m.group())) for m in _CARD.finditer(text) if 13 <= m.end() - m.start() <= 64)
        more[2] = [Span(2, m.start(), m.end(), False) for m, d in short if 13 <= len(d) <= 15 and d[0] in "345" and _luhn(d)]
        more[3] = [Span(3, m.start(), m.end(), False) for m in _LOCAL_PHONE.finditer(text)]
    more[4] = [Span(4, a, b, False) for a, b in _secrets(text)]
    for kind, spans in more.items():
        if spans:
            out += list(_apart([s for s in out if s.kind == kind], spans))
    return sorted(out)


def votes(text: str, s: Span) -> tuple[int, ...]:
    """Of the pattern, checksum or form, gazetteer, context and boundary labellers: 1 personal, -1 not, 0 abstains."""
    found = text[s.start : s.end]
    before = re.findall(r"[^\W\d_][\w-]*", text[max(0, s.start - NEAR) : s.start].lower())
    kind = KINDS[s.kind]
    digits = _digits(found)
    form = 0
    known = 0
    if kind == "email":
        form = 1 if 6 <= len(found) <= 254 else -1
        known = 1 if re.split(r"[.\s)\]}]", found.lower())[-1] in _TOP_DOMAINS else -1
    elif kind == "ip":
        first = int(found.split(".")[0].lstrip("0") or 0)
        form = 1 if all(len(p) == 1 or p[0] != "0" for p in found.split(".")) else -1
        known = 1 if 0 < first < 224 else -1
    elif kind == "card":
        form = 1 if _luhn(digits) else -1
        known = 1 if digits[0] in "3456" else -1
    elif kind == "phone":
        form = 1 if 10 <= len(digits) <= 13 else 0
        known = 1 if any(digits[:k] in _CALLING_CODES for k in (1, 2)) else -1
    else:
        kinds = sum(bool(re.search(p, found)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        form = 1 if kinds >= 2 else -1
        known = 1 if _KNOWN_SECRET.match(found) else 0
    if len(digits) >= 8 and len(set(digits)) <= 2:
        form = -1
    context = 1 if any(w in _CUES[kind] for w in before[-4:]) else -1 if any(w in _COUNTER_CUES for w in before[-2:]) else 0
    glued = s.start and text[s.start - 1].isalnum() or text[s.end : s.end + 1].isalnum()
    return (1 if s.base else 0, form, known, context, -1 if glued else 1)


def features(text: str, s: Span, cast: tuple[int, ...]) -> list[int]:
    """Hashed features of a span: kind with votes, shape, and the words beside it."""
    found = text[s.start : s.end]
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", found[:40]))
    before = re.findall(r"\w+", text[max(0, s.start - NEAR) : s.start].lower())[-2:]
    after = re.findall(r"\w+", text[s.end : s.end + NEAR].lower())[:1]
    names = [f"k{s.kind}", f"s{s.kind}{shape}", *(f"v{s.kind},{j},{v}" for j, v in enumerate(cast)), *(f"b{w}" for w in before), *(f"a{w}" for w in after)]
    return sorted({xxhash.xxh32_intdigest(n.encode()) % FEATURES for n in names})


_FOUND = "found array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,features:array<int>>>"
_FOUND_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]))


def _described(text: str) -> list[dict]:
    out = []
    for s in candidates(text):
        cast = votes(text, s)
        out.append({"kind": s.kind, "start": s.start, "end": s.end, "base": s.base, "votes": list(cast), "features": features(text, s, cast)})
    return out


def found(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and found: the candidates of each whole text with votes and features. One pass, no shuffle."""

    def work():
        return lambda texts: {"found": pa.array([_described(t or "") for t in texts], _FOUND_TYPE)}

    return per_text(docs, text, keep, _FOUND, work)


class Classifier(NamedTuple):
    weights: np.ndarray
    bias: float
    reliabilities: dict[str, np.ndarray]

    def accepted(self, spans: list[dict]) -> list[dict]:
        """Base spans, and others that the classifier takes for personal data."""
        return [s for s in spans if s["base"] or float(sigmoid(self.weights[s["features"]].sum() + self.bias)) >= ADD_AT]


def fit(candidates_: DataFrame) -> Classifier:
    """From a table with `found`: reliabilities from how often vote patterns occur over all
    candidates, and a span classifier on their posteriors over a sample of TRAIN_CANDIDATES.

    Patterns are at most 3^5 a kind, so the driver receives a bounded table.
    """
    each = candidates_.select(F.explode("found").alias("s")).select("s.kind", "s.votes", "s.features")
    patterns = sorted(each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["kind"], r["votes"]))
    models, total = {}, sum(r["n"] for r in patterns)
    for kind in sorted({r["kind"] for r in patterns}):
        mine = [r for r in patterns if r["kind"] == kind]
        models[kind] = Labellers([r["votes"] for r in mine], [r["n"] for r in mine])
    if not total:
        return Classifier(np.zeros(FEATURES), 0.0, {})
    share = min(1.0, TRAIN_CANDIDATES / total)
    pick = F.pmod(F.xxhash64("kind", "features"), F.lit(1 << 30)) / (1 << 30)
    counted = each.groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    sample = counted.where(pick < share).orderBy(pick, "kind", "votes", "features").limit(TRAIN_CANDIDATES).collect()
    if not sample:
        sample = counted.orderBy(pick, "kind", "votes", "features").limit(TRAIN_CANDIDATES).collect()
    target = np.array([float(models[r["kind"]].posterior([r["votes"]])[0]) for r in sample])
    weights, bias = fit_linear(Rows([r["features"] for r in sample]), target, FEATURES, np.array([r["n"] for r in sample], float))
    return Classifier(weights, bias, {KINDS[k]: m.reliability() for k, m in models.items()})


def _digest(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in spans)


def detected(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and has_pii for each whole text.

    Counts and base_sha256 are of base spans; spans lists all, by kind and start, in code
    points with exclusive ends; n_added is the number beyond the base ones, and has_pii tells
    whether there is any span. A null text is an empty one: no spans. Texts of any length take time in
    proportion. Repeated rows each get a row; an empty table gives no rows; other columns aren't read.
    """
    all_found = stage(found(docs, keep, text))
    model = fit(all_found)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    added = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, has_pii boolean"

    types = {"base_sha256": pa.string(), "spans": pa.string(), "has_pii": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "has_pii")}
            for spans in batch.column(len(keep)).to_pylist():
                base, kept = [s for s in spans if s["base"]], model.accepted(spans)
                for k in range(4):
                    made[f"n_{KINDS[k]}"].append(sum(s["kind"] == k for s in base))
                made["base_sha256"].append(hashlib.sha256(_digest(base).encode()).hexdigest())
                made["spans"].append(_digest(kept))
                made["n_added"].append(len(kept) - len(base))
                made["has_pii"].append(bool(kept))
            arrays = [pa.array(v, types.get(n, pa.int64())) for n, v in made.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *arrays], names=[*keep, *made])

    return all_found.mapInArrow(run, f"{fields}, {added}" if keep else added)


def mask(text: str, spans: list[dict]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, at = [], 0
    regions: list[list[int]] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
        if regions and s["start"] < regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], s["end"])
        else:
            regions.append([s["start"], s["end"], s["kind"]])
    for a, b, kind in regions:
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with personal data in `text` replaced; other columns, and null texts, as they are.

    Repeated rows are all masked alike; spans that overlap, also of different kinds, go as one; an empty table stays empty.
    """
    all_found = stage(found(docs, [], text))
    model = fit(all_found)
    release(all_found)

    def work():
        return lambda texts: {"__masked": pa.array([None if t is None else mask(t, model.accepted(_described(t))) for t in texts], pa.string())}

    bare, new, back = carried(docs)
    made = per_text(bare, new[text], [c for c in bare.columns if c != new[text]], "__masked string", work)
    return back(made.withColumnRenamed("__masked", new[text]))
