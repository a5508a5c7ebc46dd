"""Personal data: base patterns, and further spans judged by weak supervision.

The base patterns always stand. Beside them, looser patterns give candidates: long digit
groups, numbers with bracketed or dashed groups, long letter-digit strings, addresses with
"at" written out. Labelers of three kinds vote on each candidate (yes, no, no opinion): regular
expressions on its shape, gazetteers of cue words around it, and its context. Candidates with
the same votes are alike to the model, so Spark counts vote patterns and expectation
maximisation runs on these counts, of which there are few however large the corpus is. It
estimates how reliable each labeler is and how likely a pattern is to be personal data. A
logistic span classifier is then trained on the features of candidates, weighted by these
probabilities, and judges every candidate.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.frames import by_bytes, give_back, kept_in_table, lean, quoted

# --- Fixed values: base patterns ------------------------------------------------------
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
# ---------------------------------------------------------------------------------------
Span = tuple[int, int, int]  # start, end, number of the kind

MORE_KINDS = ("account", "number", "secret", "address")
ALL_KINDS = KINDS + MORE_KINDS


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


_WORD_WITH_AT = re.compile(r"[^\s@]*@\S*")
_ANY_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind. Leftmost non-overlapping per kind; failing matches are dropped."""
    found: list[Span] = []
    if "@" in text:
        for word in _WORD_WITH_AT.finditer(text):
            found += [(m.start(), m.end(), 0) for m in EMAIL.finditer(text, word.start(), word.end())]
    if _ANY_DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m.group().split("."))):
                found.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = re.sub("[^0-9]", "", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), m.end(), 3))
    return sorted(found)


# ---- candidates, labelers, features -----------------------------------------------------

_CANDIDATES = (
    ("account", re.compile(r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){8,}(?![0-9A-Za-z])")),
    ("number", re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ ./-]?[0-9]{3,6}(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*[0-9])[0-9A-Za-z_-]{20,}(?![0-9A-Za-z_-])")),
    ("address", re.compile(r"(?<![\w.])[\w.]{1,64}(?: at |\(at\)|\[at\])[\w-]{1,63}(?: dot |\(dot\)|\[dot\]|\.)[\w-]{2,63}", re.ASCII)),
)
#: Cue words, each list in the order of the kinds they speak for.
GAZETTEER = {
    "account": ("account", "card", "iban", "konto", "cuenta", "compte", "karte", "tarjeta", "carte"),
    "number": ("phone", "tel", "call", "mobile", "fax", "telefon", "llamar", "appeler"),
    "secret": ("token", "secret", "password", "passwd", "apikey", "api_key", "key", "bearer", "credential"),
    "address": ("mail", "email", "e-mail", "contact", "correo", "courriel", "kontakt"),
}
NOT_PERSONAL = ("version", "isbn", "issn", "license", "chapter", "page", "figure", "table", "section", "rfc", "commit", "sha", "md5")
CONTEXT = 24
_ASSIGNED = re.compile(r"[=:]\s*[\"'`]?$")
_HEXES = re.compile(r"[0-9a-fA-F]+")


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: int  # in ALL_KINDS
    text: str
    before: str
    after: str


def candidates(text: str, base: list[Span]) -> list[Candidate]:
    """Spans that the looser patterns find and no base span overlaps; the earlier pattern wins an overlap."""
    if not (_ANY_DIGIT.search(text) or " at " in text or "at)" in text or "at]" in text):
        return []
    taken: list[tuple[int, int]] = []  # in order and apart, so only the two neighbours of a span can overlap it
    for a, b, _ in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    found: list[Candidate] = []
    for name, pattern in _CANDIDATES:
        if name == "address" and not (" at " in text or "(at)" in text or "[at]" in text):
            continue
        free = []
        for m in pattern.finditer(text):
            a, b = m.span()
            at = bisect_left(taken, (a, b))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                found.append(Candidate(a, b, ALL_KINDS.index(name), m.group(), text[max(0, a - CONTEXT) : a].lower(), text[b : b + CONTEXT].lower()))
                free.append((a, b))
        taken = sorted(taken + free)
    return sorted(found, key=lambda c: (c.start, c.kind))


def _spread(text: str) -> float:
    """Distinct characters per character: near 0 for rulers and fillers."""
    return len(set(text)) / max(1, min(len(text), 36))


def votes(c: Candidate) -> list[int]:
    """What each labeler says: 1 personal, 0 not, -1 no opinion. One entry per labeler, the same for all kinds."""
    digits = sum(ch.isdigit() for ch in c.text)
    name = ALL_KINDS[c.kind]
    words = re.findall(r"[a-zé_-]+", c.before)
    plain = re.sub(r"[ -]", "", c.text)
    return [
        # regular expressions on the shape
        {"account": int(13 <= digits <= 19), "number": int(9 <= digits <= 12), "secret": int(bool(_HEXES.fullmatch(c.text)) and len(c.text) in (32, 40, 64)), "address": 1}[name],
        int(0.15 < digits / len(c.text)) if name == "secret" else (1 if plain.isdigit() and len(plain) in (10, 11, 15, 16) else -1),
        0 if _spread(plain) < 0.2 else -1,
        # gazetteers
        1 if any(w in GAZETTEER[name] for w in words[-4:]) else -1,
        0 if any(w in NOT_PERSONAL for w in words[-4:]) else -1,
        # context
        1 if _ASSIGNED.search(c.before) else -1,
        0 if c.after[:1] in {".", "/", "%"} and c.after[1:2].isdigit() else -1,
        0 if re.search(r"[0-9][.,/]$", c.before) else -1,
    ]


LABELERS = 8
FEATURES = 14


def features(c: Candidate) -> list[float]:
    """What the span classifier sees."""
    digits = sum(ch.isdigit() for ch in c.text)
    letters = sum(ch.isalpha() for ch in c.text)
    name = ALL_KINDS[c.kind]
    words = re.findall(r"[a-zé_-]+", c.before)
    return [
        1.0,
        *[float(name == kind) for kind in MORE_KINDS],
        min(len(c.text), 64) / 64,
        digits / len(c.text),
        letters / len(c.text),
        _spread(re.sub(r"[ -]", "", c.text)),
        float(any(w in GAZETTEER[name] for w in words[-4:])),
        float(any(w in NOT_PERSONAL for w in words[-4:])),
        float(bool(_ASSIGNED.search(c.before))),
        float(c.after[:1] in {".", "/", "%"} and c.after[1:2].isdigit()),
        float(bool(re.search(r"[0-9][.,/]$", c.before))),
    ]


# ---- learning ----------------------------------------------------------------------------


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Chance of each vote pattern to be personal data, the labelers' reliabilities and the prior.

    patterns: votes (-1, 0, 1), one row per distinct pattern; counts: how often it occurs. A
    labeler has one reliability, the chance that an opinion of its is right, kept within
    0.55 .. 0.99, which also settles which of the two classes is which. A labeler without an
    opinion says nothing. No patterns give a prior of one half.
    """
    reliability, prior = np.full(patterns.shape[1], 0.8), 0.5
    chance = np.full(len(patterns), 0.5)
    if not len(patterns):
        return chance, reliability, prior
    says = patterns >= 0
    for _ in range(rounds):
        right = np.log(reliability)[None, :]
        wrong = np.log(1 - reliability)[None, :]
        yes = np.where(says, np.where(patterns == 1, right, wrong), 0).sum(axis=1) + np.log(prior)
        no = np.where(says, np.where(patterns == 0, right, wrong), 0).sum(axis=1) + np.log(1 - prior)
        chance = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        agreed = np.where(patterns == 1, chance[:, None], 1 - chance[:, None]) * says * counts[:, None]
        opinions = (says * counts[:, None]).sum(axis=0)
        reliability = np.clip((agreed.sum(axis=0) + 4) / (opinions + 5), 0.55, 0.99)
        prior = float(np.clip((chance @ counts + 1) / (counts.sum() + 2), 0.05, 0.95))
    return chance, reliability, prior


def train_classifier(rows: np.ndarray, chance: np.ndarray, weight: np.ndarray, rounds: int = 300, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a logistic classifier for soft labels, by Newton steps."""
    w = np.zeros(rows.shape[1])
    if not len(rows):
        return w
    share = weight / weight.sum()
    for _ in range(min(rounds, 25)):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (share * (p - chance)) + penalty * w
        hessian = (rows * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ rows + penalty * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return w


@dataclass(frozen=True)
class PiiModel:
    weights: tuple[float, ...]
    reliabilities: tuple[float, ...]
    threshold: float = 0.5

    def accepts(self, c: Candidate) -> bool:
        return 1 / (1 + np.exp(-float(np.dot(self.weights, features(c))))) >= self.threshold


_STEPS = 20  # feature values are counted in steps of 1 / _STEPS


def fit(docs: DataFrame, text: str = "text") -> PiiModel:
    """Reliabilities and classifier from the candidates of every document.

    Spark counts distinct (votes, features) of all candidates; features are rounded to twentieths, so
    the number of distinct rows is bounded by the labelers' and features' steps, not by the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        yield from (patterns_of(part) for part in by_bytes(batches, "text"))
        give_back()

    def patterns_of(part: pa.RecordBatch) -> pa.RecordBatch:
        tally: dict[tuple, int] = {}
        for value in part.column("text"):
            body = value.as_py()
            if body:
                for c in candidates(body, base_spans(body)):
                    key = (tuple(votes(c)), tuple(round(f * _STEPS) for f in features(c)))
                    tally[key] = tally.get(key, 0) + 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([list(k[0]) for k in tally], pa.list_(pa.int32())),
                pa.array([list(k[1]) for k in tally], pa.list_(pa.int32())),
                pa.array(list(tally.values()), pa.int64()),
            ],
            ["votes", "features", "n"],
        )

    found = docs.select(quoted(text).alias("text")).mapInArrow(run, "votes array<int>, features array<int>, n long")
    counted = kept_in_table(found.groupBy("votes", "features").agg(F.sum("n").alias("n")), "pii-patterns")
    patterns = counted.groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    known = np.array([r[0] for r in patterns], dtype=np.int64).reshape(-1, LABELERS)
    chance, reliability, _ = expectation_maximisation(known, np.array([r[1] for r in patterns], dtype=float))
    by_votes = {tuple(row): p for row, p in zip(known.tolist(), chance, strict=True)}
    rows = counted.orderBy("votes", "features").collect()
    seen = np.array([r[1] for r in rows], dtype=float).reshape(-1, FEATURES) / _STEPS
    soft = np.array([by_votes[tuple(r[0])] for r in rows])
    weights = train_classifier(seen, soft, np.array([r[2] for r in rows], dtype=float))
    return PiiModel(tuple(weights.tolist()), tuple(reliability.tolist()))


# ---- finding and masking --------------------------------------------------------------------


def _told(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for a, b, k in spans)


_FOUND = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())]
)


def find(text: Column, model: PiiModel) -> Column:
    """Struct of the numbers of base spans per kind, the base spans and all spans as `kind:start:end` text.

    Offsets count code points, ends exclusive; spans are ordered by start, then kind. Null and
    empty texts have none.
    """

    def run(texts: pa.Array) -> pa.Array:
        lean()
        counts: list[list[int]] = [[] for _ in KINDS]
        base_told, all_told = [], []
        for value in texts:
            body = value.as_py() or ""
            base = base_spans(body)
            more = [(c.start, c.end, c.kind) for c in candidates(body, base) if model.accepts(c)]
            for k in range(len(KINDS)):
                counts[k].append(sum(s[2] == k for s in base))
            base_told.append(_told(base))
            all_told.append(_told(sorted(base + more)))
        arrays = [pa.array(c, pa.int64()) for c in counts] + [pa.array(x, pa.string()) for x in (base_told, all_told)]
        return pa.StructArray.from_arrays(arrays, names=_FOUND.names)

    return F.arrow_udf(run, _FOUND)(text)


def mask(text: Column, model: PiiModel) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one. Null stays null."""

    def masked(body: str) -> str:
        base = base_spans(body)
        spans = sorted(base + [(c.start, c.end, c.kind) for c in candidates(body, base) if model.accepts(c)])

        apart: list[Span] = []
        for a, b, k in spans:
            if apart and a < apart[-1][1]:
                apart[-1] = (apart[-1][0], max(apart[-1][1], b), apart[-1][2])
            else:
                apart.append((a, b, k))
        out, at = [], 0
        for a, b, k in apart:
            out += [body[at:a], f"<{ALL_KINDS[k]}>"]
            at = b
        return "".join([*out, body[at:]])

    def run(texts: pa.Array) -> pa.Array:
        lean()
        told = pa.array((None if not v.is_valid else masked(v.as_py()) for v in texts), pa.string())
        give_back()
        return told

    return F.arrow_udf(run, T.StringType())(text)
