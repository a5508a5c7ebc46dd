"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the distinct byte n-grams of its words (A-Z lower-cased, one space
between words), hashed into BUCKETS. A feature's value is its log-count ratio: how much more
often texts labelled 1 have it than texts labelled 0. The classifier is a logistic regression
on these values. It is learnt from a bounded sample of labelled rows; every text is scored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatloom.llm.frames import by_bytes, kept_in_table, quoted
from threatloom.llm.quality import labelled_sample
from threatloom.llm.words import words_of

SIZES = (3, 4, 5)
BUCKETS = 1 << 20
#: Labelled rows used for training, at most.
LABELLED_ROWS = 20_000
#: Features kept: those whose ratio is surest.
FEATURES = 4096
SMOOTHING = 1.0
#: Text bytes of a slice, and bytes whose n-grams are in memory at once: a long text takes no more than a short one.
_SLICE, _BLOCK = 2 << 20, 1 << 19


def gram_slots(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every n-gram of every text, repeats included; those that begin in one block of bytes at a time."""
    words = words_of(texts)
    data = words.data
    some = np.flatnonzero(np.diff(words.first) > 0)
    edges = words.start[words.first[some]]  # where each text with words begins
    for begin in range(0, len(data), _BLOCK):
        part = data[begin : begin + _BLOCK + max(SIZES) - 1]
        inner = edges[np.searchsorted(edges, begin, side="right") : np.searchsorted(edges, begin + len(part))]
        turns = np.zeros(len(part), np.int64)
        turns[inner - begin] = 1
        owner = some[np.cumsum(turns) + np.searchsorted(edges, begin, side="right") - 1]
        code = part.astype(np.uint64)
        for size in range(2, min(max(SIZES), len(part)) + 1):
            code = code[: len(part) - size + 1] * np.uint64(256) + part[size - 1 :]
            if size in SIZES:
                inside = (owner[: len(code)] == owner[size - 1 :])[:_BLOCK]
                mixed = (code[:_BLOCK][inside] + np.uint64(size << 48)) * np.uint64(0x9E3779B97F4A7C15)
                yield owner[: len(inside)][inside], (mixed >> np.uint64(44)).astype(np.int64)


def _distinct(texts: pa.Array, slot_of: np.ndarray | None = None, features: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), each pair once. slot_of maps buckets to kept features, -1 to none."""
    pairs, more, waiting = np.zeros(0, np.int64), [], 0
    for owner, slots in gram_slots(texts):
        if slot_of is not None:
            slots = slot_of[slots]
            owner, slots = owner[slots >= 0], slots[slots >= 0]
        more.append(owner * features + slots)
        waiting += len(slots)
        if waiting > max(4 * _BLOCK, len(pairs)):  # merged at growing sizes, so that a long text costs no more per byte
            pairs, more, waiting = np.unique(np.concatenate([pairs, *more])), [], 0
    pairs = np.unique(np.concatenate([pairs, *more]))
    return pairs // features, pairs % features


@dataclass(frozen=True)
class ToxicityModel:
    """Buckets of the kept features, what each adds to the logit, and the logit of a text without any."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        slot_of = np.full(BUCKETS, -1, dtype=np.int32)
        slot_of[self.buckets] = np.arange(len(self.buckets))
        return slot_of

    def scores(self, texts: pa.Array, table: np.ndarray) -> np.ndarray:
        owner, feature = _distinct(texts, table, max(1, len(self.buckets)))
        logit = self.bias + np.bincount(owner, self.weights[feature] if len(feature) else None, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _labelled(docs: DataFrame, sample: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts of the sampled rows. The sample is bounded, so it may be broadcast whatever the corpus is."""
    narrow = docs.select(quoted(doc_id).alias("id"), quoted(text).alias("text"))
    return narrow.join(F.broadcast(sample), "id").select("text", "label")


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    labelled_rows: int = LABELLED_ROWS, features: int = FEATURES,
) -> ToxicityModel:
    """Learn from at most `labelled_rows` of the rows in `labels`. Without rows of both labels the model says their mean."""
    sample = kept_in_table(labelled_sample(labels, label, labelled_rows, doc_id), "toxicity-labels")
    known = kept_in_table(_labelled(docs, sample, doc_id, text), "toxicity-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((2, BUCKETS), dtype=np.int64)
        for part in by_bytes(batches, "text", _SLICE):
            owner, slot = _distinct(part.column("text"))
            said = part.column("label").to_numpy()[owner]
            for side in (0, 1):
                tally[side] += np.bincount(slot[said == side], minlength=BUCKETS)
        seen = np.flatnonzero(tally.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(tally[1][seen]), pa.array(tally[0][seen])], ["slot", "yes", "no"])

    counted = known.select("text", F.col("label").cast("int")).mapInArrow(count, "slot long, yes long, no long")
    summed = kept_in_table(counted.groupBy("slot").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "toxicity-counts")
    totals = summed.agg(F.sum(F.col("yes") + SMOOTHING), F.sum(F.col("no") + SMOOTHING)).first()
    sides = {row[0]: row[1] for row in known.groupBy("label").count().collect()}
    yes, no = sides.get(1, 0), sides.get(0, 0)
    if not yes or not no:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log((yes + 0.5) / (no + 0.5))))
    p, q = F.col("yes") + SMOOTHING, F.col("no") + SMOOTHING
    ratio = F.log(p / totals[0]) - F.log(q / totals[1])
    sure = F.abs(ratio) / F.sqrt(1 / p + 1 / q)
    best = summed.select("slot", ratio.alias("ratio"), sure.alias("sure")).orderBy(F.desc("sure"), "slot").limit(features).collect()
    buckets, ratios = np.array([r[0] for r in best]), np.array([r[1] for r in best])
    model = ToxicityModel(buckets, np.zeros(len(best)), 0.0)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for part in by_bytes(batches, "text", _SLICE):
            owner, feature = _distinct(part.column("text"), table, len(buckets))
            cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
            packed = [feature[a:b].astype("<u2").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(packed, pa.binary())], ["label", "features"])

    # At most labelled_rows rows of at most `features` two-byte numbers.
    rows = known.select("text", F.col("label").cast("int")).mapInArrow(reduce_rows, "label int, features binary").collect()
    rows = sorted((r[0], bytes(r[1])) for r in rows)
    weights, bias = _logistic([np.frombuffer(r[1], "<u2") for r in rows], np.array([r[0] for r in rows], float), ratios)
    return ToxicityModel(buckets, weights * ratios, bias)


def _logistic(rows: list[np.ndarray], said: np.ndarray, ratios: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on the ratios of the features that a row has; accelerated gradient steps."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows).astype(np.int64) if len(owner) else np.zeros(0, np.int64)
    value = ratios[feature]
    scale = np.sqrt(np.bincount(owner, value * value, minlength=len(rows)).mean()) + 1e-9
    value = value / scale
    weights, bias = np.zeros(len(ratios)), float(np.log((said.sum() + 0.5) / (len(said) - said.sum() + 0.5)))
    ahead, ahead_bias, pace = weights, bias, 1.0
    # Both classes weigh the same, and the step suits the mean squared length of a row, which is 1.
    share = np.where(said == 1, 0.5 / max(said.sum(), 1), 0.5 / max(len(said) - said.sum(), 1))
    for _ in range(steps):
        logit = np.bincount(owner, value * ahead[feature], minlength=len(rows)) + ahead_bias
        slip = share * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - said)
        gradient = np.bincount(feature, value * slip[owner], minlength=len(ratios)) + penalty * ahead
        following, following_bias = ahead - gradient, ahead_bias - slip.sum()
        quicker = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        push = (pace - 1) / quicker
        ahead, ahead_bias = following + push * (following - weights), following_bias + push * (following_bias - bias)
        weights, bias, pace = following, following_bias, quicker
    return weights / scale, float(bias)


def score(text: Column, model: ToxicityModel) -> Column:
    """Chance (0 to 1) that a text is toxic; null and empty texts get the one of a text without features."""

    def run(texts: pa.Array) -> pa.Array:
        table = model.table()
        parts = [model.scores(part.column("text"), table) for part in by_bytes(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", _SLICE)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.arrow_udf(run, T.DoubleType())(text)
