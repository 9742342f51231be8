"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import store, words

LENGTHS = (3, 4, 5)        # characters of an n-gram, word edges included
SLOTS = 1 << 20            # n-grams are hashed to so many features
TRAIN_ROWS = 9_000         # texts of each label that a model is fitted on, at most about as many
FIT_BYTES = 1 << 20        # text split at once while fitting
SCORE_BYTES = 2 << 20      # text scored at once; its words' n-grams take many times that
CHUNK = 1 << 18            # words that a step of the fit looks at together
LEAST_TEXTS = 3            # words of fewer training texts are left out while fitting


def grams(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each character n-gram of each word, and where each word's start.

    A word has a space on either side; of repeated n-grams in a word each counts.
    """
    size = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    joined = "".join(f" {w} " for w in vocabulary.to_pylist())
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(size)
    found, owner = [], []
    word = np.repeat(np.arange(len(size)), size)
    for n in LENGTHS:
        count = np.maximum(size - n + 1, 0)
        at = store.ranges(ends - size, count)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = h * words.MULTIPLY + chars[at + i]
        found.append((words.mix(h) >> np.uint64(44)).astype(np.int32))
        owner.append(word[at])
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(size)))))
    return found[order], starts


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each run of values."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[starts[1:]] - total[starts[:-1]]


def text_words(array: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct lower-case words of each text: codes, where each text's start, dictionary."""
    codes, offsets, vocabulary = words.split(pc.utf8_lower(array))
    row = np.repeat(np.arange(len(array)), np.diff(offsets))
    both = np.unique(row * max(1, len(vocabulary)) + codes)
    row, codes = both // max(1, len(vocabulary)), both % max(1, len(vocabulary))
    return codes, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(array))))), vocabulary


@dataclass
class Model:
    bias: float
    weights: np.ndarray      # of each feature, the log-count ratio already multiplied in

    def scores(self, array: pa.Array) -> np.ndarray:
        """Probability of label 1 of each text."""
        codes, starts, vocabulary = text_words(array)
        feature, begin = grams(vocabulary)
        word = sums(self.weights[feature], begin)
        z = self.bias + sums(word[codes], starts)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(codes: np.ndarray, starts: np.ndarray, vocabulary: pa.Array, label: np.ndarray,
          penalty: float = 1e-3, steps: int = 120, smooth: float = 1.0) -> Model:
    """Weights by naive Bayes log-count ratios and logistic loss with a quadratic penalty.

    The loss weighs both labels alike. Steps are those of gradient descent with momentum
    and a step size per weight (Adam), from zero, so a fit has one result.
    """
    kept = np.bincount(codes, minlength=len(vocabulary)) >= LEAST_TEXTS
    use = kept[codes]
    starts = np.concatenate(([0], np.cumsum(use)))[starts]
    codes = (np.cumsum(kept) - 1).astype(np.int32)[codes[use]]
    feature, begin = grams(vocabulary.filter(pa.array(kept)))
    used, feature = np.unique(feature, return_inverse=True)
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1], CHUNK)), len(label)))
    chunks = [(a, b, codes[starts[a]:starts[b]], starts[a:b + 1] - starts[a]) for a, b in zip(cuts, cuts[1:])]

    def per_feature(per_text: np.ndarray) -> np.ndarray:
        per_word = np.zeros(len(begin) - 1)
        for a, b, part, at in chunks:
            per_word += np.bincount(part, weights=np.repeat(per_text[a:b], np.diff(at)), minlength=len(per_word))
        return np.bincount(feature, weights=per_word[owner], minlength=len(used))

    positive, negative = smooth + per_feature(label), smooth + per_feature(1 - label)
    ratio = np.log(positive / positive.sum()) - np.log(negative / negative.sum())
    weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    theta, bias = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        word = sums((theta * ratio)[feature], begin)
        z = np.full(len(label), bias)
        for a, b, part, at in chunks:
            z[a:b] += sums(word[part], at)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label)
        slope = np.append(ratio * per_feature(error) + penalty * theta, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        theta, bias = theta - move[:-1], bias - move[-1]
    weights = np.zeros(SLOTS, np.float32)
    weights[used] = theta * ratio
    return Model(float(bias), weights)


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` ids of each label at most, chosen by hash: ``(doc_id, label)``."""
    one = (labelled.where("doc_id is not null and label in (0, 1)").groupBy("doc_id")
           .agg(F.max("label").cast("double").alias("label")))
    counts = one.groupBy("label").count().collect()      # two rows
    share = F.lit(0)
    for r in counts:
        share = F.when(F.col("label") == r["label"], int(min(1.0, rows / r["count"]) * (1 << 20))).otherwise(share)
    return one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)


def fit(docs: DataFrame, labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model for ``label`` of ``labelled`` (doc_id, label) from the texts of ``docs``.

    Fitted by one task on a bounded sample: about ``rows`` texts of each label at most,
    chosen by the hash of their id; the task holds their distinct words. Many tasks look
    for the sampled texts, and only those are sent to it, in one order. Rows without a
    text, id or label are not used; an id with both labels counts as 1. If a label has no
    text, every score is the share of label 1, or 0.5 without any labelled text.
    """
    sample = F.broadcast(_sample(labelled, rows))        # bounded by ``rows``
    texts = docs.select("doc_id", "text").where("text is not null").join(sample, "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, labels, known = [], [], [], {}
        for batch in store.slices(batches, limit=FIT_BYTES):
            own, starts, vocabulary = text_words(store.texts(batch))
            place = np.array([known.setdefault(w, len(known)) for w in vocabulary.to_pylist()], np.int32)
            codes.append(place[own])
            counts.append(np.diff(starts))
            labels.append(store.column(batch, "label").to_numpy())
        label = np.concatenate([np.zeros(0), *labels])
        if len(np.unique(label)) < 2:
            share = (label.sum() + 0.5) / (len(label) + 1)
            model = Model(float(np.log(share / (1 - share))), np.zeros(SLOTS, np.float32))
        else:
            starts = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
            own, vocabulary = np.concatenate(codes), pa.array(known, pa.string())
            codes.clear()
            known.clear()
            model = train(own, starts, vocabulary, label)
        yield pa.RecordBatch.from_pydict({"bias": [model.bias], "weights": pa.array([model.weights.tobytes()], pa.binary())})

    one = texts.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "label")
    found = one.mapInArrow(lambda batches: store.released(run(batches)), "bias double, weights binary").collect()
    if not found:
        return Model(0.0, np.zeros(SLOTS, np.float32))
    return Model(found[0]["bias"], np.frombuffer(found[0]["weights"], np.float32))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``score``, the probability of label 1 from the whole text, to ``keep``.

    Null and empty texts score as a text without words. Every row is scored by its text
    alone, so repeated rows score alike. Columns outside ``keep`` are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)     # SLOTS weights, always
    rows = docs.select(*keep, docs["text"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches, "_text", SCORE_BYTES):
            yield pa.RecordBatch.from_arrays(
                [*(store.column(batch, k) for k in keep),
                 pa.array(shared.value.scores(store.texts(batch, "_text")))], names=[*keep, "score"])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(lambda batches: store.released(run(batches)), f"{schema}, score double")


def clean(docs: DataFrame, model: Model, reject: float) -> DataFrame:
    """The rows of ``docs`` whose score is below ``reject``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches, limit=SCORE_BYTES):
            yield batch.filter(pa.array(shared.value.scores(store.texts(batch)) < reject))

    return docs.mapInArrow(lambda batches: store.released(run(batches)), docs.schema)
