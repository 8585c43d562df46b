"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character n-grams of words (with word borders), present or
absent in a text.  Over the labelled texts two counts per bucket are summed in
Spark: toxic and other texts that hold it.  The buckets whose presence tells
most about the label are kept, each scaled by its smoothed log-count ratio, and
a regularised logistic regression is trained on the scaled features.

Only the fit is bounded: ``sample`` labelled rows at most, taken in the order of
a hash of their id (``SAMPLE``); the table gathered has ``BUCKETS`` rows at most.

Defined results: a null or empty text gets the score of a text without
features; rows without a label, or whose label is neither 0 nor 1, are not
learned from; labels of one kind only, or none, give every text that kind's
smoothed prior; a null id is returned like any other; rows that repeat come back
as often as they were given; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_and_text, per_batch, raw, stored
from ledgerlens.llm.grams import code_points, grams

BITS = 18
BUCKETS = 1 << BITS
#: Features kept for the regression, at most, and what each must tell about the label (log-likelihood ratio / 2).
KEPT = 1 << 11
GAIN = 3.0
#: Labelled rows used by the fit, at most.
SAMPLE = 100_000
THRESHOLD = 0.7
SIZES = (3, 4, 5, 6)
#: Words whose n-grams are hashed at once, which bounds the memory for very long texts.
WORDS_AT_ONCE = 1 << 14


@dataclass
class Model:
    """``weight`` per bucket (already times the log-count ratio); buckets that were not kept have 0."""

    weight: np.ndarray
    bias: float
    key: str = field(default_factory=lambda: os.urandom(8).hex())


def pieces(text: bytes | None) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, some at a time; a bucket may come more than once."""
    words = (text or b"").decode().lower().split()
    for at in range(0, len(words), WORDS_AT_ONCE):
        points = code_points(" " + " ".join(words[at: at + WORDS_AT_ONCE]) + " ")
        for _, found in grams(points, SIZES, BITS):
            yield found


class Present:
    """The different buckets of a text, sorted, among those that ``wanted`` allows."""

    def __init__(self, wanted: np.ndarray | None = None):
        self._seen, self._wanted = np.zeros(BUCKETS, bool), wanted

    def __call__(self, text: bytes | None) -> np.ndarray:
        if self._wanted is not None:
            found = [x[self._wanted[x]] for x in pieces(text)]
            return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        for found in pieces(text):
            self._seen[found] = True
        at = np.flatnonzero(self._seen)
        self._seen[at] = False
        return at


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(text, label) of at most ``sample`` labelled rows; the choice depends on the ids alone."""
    marks = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most ``sample`` pairs of numbers, a few MB: the texts stay where they are
    return id_and_text(docs, id_col, text_col).join(F.broadcast(marks), "doc_id").select("text", "label")


def fit(texts: DataFrame, alpha: float = 1.0, penalty: float = 1e-3, steps: int = 150) -> Model:
    """Train on (text, label); see :func:`labelled_texts` for the bound on its rows."""
    def counted(batches):
        present = Present()
        table, texts_seen = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(raw(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                table[label][present(text)] += 1
                texts_seen[label] += 1
        at = np.flatnonzero(table.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(table[0, at], texts_seen[0])),
                                          pa.array(np.append(table[1, at], texts_seen[1]))], ["bucket", "other", "toxic"])

    texts = stored(texts, "toxicity-labelled")
    sums = (texts.mapInArrow(counted, "bucket int, other long, toxic long").groupBy("bucket")
            .agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow())
    bucket = sums.column("bucket").to_numpy()
    n = np.zeros((2, BUCKETS + 1))
    n[0, bucket], n[1, bucket] = sums.column("other").to_numpy(), sums.column("toxic").to_numpy()
    total, n = n[:, -1].copy(), n[:, :-1]
    prior = float(np.log((total[1] + alpha) / (total[0] + alpha)))
    if not total.all():
        return Model(np.zeros(BUCKETS, np.float32), prior)
    rate = (n + alpha) / (total[:, None] + 2 * alpha)
    ratio = np.log(rate[1] / rate[0])
    # what the presence of a bucket tells about the label: its mutual information, from the four counts
    gain = np.zeros(BUCKETS)
    for there in (n, total[:, None] - n):
        both = there.sum(axis=0)
        for k in (0, 1):
            gain += there[k] * np.log(np.maximum(there[k], 1e-9) * total.sum() / np.maximum(both * total[k], 1e-9))
    order = np.lexsort((np.arange(BUCKETS), -gain))[:KEPT]
    kept = np.sort(order[gain[order] >= GAIN])
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    shared = texts.sparkSession.sparkContext.broadcast(place)

    def rows(batch_iter):
        present = Present(shared.value >= 0)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shared.value[present(t)].tobytes() for t in raw(batch.column(0))]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["found", "label"])

        yield from per_batch(one)(batch_iter)

    held = texts.mapInArrow(rows, "found binary, label int").toArrow()
    parts = [np.frombuffer(x, np.int32) for x in held.column("found").to_pylist()]
    y = held.column("label").to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    col = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    weight, bias = _regress(row, col, ratio[kept], y, prior, penalty, steps)
    out = np.zeros(BUCKETS, np.float32)
    out[kept] = weight * ratio[kept]
    return Model(out, bias)


def _regress(row: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, prior: float, penalty: float,
             steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on scaled presence features: full-batch Adam steps on the penalised mean loss."""
    w, b = np.zeros(len(scale) + 1), prior
    w[-1] = b
    m, v = np.zeros_like(w), np.zeros_like(w)
    x = scale[col]
    each = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * 0.5 + 0.5 / len(y)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=x * w[col], minlength=len(y)) + w[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * each
        g = np.append(np.bincount(col, weights=x * miss[row], minlength=len(scale)) + penalty * w[:-1], miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


class Scorer:
    """Scores texts with a model."""

    def __init__(self, model: Model):
        self._model, self._present = model, Present(model.weight != 0)

    def __call__(self, text: bytes | None) -> float:
        z = self._model.bias + float(self._model.weight[self._present(text)].sum())
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def score_column(spark, model: Model, text_col: str = "text"):
    """A column with the score of each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        scorer = _scorer(shared)
        return pa.array([scorer(t) for t in raw(texts)], pa.float64())

    return score(F.col(text_col).cast("string"))


#: The scorer of the model that this Python worker used last.
_LAST: dict[str, Scorer] = {}


def _scorer(shared) -> Scorer:
    key = shared.value.key
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Scorer(shared.value)
    return _LAST[key]


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) per row."""
    rows = id_and_text(docs, id_col, text_col)
    return (rows.select("doc_id", score_column(docs.sparkSession, model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
