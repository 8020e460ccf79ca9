"""Toxicity: a character n-gram linear classifier on naive-Bayes scaled features.

Every n-gram of ``ORDERS`` (lower-cased code points, the text padded with a blank on both
sides) sets one hashed 0/1 feature. Each feature is scaled by its naive Bayes log-count
ratio r = ln((p / |p|) / (q / |q|)), p and q being the smoothed counts in toxic and other
training texts, and a logistic regression with L2 penalty is fitted on the scaled features.

Nulls and empty texts are scored like a text without n-grams. Very long texts are read whole, in
pieces. A document without a label is only scored. Repeated documents are scored alike; repeated
labels count once, toxic first, and of repeated rows of an id the least text is learned from.
The sample is taken in hash order of the ids (ties: by id). With no usable label of one class the
score is that of the class at hand (0.5 without labels); an empty table gives an empty result.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, map_rows
from ._linear import Presence, Rows, minimize, sigmoid

ORDERS, BITS = (3, 4, 5), 18
#: At most so many labelled documents of each class are used for learning.
TRAIN_PER_CLASS = 1500


class NaiveBayesScaled:
    """Weights (ratio times coefficient) for each slot, and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float, orders=ORDERS, bits=BITS):
        self.weights, self.intercept, self.orders, self.bits = weights, intercept, orders, bits

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, orders=ORDERS, bits=BITS, penalty: float = 0.003):
        width, labels = 1 << bits, np.asarray(labels, float)
        if len(labels) == 0 or labels.min() == labels.max():
            prior = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
            return cls(np.zeros(width, np.float32), float(np.log(prior / (1 - prior))), orders, bits)
        x = Rows(rows, width)
        p, q = 1.0 + x.back(labels), 1.0 + x.back(1.0 - labels)
        ratio = np.log((p / p.sum()) / (q / q.sum()))
        sign = 2 * labels - 1
        balance = np.where(labels > 0, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())

        def loss(v):
            z = sign * (x.dot(ratio * v[:-1]) + v[-1])
            g = -sign * sigmoid(-z) * balance
            down = np.append(ratio * x.back(g), g.sum())
            down[:-1] += penalty * v[:-1]
            return float((np.logaddexp(0, -z) * balance).sum() + penalty / 2 * v[:-1].dot(v[:-1])), down

        v = minimize(loss, np.zeros(width + 1))
        return cls((v[:-1] * ratio).astype(np.float32), float(v[-1]), orders, bits)

    def scorer(self):
        present = Presence(self.orders, self.bits)
        return lambda text: float(sigmoid(self.weights[present(text)].sum(dtype=np.float64) + self.intercept))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, usable, per_class: int) -> DataFrame:
    """(text, y) of at most ``per_class`` labelled documents of each class, in hash order of the id."""
    one = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    one = one if usable is None else one.filter(usable)
    one = one.groupBy("doc_id").agg(F.max(label).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = one.filter("y = 1").orderBy(*order).limit(per_class)
    some = some.unionByName(one.filter("y = 0").orderBy(*order).limit(per_class))
    # at most 2 * per_class pairs of numbers: safe to send to every executor
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return met.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, usable=None, per_class: int = TRAIN_PER_CLASS) -> NaiveBayesScaled:
    """Learn from labelled rows that satisfy ``usable`` (a condition on ``labels.doc_id``)."""
    sample = training_sample(docs, labels, "toxic", usable, per_class)

    def make():
        present = Presence(ORDERS, BITS)
        return lambda doc_id, text, y: (doc_id, y, present(text).tobytes())

    got = map_rows(sample, make, "doc_id bigint, y int, slots binary").collect()
    got = sorted((r.doc_id, r.y, r.slots) for r in got)
    return NaiveBayesScaled.fit([np.frombuffer(x, np.int32) for _, _, x in got], np.array([y for _, y, _ in got]))


def score(docs: DataFrame, model: NaiveBayesScaled) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every row of ``docs``, over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats: 1 MB

    def make():
        scorer = shared.value.scorer()
        return lambda doc_id, text: (doc_id, scorer(text))

    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), make, "doc_id bigint, score double")


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, ~held_out("doc_id", 3, 1))
    return score(docs, model).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
