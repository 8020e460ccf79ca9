"""Quality: document scores learned from preference pairs (Bradley-Terry), cut at a score quantile.

A document's features are its surface statistics (shares of character classes, repeated words
and lines, word and line lengths) and the relative frequencies of its hashed character 1- and
2-grams. Training forms pairs of a preferred (label 1) and a rejected (label 0) document; the
model P(a over b) = sigmoid(w . (x_a - x_b)) is fitted by logistic loss on the differences.
The cut is the quantile of the training scores at the share of label 0; the score returned
is a logistic curve of (w . x - cut) that passes through ``CUT_SCORE`` at the cut.

Nulls and empty texts have the features of a text without characters. Very long texts are read
whole. Repeated labels of a document count once, label 1 first; of repeated rows of an id the
least text is learned from, and all are scored. Documents of the sample are taken in hash order
(ties: by id); equal texts have equal scores, and a score of the cut passes. With labels of one
class only every document gets that class, without labels all score 0.5 and are kept. Empty tables
give empty results. ``keep_good`` passes other columns on, whatever their names.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, map_rows
from ._linear import minimize, ngram_slots, sigmoid

#: At most so many labelled documents, in hash order of their ids, are used for learning.
TRAIN_ROWS = 4000
#: Preferred documents that each rejected document is compared with (or the reverse).
PAIRS = 30000
CUT_SCORE = 0.3
GRAM_BITS = 9

_CLASS = np.full(256, 7, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 newline, 5 .,;:!?'"()- 6 other ASCII, 7 beyond
_CLASS[:128] = 6
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[[32, 9, 13]], _CLASS[10] = 3, 4
_CLASS[[ord(x) for x in ".,;:!?'\"()-"]] = 5


def features(text: str | None) -> np.ndarray:
    """Dense features of one whole text, float32."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=8) / max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    n, distinct = max(1, len(words)), len(set(words))
    adjacent = sum(map(operator.eq, words, words[1:])) / n
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?'\")" for w in words) / n
    bare = sum(not any(map(str.isalnum, w)) for w in words if len(w) < 4) / n
    stats = [
        *np.sqrt(kinds), np.sqrt(adjacent), np.sqrt(odd), np.sqrt(bare), np.log1p(len(text)),
        np.log1p(n) - np.log1p(distinct), np.log1p(len(lines)) - np.log1p(len(set(lines))),
        len(text) / n / 10, np.log1p(n / max(1, len(lines))),
    ]
    grams = np.zeros(1 << GRAM_BITS, np.int64)
    for slots in ngram_slots(text, (1, 2), GRAM_BITS):
        grams += np.bincount(slots, minlength=len(grams))
    return np.concatenate([stats, np.sqrt(grams / max(1, grams.sum()))]).astype(np.float32)


class BradleyTerry:
    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset = weights, offset

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, pairs: int = PAIRS):
        good, bad = np.flatnonzero(y > 0), np.flatnonzero(y <= 0)
        shift = float(np.log(CUT_SCORE / (1 - CUT_SCORE)))
        if not len(good) or not len(bad):
            return cls(np.zeros(x.shape[1] if x.ndim == 2 else len(features(""))), 5.0 if len(good) else -5.0 if len(bad) else 0.0)
        mean, scale = x.mean(0), x.std(0) + 1e-3
        z = (x - mean) / scale
        draw = np.random.default_rng(7)
        each = min(max(pairs, len(x)), len(good) * len(bad))
        win = np.concatenate([good, draw.choice(good, each)])  # each document is in one pair at least
        lose = np.concatenate([draw.choice(bad, len(good)), bad[np.arange(each) % len(bad)]])

        def loss(w):
            s = z @ w
            margin = s[win] - s[lose]
            pull = -sigmoid(-margin) / len(win)
            to = np.bincount(win, pull, len(z)) - np.bincount(lose, pull, len(z))
            return float(np.logaddexp(0, -margin).mean() + penalty / 2 * w.dot(w)), z.T @ to + penalty * w

        w = minimize(loss, np.zeros(z.shape[1]), 120)
        s = np.sort(z @ w)
        cut = (s[len(bad) - 1] + s[len(bad)]) / 2  # the quantile at the share of label 0
        w = w / scale
        return cls(w, float(shift - cut - mean.dot(w)))

    def __call__(self, text: str | None) -> float:
        return float(sigmoid(features(text).dot(self.weights) + self.offset))


def fit(docs: DataFrame, labels: DataFrame, usable=None, rows: int = TRAIN_ROWS) -> BradleyTerry:
    one = labels.filter("quality is not null and doc_id is not null")
    one = one if usable is None else one.filter(usable)
    some = one.groupBy("doc_id").agg(F.max("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` pairs of numbers: safe to send to every executor
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = sample.select("doc_id", "text", "y")
    got = map_rows(sample, lambda: lambda i, text, y: (i, y, features(text).tobytes()), "doc_id bigint, y int, x binary").collect()
    got.sort(key=lambda r: r.doc_id)
    x = np.array([np.frombuffer(r.x, np.float32) for r in got], np.float64)
    return BradleyTerry.fit(x, np.array([r.y for r in got]))


def score(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, rejected below ``CUT_SCORE``) of every row, over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few KB
    make = lambda: lambda doc_id, text: (doc_id, shared.value(text))
    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), make, "doc_id bigint, score double")


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, ~held_out("doc_id", 5, 0))
    return score(docs, model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay, and repeated rows too."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.filter(_score_column(model)(F.col("text")) >= CUT_SCORE)


def _score_column(model):
    """Arrow function of the text column, so that other columns never leave the JVM."""

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array([model.value(t.as_py()) for t in text], pa.float64())

    return scored
