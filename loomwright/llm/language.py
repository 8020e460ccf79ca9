"""Language identification with error-correcting output codes.

Each language of the training labels gets a codeword; for every bit a logistic classifier on
hashed character 1- to 3-gram frequencies predicts the bit. A text's language is the codeword
with the least weighted logistic loss over the bits (weights: how well the bit was learned);
the score is the winner's share of exp(-loss), and a small lead over the second flags
ambiguity. With up to 7 languages all distinct splits are used (an exhaustive code), beyond
that random splits with a fixed seed, well over ten per doubling of the languages.

``und`` is given to nulls, empty texts and texts without a letter (Unicode category L), with
score 0. Without any labelled document every text is ``und``, and an empty table gives an empty
result. Very long texts are read whole, in pieces. Ties between languages go to the first in
order of name. Repeated rows get equal answers; in the sample an id counts once in a language.
Only doc_id, lang and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, map_rows
from ._linear import Rows, minimize, ngram_slots, sigmoid

ORDERS, BITS = (1, 2, 3), 15
#: At most about so many documents of each language, and of all, are used for learning, in hash order of their ids.
TRAIN_PER_LANGUAGE, TRAIN_ROWS = 500, 8000
#: At most so many languages, the most frequent (ties: by name), are learned.
LANGUAGES = 250
#: A lead of less than this share of the score flags an ambiguous text.
AMBIGUOUS = 0.2


def codewords(classes: int) -> np.ndarray:
    """One row of +1/-1 for each class; columns are distinct splits of the classes."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 7:
        splits = range(1, 1 << (classes - 1))
        return np.array([[1 if s >> c & 1 else -1 for s in splits] for c in range(classes)])
    draw, width = np.random.default_rng(11), 12 * int(np.ceil(np.log2(classes)))
    best = None
    for _ in range(50):
        code = draw.permuted(np.where(np.arange(classes)[:, None] % 2, 1, -1).repeat(width, 1), axis=0)
        apart = min(int((code[i] != code[:i]).sum(1).min()) for i in range(1, classes))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def frequencies(text: str | None) -> np.ndarray:
    """Square roots of relative n-gram frequencies of the whole text (unit length)."""
    counts = np.zeros(1 << BITS, np.float32)
    for slots in ngram_slots(text or "", ORDERS, BITS):
        counts += np.bincount(slots, minlength=len(counts))
    return np.sqrt(counts / max(1.0, float(counts.sum())))


class OutputCodes:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    @classmethod
    def fit(cls, rows: list[np.ndarray], values: list[np.ndarray], langs: list[str], penalty: float = 1e-4):
        languages = sorted(set(langs))
        if len(languages) < 2:
            return cls(languages, codewords(len(languages)), np.zeros((1 << BITS, 1), np.float32), np.full(1, 5.0), np.ones(1))
        code, of = codewords(len(languages)), np.array([languages.index(x) for x in langs])
        share = 1.0 / np.bincount(of)[of] / len(languages)  # each language weighs the same
        x, weights, bias, trust = Rows(rows, 1 << BITS, values), [], [], []
        for bit in code.T:
            sign = bit[of].astype(float)

            def loss(v, sign=sign):
                z = sign * (x.dot(v[:-1]) + v[-1])
                g = -sign * sigmoid(-z) * share
                down = np.append(x.back(g), g.sum())
                down[:-1] += penalty * v[:-1]
                return float((np.logaddexp(0, -z) * share).sum() + penalty / 2 * v[:-1].dot(v[:-1])), down

            v = minimize(loss, np.zeros((1 << BITS) + 1), 30)
            weights.append(v[:-1])
            bias.append(v[-1])
            wrong = float(((sign * (x.dot(v[:-1]) + v[-1]) <= 0) * share).sum())
            trust.append(np.log((1 - wrong + 0.01) / (wrong + 0.01)))
        trust = np.maximum(np.array(trust), 0.01)
        return cls(languages, code, np.array(weights, np.float32).T.copy(), np.array(bias), trust / trust.sum())

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)"""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        margins = frequencies(text) @ self.weights + self.bias
        losses = np.logaddexp(0, -self.code * margins) @ self.trust
        likely = np.exp(-len(self.trust) * (losses - losses.min()))
        likely /= likely.sum()
        order = np.argsort(-likely, kind="stable")
        lead = likely[order[0]] - (likely[order[1]] if len(order) > 1 else 0.0)
        return self.languages[order[0]], float(likely[order[0]]), bool(lead < AMBIGUOUS)


def fit(docs: DataFrame, usable=None, per_language: int = TRAIN_PER_LANGUAGE) -> OutputCodes:
    """Learn from ``text`` and ``lang``; ``usable`` is a condition on ``doc_id``."""
    known = docs.filter("lang is not null and doc_id is not null")
    known = (known if usable is None else known.filter(usable)).select("doc_id", "lang", "text")
    # the least hash values of each language: the threshold needs only counts, no sort of a language's rows
    most = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r.lang: r.n for r in most.collect()}
    per_language = min(per_language, TRAIN_ROWS // max(1, len(counts)))
    room = F.lit(False)
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    for lang, n in counts.items():
        room = room | ((F.col("lang") == lang) & (rank < int((1 << 30) * min(1.0, per_language / n))))

    def make():
        def one(doc_id, lang, text):
            x = frequencies(text)
            at = np.flatnonzero(x).astype(np.int32)
            return doc_id, lang, at.tobytes(), x[at].tobytes()

        return one

    # an id counts once in a language (the least text), so repeated rows do not add to what is collected
    sample = known.filter(room).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = map_rows(sample, make, "doc_id bigint, lang string, slots binary, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.lang))
    return OutputCodes.fit(
        [np.frombuffer(r.slots, np.int32) for r in got], [np.frombuffer(r.x, np.float32) for r in got], [r.lang for r in got]
    )


def predict(docs: DataFrame, model: OutputCodes) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous for every row, over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats a bit of the code
    make = lambda: lambda doc_id, text: (doc_id, *shared.value(text))
    return map_rows(
        docs.select(F.col("doc_id").cast("bigint"), "text"), make, "doc_id bigint, lang_pred string, score double, ambiguous boolean"
    )


def op6(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, lang_pred, score (and the ambiguity flag)."""
    model = fit(docs, ~held_out("doc_id", 4, 2))
    return predict(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")
