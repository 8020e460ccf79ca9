"""Quality, language and toxicity: held-out accuracy, determinism, odd rows."""

import zlib

import numpy as np
import pytest

from loomwright.llm import language, quality, queries, toxicity
from loomwright.llm._linear import Presence, Rows, minimize, ngram_slots

SF = "/root/testdata/sf0.01"


def truth(spark, column):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def rest(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_quality_held_out(spark):
    marks = truth(spark, "quality")
    got = queries.QUERIES["op1_quality"](spark, SF).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (rest(r.doc_id, 5) == 0) for r in got)
    own = [r.predicted == marks[r.doc_id] for r in got if r.held_out and r.doc_id in marks]
    assert np.mean(own) > 0.95


def test_toxicity_held_out(spark):
    marks = truth(spark, "toxic")
    got = queries.QUERIES["op10_toxicity"](spark, SF).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (rest(r.doc_id, 3) == 1) for r in got)
    own = [r.predicted == marks[r.doc_id] for r in got if r.held_out and r.doc_id in marks]
    assert np.mean(own) > 0.9


def test_language_held_out(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op6_language"](spark, SF).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (rest(r.doc_id, 4) == 2) for r in got)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got if r.held_out]) > 0.93


@pytest.mark.parametrize("some", ["labels", "no_labels"])
@pytest.mark.parametrize("op", [quality.op1, toxicity.op10])
def test_classifiers_take_odd_rows(request, odd, none, some, op):
    marks = request.getfixturevalue(some)
    got = op(odd.withColumnRenamed("lang", "score"), marks).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert op(none, marks).count() == 0


def test_keep_good_keeps_columns_and_rows(odd, none, no_labels):
    kept = quality.keep_good(odd, no_labels)  # nothing learned: nothing rejected
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert quality.keep_good(none, no_labels).count() == 0


def test_language_odd_rows(odd, none):
    got = language.op6(odd).collect()
    assert len(got) == odd.count()
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(2, "und"), (3, "und"), (6, "und"), (4, "fr")} <= by
    assert language.op6(none).count() == 0
    assert {r.lang_pred for r in language.op6(odd.withColumn("lang", odd.lang.substr(1, 0))).collect()} <= {"und", ""}


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 40):
        code = language.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, code.shape[1] // 5) and all(len(set(c)) == 2 for c in code.T)


def test_bradley_terry_orders_and_cuts():
    draw = np.random.default_rng(1)
    y = (draw.random(300) < 0.8).astype(int)
    x = draw.normal(size=(300, 5)) + y[:, None] * np.array([4, 0, 0, 0, 0])
    model = quality.BradleyTerry.fit(x, y)
    s = x @ model.weights + model.offset
    assert ((s >= np.log(0.3 / 0.7)) == (y == 1)).mean() > 0.95


def test_pieces_do_not_change_features(monkeypatch):
    from loomwright.llm import _linear

    text = "Ein längerer Text, mit vielen Wörtern. " * 50
    whole = Presence((3, 4), 12)(text)
    counts = sum(np.bincount(s, minlength=1 << 12) for s in ngram_slots(text, (1, 2, 3), 12))
    monkeypatch.setattr(_linear, "PIECE", 17)
    assert (Presence((3, 4), 12)(text) == whole).all()
    assert (sum(np.bincount(s, minlength=1 << 12) for s in ngram_slots(text, (1, 2, 3), 12)) == counts).all()


def test_products_by_blocks(monkeypatch):
    monkeypatch.setattr(Rows, "BLOCK", 3)
    draw = np.random.default_rng(2)
    dense = (draw.random((9, 7)) < 0.4) * draw.random((9, 7)).astype(np.float32)
    rows = [np.flatnonzero(r).astype(np.int32) for r in dense]
    x = Rows(rows, 7, [r[i] for r, i in zip(dense, rows)])
    w, g = draw.random(7), draw.random(9)
    assert np.allclose(x.dot(w), dense @ w) and np.allclose(x.back(g), dense.T @ g)


def test_minimize():
    a = np.diag([1.0, 10.0, 100.0])
    best = minimize(lambda v: (float(v @ a @ v / 2 - v.sum()), a @ v - 1), np.zeros(3))
    assert np.allclose(best, [1, 0.1, 0.01], atol=1e-4)
