"""Frequent pairs: right in every way of counting, and no shuffle files of the size of the pairs."""

import random
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from loomwright.operators import pairs, pmi

QUERIES = {
    "pmi_pair_total": pmi.pmi_pair_total,
    "pmi_stripes": pmi.pmi_stripes,
    "pmi_conditional": pmi.conditional,
    "pmi_pair_counts": pmi.pair_counts,
    "pmi_pairs": pmi.pmi_pairs,
    "pmi_top": lambda sets, threshold: pmi.pmi_top(sets, threshold=threshold),
}


def texts(n, width, terms, seed=1):
    """Lines of different terms, the first ones of the list far more often than the last."""
    draw = random.Random(seed)
    return [" ".join({f"t{int(terms * draw.random() ** 3)}" for _ in range(width)}) for _ in range(n)]


def sets_of(spark, lines):
    return pmi.term_sets(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string"))


def plain(lines, threshold):
    found = Counter(p for x in lines for p in combinations(sorted(set(x.split())), 2))
    return {p: n for p, n in found.items() if n >= threshold}


WAYS = {
    "as they are": {},
    "sorted": {"CELLS": 0},
    "several rounds of small ranges": {"CELLS": 0, "MOST_PAIRS": 2000, "LEAST_PAIRS": 2000, "ROUND": 2, "ONE_ROUND": 8000},
    "dense, in chunks": {"CHUNK": 50},
    "one term at a time": {"CELLS": 0, "CHUNK": 10, "BUCKET": 10000},
    "buckets cut again": {"MOST_PAIRS": 2000, "LEAST_PAIRS": 2000, "BUCKET": 5000},
}


@pytest.mark.parametrize("way", WAYS)
def test_every_way_of_counting(spark, monkeypatch, way):
    for name, value in WAYS[way].items():
        monkeypatch.setattr(pairs, name, value)
    lines = [*texts(120, 25, 150), "", "alone", "\u00e9 z \U0001f600 \uffee"]
    for threshold in (1, 3):
        found = pmi.pair_counts(sets_of(spark, lines), threshold).collect()
        assert len(found) == len({(r.x, r.y) for r in found})
        assert {(r.x, r.y): r.c_xy for r in found} == plain(lines, threshold)


def test_no_frequent_term(spark):
    for lines in ([], ["a b"], ["a b", "c d"]):
        assert pmi.pair_counts(sets_of(spark, lines), 2).collect() == []
        assert pmi.pmi_pair_total(sets_of(spark, lines), 2).first().n_pairs == 0


def test_a_term_on_single_lines_only(spark):
    assert pmi.pair_counts(sets_of(spark, ["a", "a", "b", "b"]), 2).collect() == []


def written(spark):
    """Bytes of shuffle files written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


@pytest.mark.parametrize("query", QUERIES)
def test_pairs_are_not_shuffled(spark, query):
    """A million pairs, few of them frequent: files are of the size of the text."""
    lines = [" ".join(random.Random(k).sample([f"t{n}" for n in range(3000)], 100)) for k in range(250)]
    sets, before = sets_of(spark, lines).persist(), written(spark)
    QUERIES[query](sets, 4).write.format("noop").mode("overwrite").save()
    sets.unpersist()
    assert written(spark) - before < 40 * 250 * 100


def test_codes_take_little_besides_their_own():
    """Twice the codes at most, while they are made."""
    ids = np.tile(np.arange(2000, dtype=np.int32), 2)
    at, before = np.arange(1, 4000), np.tile(np.arange(2000), 2)[1:]
    at, before = at[before > 0], before[before > 0]
    tracemalloc.start()
    code = pairs._codes(ids, at, before, 0, 2000)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    a, b = np.nonzero(np.tri(2000, k=-1, dtype=bool))
    assert (code == np.tile(a * 2000 + b, 2)).all()
    assert most < 2 * code.nbytes
