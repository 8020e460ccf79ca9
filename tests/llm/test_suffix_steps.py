"""op8's costly steps: the order of hot contexts, strings that meet by hash, and joins that look up."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomwright.functions.storage import stored
from loomwright.llm import suffixarray

SHAPE = suffixarray.PASSAGES


def contexts(spark, n=60):
    draw = random.Random(3)
    rows = []
    for k in range(n):
        left = draw.choice([0, 5, 40])
        rows.append((k % 2, k, k % 3 % 2, left, bytearray(draw.choices(b"ab", k=left) + [*b"ab" * draw.randint(0, 3)])))
    return spark.createDataFrame(rows, suffixarray._CONTEXT_SQL)


def test_hot_contexts_are_sorted_by_columns(spark):
    """An expression in a sort's order is made anew for each comparison."""
    made = contexts(spark)
    ordered = suffixarray._in_order(made)
    sorts = re.findall(r"Sort \[([^\n]*)\], false", ordered._jdf.queryExecution().executedPlan().toString())
    assert sorts and not any("(" in x for x in sorts)
    got, want = ordered.collect(), made.collect()
    key = lambda r: (r.h, bytes(r.context[r.left :]), bytes(r.context[: r.left]).hex().upper()[::-1])
    assert ordered.columns == made.columns
    assert [key(r) for r in got] == sorted(map(key, want))
    assert sorted(r.cx for r in got) == sorted(r.cx for r in want)


def test_strings_that_meet_by_hash():
    """Many contexts of one group: the strings found are those of plain comparison."""
    draw = random.Random(5)
    texts = [bytes(draw.choices(b"abcd", k=700)) for _ in range(4)]
    held = [t[:k] + bytes([65 + k % 9]) + t[k + 1 :] for k in (30, 200, 500, 660) for t in texts] + texts
    left = np.full(len(held), SHAPE.left)
    raw, sizes = suffixarray.laid(held, left, SHAPE), np.array([len(t) for t in held])
    row = np.repeat(np.arange(len(held)), 300)
    before = np.tile(np.arange(68, 368), len(held))
    after = SHAPE.length - before
    fits = after <= (sizes - left)[row]
    row, before, after = row[fits], before[fits], after[fits]
    found = suffixarray.found_twice(raw, np.ones(len(held), np.uint64), left, sizes - left, row, before, after, SHAPE)
    of = [(held[r][SHAPE.left - b : SHAPE.left + a], b) for r, b, a in zip(row, before, after)]
    want = {(r, b) for (s, b), r in zip(of, row) if of.count((s, b)) > 1}
    assert want and {(r, b) for r, b in zip(*found[:2])} == want


def test_joins_look_up(spark):
    """No sort where the shuffled sides are small; the session's settings stay."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    kept = {k: spark.conf.get(k, None) for k in (name, "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
        b = a.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        assert stored(a.join(b, "k"), "looked-up", lookup=True).count() == 1000
        assert stored(a.join(b, "k", "left"), "looked-up", lookup=True).count() == 1000
        assert spark.conf.get(name, None) == kept[name]
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
