"""Similarities do not depend on how the benchmark's items are dealt into blocks."""

import random

from loomwright.llm import decontaminate


def test_weights_are_of_the_whole_benchmark(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    common = rnd.choices(words, k=12)
    bench = [" ".join([*common, *rnd.choices(words, k=40)]) if k % 3 else " ".join(rnd.choices(words, k=40)) for k in range(40)] + ["too short"]
    texts = []
    for k in range(40):
        own = bench[k].split()
        for at in rnd.sample(range(15, len(own)), k % 3):
            own[at] = "changed"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string")
    one, many = ({(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.matches(docs, items, n).collect()} for n in (20_000, 6))
    assert one == many and any(x < 1 for x in one.values())
    kept = {r.doc_id for r in decontaminate.clean(docs, items, 6).collect()}
    assert kept == set(range(40)) - {d for d, _ in one}
