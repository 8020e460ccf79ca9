"""Benchmark items in documents shorter than the item, against brute force."""

import random

from loomwright.llm import decontaminate
from loomwright.llm._words import shingles, word_hashes


def test_documents_shorter_than_the_item(spark):
    rnd = random.Random(3)
    bench = [" ".join(rnd.choices([f"w{k}" for k in range(900)], k=n)) for n in (5, 12, 30, 59, 60, 200)]
    texts = [" ".join(x[a : len(x) - b]) for x in map(str.split, bench) for a in (0, 1, 3) for b in (0, 1, 4, 20)]
    index = decontaminate.Index(list(enumerate(bench)))
    items = {i["id"]: i for length in index.lengths.values() for i in length.items}
    expected, short = set(), 0
    for k, text in enumerate(texts):
        words = word_hashes(text)
        for item_id, item in items.items():
            n = min(len(words), len(item["words"]))
            windows = (shingles(words[a : a + n], decontaminate.SIZE) for a in range(len(words) - n + 1))
            if n >= decontaminate.SIZE and any(index.similarity(w, item) >= 0.8 for w in windows):
                expected.add((k, item_id))
                short += n < len(item["words"])
    assert short > 15
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    table = spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string")
    got = decontaminate.matches(docs, table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected
    assert all(r.n_words == min(len(texts[r.doc_id].split()), len(bench[r.item_id].split())) for r in got)
    assert {r.doc_id for r in decontaminate.clean(docs, table).collect()} == set(range(len(texts))) - {d for d, _ in expected}
