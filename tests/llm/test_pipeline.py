"""The pipeline's stages against plain versions of what they do."""

import corpus_pipeline
from test_duplicates import plain_near

from loomwright.llm import decontaminate, mixing, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    names = docs.columns
    model = quality.fit(docs, labels)
    kept = {r.doc_id: r for r in docs.collect() if model(r.text) >= quality.CUT_SCORE}
    of = plain_near({k: r.text for k, r in kept.items()})
    kept = {k: r.text for k, r in kept.items() if of[k] == k}
    # cut every byte of a passage-sized string that starts twice
    size = corpus_pipeline.PASSAGE_BYTES
    raws = {k: t.encode() for k, t in kept.items()}
    seen = {}
    for k, r in raws.items():
        for a in range(len(r) - size + 1):
            seen.setdefault(r[a : a + size], []).append((k, a))
    gone = {k: bytearray(len(r)) for k, r in raws.items()}
    for places in seen.values():
        for k, a in places if len(places) > 1 else ():
            gone[k][a : a + size] = b"\1" * size
    texts = {k: bytes(b for b, g in zip(r, gone[k]) if not g).decode("utf-8", "ignore") for k, r in raws.items()}
    index = decontaminate.Index([(r.item_id, r.text) for r in bench.collect()])
    texts = {k: t for k, t in texts.items() if not index.matches(t)}

    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*names, "block", "slot", "place", "in_target"]
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == texts and len(rows) == len(texts)
    assert len({(r.slot, r.place) for r in rows}) == len(rows)
    assert all(r.n_chars == len(r.text) for r in rows if gone[r.doc_id].count(1))
    assert mixing.BLOCK_ROWS > max(r.place for r in rows)


def test_stages_keep_columns_and_take_odd_rows(spark, odd, none):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert out.count() <= docs.count()
        assert stage(spark, docs, SF).count() == docs.count()
