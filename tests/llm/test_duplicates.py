"""SimHash classes, suffix arrays, decontamination, WARC: against brute force and round trips."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import decontaminate, nearcopies, queries, simhash, suffixarray, warc
from loomwright.llm._anchors import anchors
from loomwright.llm._words import shingles, word_hashes, word_hashes_of

SF = "/root/testdata/sf0.001"


def plain_print(text):
    low = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    own = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, radius=2):
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in prints}


def test_simhash_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {k: plain_print(t) for k, t in docs.items()}
    got = {r.doc_id: r for r in queries.QUERIES["op9_simhash"](spark, SF).collect()}
    assert {k: got[k].fingerprint for k in got} == {k: f"{p:016x}" for k, p in prints.items()}
    assert {k: got[k].component_id for k in got} == plain_classes(prints)


def test_simhash_pieces(monkeypatch):
    text = "Ä b C d É\x0bf g\x00h i j k l m n o p q\u00a0r s"
    monkeypatch.setattr(simhash, "PIECE", 4)
    assert simhash.fingerprint(text) == plain_print(text)
    assert simhash.fingerprint("a b") == plain_print("a b") and simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("n", [2, 40, 300])
def test_stars(n):
    rnd = random.Random(n)
    codes = sorted({rnd.randrange(1 << 16) << 20 for _ in range(n)})
    root = simhash.stars(np.array(codes, np.uint64))
    expected = plain_classes(dict(enumerate(codes)))
    assert [expected[k] for k in range(len(codes))] == root.tolist()


def test_simhash_odd_rows(odd, none):
    got = simhash.op9(odd.withColumnRenamed("lang", "fp")).collect()
    assert len(got) == odd.count()
    of = {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id}
    assert of[1][1] == of[5][1] == 1 and of[2] == of[3] == ("0" * 16, 2)
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 4, 6]
    assert simhash.op9(none).count() == 0 and simhash.keep_first(none).count() == 0


def plain_near(texts):
    """Classes by comparing every pair: 5-word shingles, kept as text, with a Jaccard coefficient of 0.8 or more."""
    sets = {}
    for k, t in texts.items():
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 0.8 * len(sets[a]) <= len(sets[b]) <= len(sets[a]) / 0.8 and find(a) != find(b):
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in sets}


def test_near_copies_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.component_id for r in nearcopies.classes(docs).collect()}
    assert got == plain_near({r.doc_id: r.text for r in docs.collect()})


def test_near_copies_are_found_and_others_left(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(4000)]
    rows, of = [], {}
    for base in range(60):
        text = rnd.choices(words, k=rnd.randint(60, 400))
        for copy in range(3):
            own = list(text)
            for _ in range(copy * len(own) // 100):  # 1 or 2 words in a hundred: similarity over 0.8
                own[rnd.randrange(len(own))] = rnd.choice(words)
            of[len(rows)] = base * 3
            rows.append((len(rows), " ".join(own)))
    got = {r.doc_id: r.component_id for r in nearcopies.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert np.mean([got[k] == of[k] for k in of]) > 0.95
    assert all(of[got[k]] == of[k] for k in of)


def test_near_copies_odd_rows(odd, none):
    kept = nearcopies.keep_first(odd.withColumnRenamed("lang", "id"))
    assert kept.columns == ["doc_id", "text", "id", "source", "n_chars"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 4]
    assert nearcopies.classes(none).count() == 0 and nearcopies.keep_first(none).count() == 0


def test_near_groups_are_stars():
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 63, (6, 3), np.uint64)
    prints = np.concatenate([base ^ (np.uint64(1) << draw.integers(0, 60, (6, 3)).astype(np.uint64)) for _ in range(9)])
    assert nearcopies.stars(prints).tolist() == [k % 6 for k in range(54)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_order(symbols):
    assert suffixarray.suffix_order(symbols) == sorted(range(len(symbols)), key=lambda k: symbols[k:])


def test_anchors_follow_content():
    draw = np.random.default_rng(1)
    for raw in (draw.integers(0, 255, 90_000, np.uint8), np.tile(draw.integers(0, 255, 7, np.uint8), 900)):
        found = [np.concatenate(x) for x in zip(*anchors(raw, 400, 32))]
        shifted = [np.concatenate(x) for x in zip(*anchors(raw[1001:], 400, 32))]
        inner = {(p - 1001, h) for p, h in zip(found[0].tolist(), found[1].tolist()) if p > 1001 + 400}
        assert inner <= set(zip(shifted[0].tolist(), shifted[1].tolist()))
        assert (np.diff(found[0]) <= 369).all() and found[0][0] <= 368
    assert not list(anchors(np.zeros(399, np.uint8), 400, 32))


def plain_cut(texts, size=400):
    raws = [(t or "").encode() for t in texts]
    times = Counter(r[k : k + size] for r in raws for k in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - size + 1):
            if times[r[k : k + size]] > 1:
                gone[k : k + size] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [suffixarray.GROUP, 3])
def test_cut_brute_force(spark, group):
    rnd = random.Random(group)
    words = ["".join(rnd.choices("abcdeéß", k=rnd.randint(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    shared = [prose(70), prose(200), prose(66)]
    texts = [None, "", "x" * 399, "y" * 400, "z" * 1300, "ab" * 900]
    for k in range(40):
        part = shared[k % 3]
        cut = rnd.randint(0, 60)
        texts.append(prose(rnd.randint(0, 120)) + " " + part[cut : len(part) - rnd.randint(0, 60)] + " " + prose(rnd.randint(0, 90)))
    texts += [texts[8], texts[9] + "!", texts[10][:450] + "?" + texts[10][451:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffixarray.report(docs, group).collect()}
    assert [got[k] for k in range(len(texts))] == plain_cut(texts)
    got = {r.doc_id: tuple(r)[1:] for r in suffixarray.report(docs, group, suffixarray.Shape(280, block=32)).collect()}
    assert [got[k] for k in range(len(texts))] == plain_cut(texts, 280)


def test_cut_odd_rows(odd, none):
    got = suffixarray.op8(odd.withColumnRenamed("lang", "spots")).collect()
    assert len(got) == odd.count()
    assert {(r.n_removed > 0) for r in got if r.doc_id == 4} == {True}
    cut = suffixarray.cut(odd.withColumnRenamed("lang", "spots"))
    assert cut.columns == ["doc_id", "text", "spots", "source", "n_chars"] and cut.count() == odd.count()
    assert [r.text for r in cut.filter("doc_id = 3").collect()] == [None]
    assert suffixarray.op8(none).count() == 0 and suffixarray.cut(none).count() == 0


def test_word_hashes(monkeypatch):
    from loomwright.llm import _words

    texts = ["The cat, the CAT; été", None, "", "  ", "a" * 50]
    own = [word_hashes(t) for t in texts]
    assert [len(x) for x in own] == [5, 0, 0, 0, 1] and own[0][0] == own[0][2] and own[0][1] == own[0][3]
    words, begins = word_hashes_of(texts)
    assert begins.tolist() == [0, 5, 5, 5, 5, 6] and (words == np.concatenate(own)).all()
    monkeypatch.setattr(_words, "PIECE", 9)
    assert (word_hashes(texts[0]) == own[0]).all()


def test_leaks(spark):
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    bench = [" ".join(rnd.choices(words, k=rnd.randint(5, 60))) for _ in range(60)] + ["only four words here", None]
    texts, expected = [None, "", "w1"], set()
    for k in range(58):
        own = bench[k].split()
        texts.append(" ".join([*rnd.choices(words, k=30), *own, *rnd.choices(words, k=30)]))
        expected.add((len(texts) - 1, k))
        if len(own) >= 55:  # one word changed leaves nine tenths of the shingles
            own[rnd.randrange(len(own))] = "changed"
            texts.append(" ".join([*rnd.choices(words, k=5), *own]).upper())
            expected.add((len(texts) - 1, k))
        half = bench[k].split()
        texts.append(" ".join([*rnd.choices(words, k=20), *half[: len(half) // 2], *rnd.choices(words, k=20)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(k, t) for k, t in enumerate(bench)], "item_id bigint, text string")
    for block in (20_000, 17):
        got = decontaminate.matches(docs, items, block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == expected and all(r.similarity >= 0.8 for r in got)
        assert {r.doc_id for r in decontaminate.clean(docs, items, block).collect()} == set(range(len(texts))) - {d for d, _ in expected}


def test_windows_brute_force(spark):
    """Every pair at the threshold in the small tables, by comparing all windows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    index = decontaminate.Index([(r.item_id, r.text) for r in items])
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_decontaminate"](spark, SF).collect()}
    expected = set()
    for d in docs:
        words = word_hashes(d.text)
        own = shingles(words, decontaminate.SIZE)
        known = np.isin(own, index.known)
        for n, length in index.lengths.items():
            for start in range(len(words) - n + 1):
                if known[start : start + n - 4].any():
                    for item in length.items:
                        if index.similarity(own[start : start + n - 4], item) >= 0.8:
                            expected.add((d.doc_id, item["id"]))
    assert got == expected and expected


def test_leaks_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "the cat is on a mat with the dog"), (None, "x y z a b c"), (2, None), (3, "")], "item_id bigint, text string")
    assert {r.doc_id for r in decontaminate.op4(odd, items).collect()} == {1, 5}
    kept = decontaminate.clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontaminate.op4(none, items).count() == 0 and decontaminate.op4(odd, items.limit(0)).count() == 0


PAGES = "page_id bigint, url string, html string, value string"


def odd_pages(spark):
    big = "<p>é\r\n\r\n WARC/1.1</p>" * 90
    rows = [(1, "http://a.com/x", big), (7, "http://b.com/x\r\ny", big), (5, None, big), (2, "http://a.com/x", "small"), (3, "http://a.com/x", "small"),
            (4, "http://A.com/Y?q#f", None), (None, "http://c.com", big), (None, None, None), (6, "", ""), (7, "http://b.com/x\r\ny", big)]
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES), big


def test_warc_roles(spark):
    pages, big = odd_pages(spark)
    got = sorted(warc.op2(pages).collect(), key=lambda r: (r.page_id or 0, r.payload_bytes))
    size, digest = len(big.encode()), hashlib.sha1(big.encode()).hexdigest()
    assert [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got] == [
        (None, "response", None, 0), (None, "revisit", 7, size), (1, "revisit", 7, size), (2, "response", None, 5), (3, "response", None, 5),
        (4, "response", None, 0), (5, "revisit", 7, size), (6, "response", None, 0), (7, "response", None, size), (7, "response", None, size),
    ]
    assert all(r.payload_digest == digest for r in got if r.payload_bytes == size)
    assert warc.op2(pages.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages, big = odd_pages(spark)
    path = f"file://{tmp_path}/w"
    warc.write(pages, path)
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    records = [r for f in files for r in warc.parse(f.read_bytes())]
    assert len(records) == pages.count()
    assert sorted(r["payload"].decode() for r in records if r["fields"]["warc-type"] == "response") == sorted([big, big, "small", "small", "", "", ""])
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files[:1])
    first = next(warc.parse(files[0].read_bytes()))
    assert whole[first["offset"] :].startswith(b"WARC/1.1")
    index = warc.history(spark, path, pages.count()).collect()
    keys = [(r.urlkey.encode(), r.timestamp, r.page_id is not None, r.page_id or 0) for r in index]
    assert keys == sorted(keys) and {r.urlkey for r in index} >= {"com,a)/x", "-", "com,a)/y?q"}
    warc.write_index(warc.history(spark, path, 10), f"file://{tmp_path}/i")
    assert spark.read.text(f"file://{tmp_path}/i").count() == len(index)


def test_damaged_archives_are_refused(spark, tmp_path):
    body = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 500\r\n\r\nshort"
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(body)))
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"nonsense\r\n\r\n")))
    assert base64 and list(warc.parse(gzip.compress(b""))) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=8), max_size=9))
def test_loser_tree(runs):
    runs = [sorted((x,) for x in r) for r in runs]
    assert list(warc.loser_tree(runs, lambda r: r)) == sorted(x for r in runs for x in r)
