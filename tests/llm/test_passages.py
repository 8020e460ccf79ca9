"""Suffix-array deduplication against brute force: whole tables, word passages, hot anchors, clashing names."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from test_duplicates import plain_cut

from loomwright.llm import _anchors, queries, suffixarray
from loomwright.llm._anchors import word_anchors


def words_shared(texts, words=50):
    """Of each text, the words that lie in a run of ``words`` or more whole words that another place has as well."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+\s*", (t or "").encode()) for t in texts]
    times = Counter(b"".join(s[k : k + words]).rstrip() for s in split for k in range(len(s) - words + 1))
    return [{i for k in range(len(s) - words + 1) if times[b"".join(s[k : k + words]).rstrip()] > 1 for i in range(k, k + words)} for s in split]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_brute_force(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    expected = dict(zip([r.doc_id for r in rows], plain_cut([r.text for r in rows])))
    got = queries.QUERIES["op8_suffix_array"](spark, f"/root/testdata/{sf}").collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == expected and len(got) == len(rows)
    assert all(r.passage_bytes >= r.n_removed for r in got)


def made_up(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeéß", k=rnd.randint(1, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    shared = [prose(n) for n in (49, 50, 51, 60, 75, 120)]
    texts = [None, "", " ".join("a" * 50), " ".join("a" * 49) + " b", "x\n\ty" * 30]
    for k in range(36):
        texts.append(prose(rnd.randint(0, 60)) + " " + shared[k % 6] + "\n" + prose(rnd.randint(0, 60)))
    return texts


@pytest.mark.parametrize(("seed", "group"), [(1, suffixarray.GROUP), (2, 5), (3, 2)])
def test_passages_brute_force(spark, seed, group):
    texts = made_up(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in suffixarray.report(docs, group, suffixarray.PASSAGES).collect()}
    shared = words_shared(texts)
    for k, words in enumerate(shared):  # what is marked is shared, and what is shared is marked
        if not words and not got[k].n_removed:
            assert got[k].passage_bytes == got[k].n_passages == 0
        else:
            size = sum(len(w) for i, w in enumerate(re.findall(rb"[^\x20\x09-\x0D]+", texts[k].encode())) if i in words) + max(0, len(words) - 1)
            assert got[k].passage_bytes >= 0.95 * size and got[k].n_passages > 0
    assert [tuple(got[k])[1:5] for k in range(len(texts))] == plain_cut(texts)


def test_equal_hashes_do_not_decide(monkeypatch):
    """With a hash that is the same for all strings the bytes alone decide."""
    rnd = random.Random(4)
    texts = [bytes(rnd.choices(b"abc", k=768)) for _ in range(6)]
    texts[1] = texts[0][:500] + texts[1][500:]
    texts[3] = texts[2]
    texts[4], texts[5] = texts[0][:300] + texts[4][300:], texts[0][:300] + texts[5][300:600] + texts[4][600:]
    left, group = np.full(6, 368), np.zeros(6, np.uint64)
    plain = suffixarray.repeated(group, left, texts)
    monkeypatch.setattr(suffixarray, "hashes_of", lambda sums, row, *rest: np.zeros(len(row), np.uint64))
    odd = suffixarray.repeated(group, left, texts)
    assert all((a == b).all() for a, b in zip(plain, odd)) and set(plain[0].tolist()) == {0, 1, 2, 3}


def test_word_anchors_follow_content(monkeypatch):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdeß", k=rnd.randint(1, 9))) for _ in range(400)] + ["x" * 90, " " * 80]
    base = " ".join(rnd.choices(words, k=4000)).encode()
    raws = [np.frombuffer(t, np.uint8) for t in (b"", base, b"zz " + base[1001:], base[5000:5350])]
    found = {}
    for pack in (1 << 15, 4000):
        monkeypatch.setattr(_anchors, "PACK", pack)
        rows = [r for x in word_anchors(raws, 400, 32, 50) for r in zip(*(c.tolist() for c in x))]
        assert len({r[:2] for r in rows}) == len(rows)
        found[pack] = sorted(rows)
    assert len(set(map(str, found.values()))) == 1
    at = [np.array([r[1] for r in found[4000] if r[0] == k]) for k in range(4)]
    for k in (1, 2):
        begins = np.arange(len(raws[k]) - 399)
        assert (at[k][np.searchsorted(at[k], begins)] + 32 <= begins + 400).all()
    inner = {(p - 998, h) for t, p, h, *_ in found[4000] if t == 1 and p > 1500}
    assert inner <= {(p, h) for t, p, h, *_ in found[4000] if t == 2}


def test_clashing_names(spark):
    text = "the cat is on the mat " * 40
    names = ["doc_id", "text", "_rid", "_spots", "spots", "row", "lost", "new", "h", "cx"]
    docs = spark.createDataFrame([(k, text + str(k), *[f"{n}{k}" for n in names[2:]]) for k in range(3)], "doc_id bigint, " + ", ".join(f"`{n}` string" for n in names[1:]))
    out = suffixarray.cut(docs)
    assert out.columns == names
    rows = sorted(out.collect())
    assert all(r[2:] == tuple(f"{n}{k}" for n in names[2:]) and len(r.text) < 30 for k, r in enumerate(rows))
    assert suffixarray.report(docs).count() == 3
