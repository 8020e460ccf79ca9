"""URL filter, mixing and SpotSigs: DataFrame functions only, against SQL and brute force."""

import hashlib
import random

import pytest
import regex
import xxhash

from loomwright.llm import mixing, queries, spotsigs, urlfilter

SF = "/root/testdata/sf0.001"
NATIVE = ("op3_spotsigs", "op5_url_filter", "op7_mixing")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, rows_of, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == duck(queries.ORACLES[name], SF)


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_the_plan(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Arrow", "Pandas") if w in plan]


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://a.COM/en/x?y", "http://example.com/en/70", "https://www.example.com/en/8", "x://com/en/", "http://acom/en/",
        "http://a.net/de/8", "http://b.example.net/de/8#z", "http://example.net?/de/8", "http://org/es", "http://a://b.org/es/", "http://É.org/es/", "http://a.COM/en/x?y",
    ]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id bigint, url string, rule string")
    got = {r.page_id: r for r in urlfilter.op5(pages).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        m = regex.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (regex.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r in urlfilter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, best and best[0] + best[1], best[2] if best else "allow"), u
    assert urlfilter.op5(pages.limit(0)).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urlfilter.judge(pages, none, "block").collect()} == {"block"}


def test_period_is_fair():
    rnd = random.Random(3)
    for _ in range(60):
        weights = {f"s{k}": rnd.randint(1, 12) for k in range(rnd.randint(1, 9))}
        total, slots = sum(weights.values()), mixing.period(weights)
        assert sorted(x for s in slots.values() for x in s) == list(range(total))
        for s, n in weights.items():
            for j, slot in enumerate(slots[s]):
                assert j * total // n <= slot < -(-(j + 1) * total // n)
            for t in range(total + 1):  # less than one block from the share
                assert abs(sum(x < t for x in slots[s]) * total - t * n) < total
    with pytest.raises(ValueError):
        mixing.period({"a": 0})


def test_mixing(spark, odd, none):
    rows = [(k, "hot" if k % 3 else "src0" if k % 2 else None) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string").withColumnRenamed("source", "source")
    got = mixing.mix(docs.selectExpr("*", "1 slot", "2 block"), block_rows=10).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    assert len({(r.slot, r.place) for r in got}) == 900
    first = [r for r in got if r.in_target]
    width = max(r.slot for r in first) + 1
    assert len({r.slot for r in first}) == width and all(sum(r.slot == s for r in first) in range(1, 11) for s in range(width))
    for s, n in (("hot", 1), ("src0", 4), ("", 1)):
        for t in (1, 5, width // 2, width):
            done = len({r.slot for r in first if (r.source or "") == s and r.slot < t})
            assert abs(done - t * n / 6) < 1
    assert mixing.op7(odd).count() == odd.count() and mixing.op7(none).count() == 0


def signatures(text):
    words, out = regex.findall(r"[\p{L}\p{N}]+", text.lower()), []
    anchors, common = set(spotsigs.ANCHORS), {*spotsigs.ANCHORS, *spotsigs.COMMON}
    for k, w in enumerate(words):
        chain = [x for x in words[k + 1 :] if x not in common][: spotsigs.CHAIN]
        if w in anchors and len(chain) == spotsigs.CHAIN:
            out.append(" ".join([w, *chain]))
    out = out or [f"{a} {b}" for a, b in zip(words, words[1:])] or [" ".join(words)]
    return {xxhash.xxh64_hexdigest(x.encode(), 42) for x in out}


def test_spotsigs_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    got = {r.doc_id: r for r in queries.QUERIES["op3_spotsigs"](spark, SF).collect()}
    for k, i in enumerate(ids):
        text, after = docs[i], docs[ids[(k + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        a, b, c = map(signatures, (text, edited, after))
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert set(got[i].fingerprint.split()) == a and set(got[i].edited_fingerprint.split()) == b
        assert (got[i].near_edited, got[i].near_next) == (len(a & b) / len(a | b), len(a & c) / len(a | c))


def test_spotsigs_odd_rows(spark, odd, none):
    got = spotsigs.op3(odd).collect()
    assert len(got) == odd.count() and len({r.fingerprint for r in got if r.doc_id in (1, 5)}) == 1
    assert spotsigs.op3(none).count() == 0
    one = spotsigs.op3(odd.filter("doc_id = 1")).first()
    assert one.near_next == 1.0  # its own next


def test_spotsigs_pairs(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(25):
        base = [x for _ in range(40) for x in ("the", rnd.choice(words), rnd.choice(words))]
        for _ in range(3):
            own = list(base)
            own[rnd.randrange(len(own))] = "zz"
            texts.append(" ".join(own))
    texts += texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    members, pairs = spotsigs.near_pairs(docs)
    of = {r.doc_id: r["class"] for r in members.collect()}
    assert len(of) == len(texts) and all(of[len(texts) - 5 + k] == of[k] for k in range(5))
    sets = {c: signatures(texts[c]) for c in set(of.values())}
    expected = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == expected and expected
