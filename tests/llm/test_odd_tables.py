"""Names that operators use themselves, very long values, short items, many unnamed sources, recall of changed passages."""

import heapq
import random
import time

import corpus_pipeline
import pytest

from loomwright.llm import decontaminate, mixing, nearcopies, quality, spotsigs, urlfilter, warc

SF = "/root/testdata/sf0.001"
NAMES = "_quality _s _key _part _rank _at _block _n _slots _ahead _id _gone _node _rid _spots row id node gone_id gone_node key s part own to rank at text_ value".split()


@pytest.fixture(scope="module")
def clashing(spark):
    texts = ["The cat is on the mat with the dog and the bird, for the day is long.", "", None, "Another text that is unlike the first one.", "été " * 30000]
    rows = [(k, texts[k % 5], "en", f"src{k % 3}", 1, *[f"{n}{k}" for n in NAMES]) for k in range(10)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in NAMES))


def kept_as_they_were(df):
    for r in df.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES)


def test_clashing_names(spark, clashing, no_labels):
    items = spark.createDataFrame([(1, "another text that is unlike")], "item_id bigint, text string")
    for out in (quality.keep_good(clashing, no_labels), mixing.mix(clashing), nearcopies.keep_first(clashing), decontaminate.clean(clashing, items), decontaminate.clean(clashing.unionByName(clashing), items, 1)):
        assert out.columns[: len(clashing.columns)] == clashing.columns
        kept_as_they_were(out)
    kept_as_they_were(nearcopies.keep_first(clashing.unionByName(clashing)))
    for _, stage in corpus_pipeline.STAGES:
        kept_as_they_were(stage(spark, clashing, SF))


def test_very_long_values(spark):
    pages = spark.createDataFrame([(1, "http://example.com/en/7" + "x" * 200_000, "<p>" + "y" * 3_000_000), (2, "http://a.net/de/" + "/".join("z" * 50_000), None)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in urlfilter.op5(pages).collect()}
    assert (got[1].rule, got[1].verdict, got[2].rule) == ("example.com/en/7", "allow", "net/de/")
    assert {r.page_id: r.payload_bytes for r in warc.op2(pages).collect()} == {1: 3_000_003, 2: 0}
    began = time.time()
    docs = spark.createDataFrame([(1, "the " * 20_000), (2, "the " * 20_000 + "cat sat"), (3, ("the of " * 9 + "cat ") * 2000)], "doc_id bigint, text string")
    prints = {r.doc_id: r.n for r in docs.select("doc_id", spotsigs.signatures(docs.text).alias("s")).selectExpr("doc_id", "size(s) n").collect()}
    assert prints == {1: 1, 2: 1, 3: 1} and time.time() - began < 10


def test_short_items_match_as_a_whole(spark):
    docs = spark.createDataFrame([(1, "What is, the CAPITAL of France?"), (2, "the capital"), (3, "capital the of France"), (4, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "the capital"), (2, "of france"), (3, ""), (4, "is the capital of")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(1, 1): (1.0, 2, 2), (1, 2): (1.0, 4, 2), (1, 4): (1.0, 1, 4), (2, 1): (1.0, 0, 2), (3, 2): (1.0, 2, 2)}
    assert got == {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in decontaminate.matches(docs, items, 2).collect()}


def plain_similarity(a, b, weigh):
    """Weighted Dice coefficient of 5-word shingles as lists of words."""
    a, b = ([tuple(x[k : k + 5]) for k in range(len(x) - 4)] for x in (a, b))
    both, left = 0.0, list(b)
    for s in a:
        if s in left:
            left.remove(s)
            both += weigh(s)
    return 2 * both / (sum(map(weigh, a)) + sum(map(weigh, b)))


def test_recall_of_changed_passages(spark):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(2000)]
    bench = [rnd.choices(words, k=rnd.choice((15, 25, 40, 59))) for _ in range(150)]
    holders = {}
    for item in bench:
        for s in {tuple(item[k : k + 5]) for k in range(len(item) - 4)}:
            holders[s] = holders.get(s, 0) + 1
    import math

    weigh = lambda s: math.log1p(len(bench) / holders[s]) if s in holders else math.log1p(len(bench))
    texts, expected, below = [], set(), set()
    for k, item in enumerate(bench):
        for kind in range(4):
            own, n = list(item), len(item)
            if kind < 2:  # words changed here and there
                for at in rnd.sample(range(n), kind + 1):
                    own[at] = "changed"
            else:  # a stretch replaced at an end
                size = max(1, round(n * 0.12 * (kind - 1)))
                own[n - size :] = rnd.choices(words, k=size)
            sim = plain_similarity(own, item, weigh)
            if abs(sim - 0.8) > 1e-9:
                (expected if sim > 0.8 else below).add((len(texts), k))
                texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(bench)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()}
    assert len(got & expected) >= 0.97 * len(expected) and not got & below and len(expected) > 150


def flat(weights):
    """Earliest deadline first over all sources, slot by slot."""
    total, slots = sum(weights.values()), {s: [] for s in weights}
    waiting, ready = [(0, s, 0) for s in sorted(weights)], []
    for slot in range(total):
        for x in [x for x in waiting if x[0] <= slot]:
            waiting.remove(x)
            heapq.heappush(ready, (-(-(x[2] + 1) * total // weights[x[1]]), x[1], x[2]))
        _, s, j = heapq.heappop(ready)
        slots[s].append(slot)
        if j + 1 < weights[s]:
            waiting.append(((j + 1) * total // weights[s], s, j + 1))
    return slots


def test_runs_of_unnamed_sources():
    rnd = random.Random(6)
    for _ in range(150):
        named = {f"{rnd.choice('abcxyz')}{k}": rnd.randint(1, 9) for k in range(rnd.randint(0, 4))}
        unnamed, other = sorted(f"m{k}" if rnd.random() < 0.5 else f"{rnd.choice('abcxyz')}u{k}" for k in range(rnd.randint(1, 8))), rnd.randint(1, 4)
        before = {s: sum(u < s for u in unnamed) for s in named}
        slots, rounds, total = mixing.schedule(named, other, len(unnamed), before)
        for rank, s in enumerate(unnamed):
            slots[s] = [next(b + rank - a for a, b in reversed(runs) if a <= rank) for runs in rounds]
        assert slots == flat(named | dict.fromkeys(unnamed, other)) and total == sum(named.values()) + other * len(unnamed)
    assert len(mixing.schedule({"src0": 4}, 1, 50_000_000)[1][0]) < 10  # as many sources, a few runs


def test_many_unnamed_sources(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "if(id % 3 = 0, 'src0', concat('u', id % 1500)) source")
    got = mixing.mix(docs, block_rows=2).collect()
    names = {r.source for r in got}
    weights = {s: mixing.WEIGHTS.get(s, 1) for s in names}
    slots, total = flat(weights), sum(weights.values())
    assert len(got) == 6000 and all(r.slot == r.block // weights[r.source] * total + slots[r.source][r.block % weights[r.source]] for r in got)


def test_near_classes_of_spots(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(600)]
    texts = []
    for _ in range(12):
        base = [x for _ in range(40) for x in ("the", rnd.choice(words), rnd.choice(words))]
        for k in range(12):
            own = list(base)
            for at in rnd.sample(range(len(own)), k % 3):
                own[at] = rnd.choice(words)
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    signed = docs.select("doc_id", spotsigs.signatures(docs.text).alias("signs")).selectExpr("*", "xxhash64(signs) k")
    got = {r.doc_id: r.near_class for r in signed.join(spotsigs.near_classes(signed.drop("k")), "k").collect()}
    members, pairs = spotsigs.near_pairs(docs)
    of = {r.doc_id: r["class"] for r in members.collect()}
    root = {c: c for c in of.values()}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for r in pairs.collect():
        root[max(find(r.a), find(r.b))] = min(find(r.a), find(r.b))
    assert got == {k: find(c) for k, c in of.items()}
