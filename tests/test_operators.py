"""Small fixtures with answers found by hand."""

import gzip
import math

import pytest

from loomwright.functions import codec
from loomwright.operators import counting, graph, pmi, retrieval, temporal
from loomwright.sources import readers
from loomwright.streaming.hourly import hourly_stream


def docs(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")


def pairs(df, *keys):
    return {tuple(r[k] for k in keys[:-1]): r[keys[-1]] for r in df.collect()}


def test_word_count(spark):
    found = pairs(counting.word_count(docs(spark, [" the a  b the\nb a\n", "", None])), "term", "n")
    assert found == {("the",): 2, ("a",): 2, ("b",): 2}
    assert counting.term_count(docs(spark, ["x"]), "y").first().n == 0
    stats = counting.vocabulary_stats(docs(spark, ["b a", "a"])).first()
    assert (stats.n_tokens, stats.n_terms, stats.first_term, stats.last_term) == (3, 2, "a", "b")
    assert counting.vocabulary_stats(docs(spark, [])).first().n_tokens == 0


def test_bigrams_and_cooccurrence(spark):
    assert pairs(counting.bigram_count(docs(spark, ["a b a\nx"])), "bigram", "n") == {("a_b",): 1, ("b_a",): 1}
    assert pairs(counting.cooccurrence_pairs(docs(spark, ["a b a"])), "w", "u", "n") == {("a", "a"): 2, ("a", "b"): 2, ("b", "a"): 2}
    assert pairs(counting.cooccurrence_stripes(docs(spark, ["a b a"])), "w", "stripe") == {("a",): "a:2 b:2", ("b",): "a:2"}
    with pytest.raises(ValueError):
        counting.bigram_count(docs(spark, ["a"]), unit="page")


@pytest.mark.parametrize(
    "texts, expected",
    [
        (["a b", "a c", "b a a", "d"], {("a", "b"): math.log(8 / 6), ("a", "c"): math.log(4 / 3)}),
        (["x-y z"], {("x-y", "z"): 0.0}),
        (["a,b c)d"], {("a,b", "c)d"): 0.0}),
        (["'tis ''but"], {("''but", "'tis"): 0.0}),
        (["* a", "a b"], {("*", "a"): 0.0, ("a", "b"): 0.0}),
        (["a"] * 1000 + ["a b"], {("a", "b"): 0.0}),
    ],
)
def test_pmi(spark, texts, expected):
    found = pairs(pmi.pmi_pairs(pmi.term_sets(docs(spark, texts)), threshold=1), "x", "y", "pmi")
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - v) < 1e-6 for k, v in expected.items())


def test_pmi_threshold_keeps_full_marginals(spark):
    sets = pmi.term_sets(docs(spark, ["a b", "a b", "a c"]))
    assert pairs(pmi.conditional(sets, 2), "x", "y", "p_y_given_x") == {("a", "b"): round(2 / 3, 6)}
    assert pairs(pmi.pmi_pairs(sets, 2, total=10), "x", "y", "pmi") == {("a", "b"): round(math.log(2 * 10 / (3 * 2)), 6)}


def test_index(spark):
    assert pairs(retrieval.postings_text(retrieval.postings(docs(spark, ["a z", "z"]))), "term", "postings") == {("a",): "0:1", ("z",): "0:1 1:1"}
    big = spark.createDataFrame([(3_000_000_000, "q")], "doc_id bigint, text string")
    assert retrieval.gaps(big).first().gap == 3_000_000_000
    assert retrieval.decompressed(retrieval.compressed(big)).first().docid == 3_000_000_000


def test_stretches_and_segments(spark):
    some = docs(spark, ["a b" if k % 3 else "a" for k in range(40)])
    whole = pairs(retrieval.gaps(some), "term", "docid", "gap")
    assert pairs(retrieval.gaps(some, span=7), "term", "docid", "gap") == whole
    assert whole[("a", 5)] == 1 and whole[("b", 4)] == 2
    cut = retrieval.segments(some, span=7).collect()
    assert sorted(p.docid for r in cut if r.term == "a" for p in r.postings) == list(range(40)) and max(r.df for r in cut) == 7


def test_codec():
    posts = [(5, 1), (133, 2), (400, 1)]
    assert codec.encode(posts).hex(" ") == "05 01 8f 80 02 8e 01 0b 01"
    assert codec.decode(codec.encode(posts)) == posts
    for v in (0, 1, 127, 128, 255, 256, 65535, 65536, -1, -112, -113, -129, 2**31, 2**40, -(2**40)):
        assert codec.read_vint(codec.vint(v), 0) == (v, len(codec.vint(v)))


def test_boolean(spark):
    lines = spark.createDataFrame([(0, "a b"), (1, "b c"), (2, "a c")], "docid bigint, line string")
    index = retrieval.term_frequencies(lines, "docid", "line")
    for query, expected in {"a nosuch AND": [], "a nosuch OR": [0, 2], "a b OR c AND": [1, 2], "a": [0, 2]}.items():
        assert sorted(r.docid for r in retrieval.boolean(lines, query).collect()) == expected
        assert sorted(r.docid for r in retrieval.boolean_from_index(index, lines, query).collect()) == expected
    for bad in ("AND", "a b", "", "a AND"):
        with pytest.raises(ValueError):
            retrieval.parse_postfix(bad)


def test_graph(spark):
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "id bigint")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1)], "src bigint, dst bigint")
    got = pairs(graph.pagerank(nodes, edges, 1), "id", "p")
    assert [round(got[(k,)], 6) for k in (1, 2, 3, 4)] == [0.303125, 0.196875, 0.409375, 0.090625]
    assert abs(graph.pagerank(nodes, edges, 1, trace=True).first().missing - 0.25) < 1e-12
    got = pairs(graph.personalized_pagerank(nodes, edges, [1], 1), "id", "p")
    assert [round(got[(k,)], 6) for k in (1, 2, 3, 4)] == [0.15, 0.425, 0.425, 0.0]
    with pytest.raises(ValueError):
        graph.personalized_pagerank(nodes, edges, [9], 1)
    assert pairs(graph.weak_components(nodes, edges), "id", "component") == {(1,): 1, (2,): 1, (3,): 1, (4,): 4}
    settled = graph.pagerank(nodes.filter("id < 4"), spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src bigint, dst bigint"), 50, tolerance=1e-12)
    assert all(abs(r.p - 1 / 3) < 1e-9 for r in settled.collect())


def test_parallel_and_lost_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    got = pairs(graph.pagerank(nodes, spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "src bigint, dst bigint"), 1, alpha=0.0), "id", "p")
    assert abs((got[(2,)] - got[(1,)]) - 2 * (got[(3,)] - got[(1,)])) < 1e-12
    lost = spark.createDataFrame([(1, 9)], "src bigint, dst bigint")
    assert pairs(graph.missing_structure(nodes, lost), "id", "messages") == {(9,): 1}
    assert abs(sum(r.p for r in graph.pagerank(nodes, lost, 3).collect()) - 1) < 1e-12


def test_adjacency_text(spark):
    text = spark.createDataFrame([("1 2  3",), ("4",), ("",), (" 5\t6 ",)], "value string")
    assert pairs(graph.parse_adjacency(text), "id", "adj") == {(1,): [2, 3], (4,): [], (5,): [6]}
    nodes = graph.parse_adjacency(text)
    assert graph.laid_out(nodes, 3, by_range=True).count() == graph.laid_out(nodes, 3).count() == 3
    ranks = spark.createDataFrame([(1, 0.5)], "id bigint, p double")
    assert graph.dump(nodes, ranks, 1).first().node == "{1 0.5000 [2]}"


def test_hourly(spark):
    full = "1\tSun Jan 23 00:05:00 +0000 2011\tu\tin Cairo"
    rows = [full, "1\tSun Jan 23 00:05:00 +0000 2011", "2\tTue Mar 01 00:05:00 +0000 2011\tu\tCairo", "nothing"]
    text = spark.createDataFrame([(r,) for r in rows], "value string")
    messages = temporal.parse_messages(text).withColumn("ts", temporal.message_time("timestamp"))
    assert pairs(temporal.hourly_counts(messages), "date", "hour", "n") == {("1/23", "00"): 2}
    assert pairs(temporal.hourly_counts_filtered(messages, "message", "(?i)egypt|cairo"), "date", "hour", "n") == {("1/23", "00"): 1}
    assert pairs(temporal.hourly_counts_substring(messages), "day_hour", "n") == {("1/23 00",): 2}
    assert temporal.malformed(text).first().n_malformed == 1
    assert hourly_stream(messages.filter("ts is not null")).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two\nthree\n\nfour")
    found = pairs(readers.read_lines_with_offset(spark, str(tmp_path / "a.txt")), "docid", "line")
    assert found == {(0,): "one two", (8,): "three", (14,): "", (15,): "four"}
    with gzip.open(tmp_path / "b.gz", "wt") as out:
        out.write("x\ny\n")
    assert readers.read_lines(spark, str(tmp_path / "b.gz")).count() == 2
    (tmp_path / "m.tsv").write_text('1\tt\tu\tsaid "hi\n2\tt\n')
    got = readers.read_messages(spark, str(tmp_path / "m.tsv")).orderBy("id").collect()
    assert got[0].message == 'said "hi' and got[1].message is None
    for _ in range(2):  # the second run replaces the first
        readers.write_pairs(counting.word_count(docs(spark, ["a b a"])), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a\t2", "b\t1"]
    readers.write_index(retrieval.postings(docs(spark, ["a b", "b"])), str(tmp_path / "index"), 2)
    assert retrieval.lookup(spark.read.parquet(str(tmp_path / "index")), "b").first().df == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00",), ("2024-01-01 00:50:00",), ("2024-01-01 05:00:00",)], "t string").selectExpr("cast(t as timestamp) ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in"))
    query = hourly_stream(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.n for r in spark.table("hourly").collect()) == [1, 2]


def test_offsets_of_blocks_and_folders(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        many = b"".join(b"line %d of some length\r\n" % k + b"\n" * (k % 3) for k in range(60)) + b"the last, \xff without an end"
        (tmp_path / "d").mkdir()
        (tmp_path / "d" / "b.txt").write_bytes(many)
        (tmp_path / "d" / "a.txt").write_bytes(b"one\ntwo")
        got = pairs(readers.read_lines_with_offset(spark, str(tmp_path / "d")).selectExpr("docid", "octet_length(line) n"), "docid", "n")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected, at = {(0,): 3, (4,): 3}, 0
    for line in many.split(b"\n"):
        expected[(readers.FILE_SPAN + at,)] = len(line.rstrip(b"\r"))
        at += len(line) + 1
    assert got == expected
    with gzip.open(tmp_path / "c.gz", "wt") as out:
        out.write("x\n")
    with pytest.raises(ValueError, match="compressed"):
        readers.read_lines_with_offset(spark, str(tmp_path / "c.gz"))


def test_splits_are_widened(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a b c\n" * 4000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert readers.read_lines(spark, str(tmp_path / "t.txt")).rdd.getNumPartitions() > 3
        assert readers.read_lines(spark, str(tmp_path / "t.txt"), 1 << 20).rdd.getNumPartitions() == 1
    finally:
        for name in ("maxPartitionBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{name}")


def test_codec_in_batches(spark):
    import random

    import numpy as np

    rnd = random.Random(1)
    values = [rnd.choice([1, -1]) * rnd.randrange(1 << rnd.randrange(1, 63)) for _ in range(500)] + [-112, -113, 127, 128, 0, 2**62]
    data, begins = codec.vints(np.array(values))
    assert data.tobytes() == b"".join(map(codec.vint, values))
    got, before = codec.read_vints(data, begins)
    assert got.tolist() == values and before.tolist() == list(range(len(values) + 1))
    lists = [sorted(rnd.sample(range(1 << 40), rnd.randrange(6))) for _ in range(50)] + [[]]
    rows = [(k, [(d, rnd.randrange(1, 400)) for d in own]) for k, own in enumerate(lists)]
    df = spark.createDataFrame(rows, f"k int, p {codec.POSTINGS}")
    out = {r.k: (bytes(r.data), [tuple(x) for x in r.back]) for r in df.select("k", codec.encoded("p").alias("data")).select("k", "data", codec.decoded("data").alias("back")).collect()}
    assert out == {k: (codec.encode(p), p) for k, p in rows}


def test_index_in_segments(spark):
    some = docs(spark, ["a b" if k % 3 else "a" for k in range(40)])
    index = retrieval.compressed(some, span=7)
    assert {(r.term, r.docid, r.tf) for r in retrieval.decompressed(index, 7).collect()} == {(r.term, r.docid, r.tf) for r in retrieval.term_frequencies(some).collect()}
    assert [p.docid for r in retrieval.found_postings(index, "b", 7).orderBy("segment").collect() for p in r.postings] == [k for k in range(40) if k % 3]


def test_a_long_line_streams(spark):
    many = " ".join(f"t{k}" for k in range(3000))
    sets = pmi.term_sets(docs(spark, [many] * 2 + ["t1 t2"]))
    assert pmi.pair_counts(sets, 3).collect() == [("t1", "t2", 3)]
    assert pmi.pmi_pair_total(sets, 2).first().n_pairs == 3000 * 2999 // 2
    few = pmi.SENT_TERMS
    try:
        pmi.SENT_TERMS = 1
        assert pmi.pair_counts(sets, 3).collect() == [("t1", "t2", 3)]
    finally:
        pmi.SENT_TERMS = few


def test_top_for_term_is_the_pairs_table(spark):
    sets = pmi.term_sets(docs(spark, ["a b c", "a b", "c b", "a d", "d"]))
    every = pmi.pmi_pairs(sets, 1).filter("x = 'b' or y = 'b'").selectExpr("if(x = 'b', y, x) partner", "pmi")
    expected = [tuple(r) for r in every.orderBy("pmi", "partner", ascending=[False, True]).collect()]
    assert [tuple(r)[1:] for r in pmi.pmi_top_for_term(sets, "b", 10, 1).collect()] == expected


def test_stripes_as_maps(spark):
    maps = counting.cooccurrence_maps(docs(spark, ["a b a"]))
    assert pairs(maps, "w", "stripe") == {("a",): {"a": 2, "b": 2}, ("b",): {"a": 2}}
    assert pairs(counting.merged_maps(maps.unionByName(maps)), "w", "stripe") == {("a",): {"a": 4, "b": 4}, ("b",): {"a": 4}}


def test_convergence_and_counters(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 7)], "id bigint")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (3, 1), (4, 9), (5, 4)], "src bigint, dst bigint")
    long = pairs(graph.pagerank(nodes, edges, 150), "id", "p")
    got = pairs(graph.pagerank(nodes, edges, tolerance=1e-10), "id", "p")
    assert all(abs(got[k] - v) < 1e-9 for k, v in long.items()) and abs(sum(got.values()) - 1) < 1e-9
    long = pairs(graph.personalized_pagerank(nodes, edges, [1, 5], 150), "source", "id", "p")
    got = pairs(graph.personalized_pagerank(nodes, edges, [1, 5], tolerance=1e-10), "source", "id", "p")
    assert len(got) == 12 and all(abs(got[k] - v) < 1e-9 for k, v in long.items())
    told = graph.pagerank(nodes, edges, 2, trace=True).collect()
    assert [tuple(r)[2:] for r in told] == [(6, 7, 7, 5, 4, 1)] * 2
    assert [r.id for r in graph.in_order(graph.pagerank(nodes, edges, 3)).collect()][:2] == [3, 1]
    twice = spark.createDataFrame([(1, 0.5), (1, 0.4), (2, 0.1)], "id bigint, p double")
    with pytest.raises(Exception, match="two ranks"):
        graph.top_n(twice, 2).collect()


def test_bad_numbers_are_counted(spark):
    text = spark.createDataFrame([("1 2 x",), ("y 3",), ("2 1",)], "value string")
    assert pairs(graph.parse_adjacency(text), "id", "adj") == {(1,): [2], (2,): [1]}
    assert tuple(graph.bad_numbers(text).first()) == (1, 1)


def test_dump_of_many_ranks(spark):
    adj = spark.createDataFrame([(1, [2, 3]), (2, [])], "id bigint, adj array<bigint>")
    ranks = spark.createDataFrame([(7, 1, 0.25), (5, 1, 0.5), (5, 2, 0.0), (7, 2, 1.0)], "source bigint, id bigint, p double")
    assert pairs(graph.dump_each(adj, ranks), "id", "node") == {(1,): "{1 [0.5000, 0.2500] [2, 3]}", (2,): "{2 [0.0000, 1.0000] []}"}


def test_lines_that_lack_fields(spark):
    rows = ["1\tSun Jan 23 00:05:00 +0000 2011\tu\tin Cairo", "2\tSun Jan 23 00:05:00 +0000 2011\tu\tx", "nothing", "", "3\tno time\tu\tx"]
    text = spark.createDataFrame([(r,) for r in rows], "value string")
    assert pairs(temporal.hourly_counts_of_lines(text), "date", "hour", "n") == {("1/23", "00"): 2, ("malformed", None): 2}
    assert pairs(temporal.hourly_counts_of_lines(text, "Cairo"), "date", "hour", "n") == {("1/23", "00"): 1, ("malformed", None): 2}


def test_steps_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from loomwright.functions.storage import shared_dir

    far = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError, match="shared"):
        shared_dir(far("spark://host:7077", None), "x")
    assert shared_dir(far("spark://host:7077", "s3://b/c/"), "x").startswith("s3://b/c/x-")
    assert shared_dir(far("local[4]", None), "x").startswith("file:///")
