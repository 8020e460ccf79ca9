"""The command line, tool by tool, on small files."""

import pytest

from loomwright import cli


def lines(path):
    return sorted(x for f in path.glob("part-*") for x in f.read_text().splitlines())


def test_text_tools(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a b\na c\nb a a\nd\n")
    for tool, expected in {
        "word-count": ["a\t4", "b\t2", "c\t1", "d\t1"],
        "bigram-count": ["a_a\t1", "a_b\t1", "a_c\t1", "b_a\t1"],
    }.items():
        cli.main([tool, "--input", str(tmp_path / "in.txt"), "--output", str(tmp_path / tool)])
        assert lines(tmp_path / tool) == expected
    cli.main(["pmi-pairs", "--input", str(tmp_path / "in.txt"), "--output", str(tmp_path / "pmi"), "--threshold", "1"])
    assert [x.split("\t")[:3] for x in lines(tmp_path / "pmi")] == [["a", "b", "2"], ["a", "c", "1"]]


def test_index_tools(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("gold silver\nsilver\ngold gold\n")
    cli.main(["build-index", "--input", str(tmp_path / "in.txt"), "--output", str(tmp_path / "index")])
    both = ["--index", str(tmp_path / "index"), "--collection", str(tmp_path / "in.txt")]
    capsys.readouterr()
    cli.main(["boolean", *both, "gold silver AND"])
    out = capsys.readouterr().out
    assert "gold silver" in out and "gold gold" not in out
    cli.main(["lookup", *both, "gold"])
    assert "gold gold" in capsys.readouterr().out


def test_graph_tools(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text("1 2 3\n2 3\n3 1\n4\n")
    at = lambda n: str(tmp_path / n)
    cli.main(["build-graph", "--input", at("g.txt"), "--output", at("g")])
    cli.main(["partition-graph", "--input", at("g"), "--output", at("p"), "--num-partitions", "2", "--range"])
    cli.main(["pagerank", "--input", at("p"), "--output", at("r"), "--iterations", "1"])
    cli.main(["top", "--input", at("r"), "--output", at("t"), "--top", "1"])
    assert lines(tmp_path / "t") == ["3\t0.40938"]
    cli.main(["dump", "--input", at("r"), "--graph", at("g"), "--output", at("d")])
    assert "1\t{1 0.3031 [2, 3]}" in lines(tmp_path / "d")
    cli.main(["personalized-pagerank", "--input", at("g"), "--output", at("q"), "--sources", "1,3", "--iterations", "2"])
    capsys.readouterr()
    cli.main(["top", "--input", at("q"), "--top", "2"])
    assert capsys.readouterr().out.count("|1     |") == 2
    cli.main(["weak-components", "--input", at("g"), "--output", at("c")])
    assert spark.read.parquet(at("c")).filter("component = 1").count() == 3


def test_hourly_tool(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("1\tSun Jan 23 00:05:00 +0000 2011\tu\tin Cairo\n2\tSun Jan 23 01:05:00 +0000 2011\tu\tx\nbad\n")
    cli.main(["hourly-counts", "--input", str(tmp_path / "m.tsv"), "--output", str(tmp_path / "all")])
    assert lines(tmp_path / "all") == ["1/23\t00\t1", "1/23\t01\t1"]
    cli.main(["hourly-counts", "--input", str(tmp_path / "m.tsv"), "--output", str(tmp_path / "some"), "--pattern", "(?i)egypt|cairo"])
    assert lines(tmp_path / "some") == ["1/23\t00\t1"]
    with pytest.raises(SystemExit):
        cli.main(["hourly-counts"])
