"""Command line: ``python -m loomwright.cli TOOL --input ... --output ...`` (also under spark-submit).

Outputs are replaced. Text inputs hold one document a line; graphs hold a node id and its
neighbours a line, or are the records that ``build-graph`` writes.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.storage import discard, stored
from .operators import counting, graph, pmi, retrieval, temporal
from .sources import readers


def _docs(spark: SparkSession, a) -> DataFrame:
    return readers.read_lines(spark, a.input, a.min_split_size).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def _sources(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def _graph(spark, a) -> tuple[DataFrame, DataFrame]:
    adj = spark.read.parquet(a.input)
    return adj.select("id"), graph.edges_of(adj)


def _counted(make):
    def run(spark, a):
        found = make(_docs(spark, a), a)
        # without the option adaptive execution chooses the width
        readers.write_pairs(found.repartition(a.num_reducers) if a.num_reducers else found, a.output)

    return run


def _build_index(spark, a):
    if a.min_split_size:
        readers.widen_splits(spark, a.min_split_size)
    lines = readers.read_lines_with_offset(spark, a.input)
    readers.write_index(retrieval.compressed(lines, docid="docid", text="line"), a.output, a.num_reducers)


def _lookup(spark, a):
    index, lines = spark.read.parquet(a.index), readers.read_lines_with_offset(spark, a.collection)
    for term in a.terms:
        found = retrieval.decompressed(retrieval.lookup(index, term))
        found.join(lines, "docid").select("term", "docid", "tf", "line").orderBy("docid").show(a.show, False)
        found.groupBy("tf").count().orderBy("tf").show(a.show)


def _boolean(spark, a):
    index, lines = spark.read.parquet(a.index), readers.read_lines_with_offset(spark, a.collection)
    for query in a.queries:
        terms = retrieval.decompressed(index.filter(F.col("term").isin([t for t in query.split() if t not in ("AND", "OR")])))
        print(f"Query: {query}")
        retrieval.boolean_from_index(terms, lines, query).orderBy("docid").show(a.show, False)


def _build_graph(spark, a):
    text = readers.read_lines(spark, a.input, a.min_split_size)
    readers.write_records(graph.parse_adjacency(text), a.output)
    bad = graph.bad_numbers(text).first()
    print(f"Left out: {bad.n_lines} lines without an id, {bad.n_neighbours} neighbours that are no numbers")


def _partition(spark, a):
    readers.write_records(graph.laid_out(spark.read.parquet(a.input), a.num_partitions, a.range), a.output)


def _pagerank(spark, a):
    nodes, edges = _graph(spark, a)
    readers.write_records(graph.pagerank(nodes, edges, a.iterations, a.jump, a.tolerance), a.output)


def _personalized(spark, a):
    nodes, edges = _graph(spark, a)
    readers.write_records(graph.personalized_pagerank(nodes, edges, _sources(a.sources), a.iterations, a.jump, a.tolerance), a.output)


def _top(spark, a):
    ranks = spark.read.parquet(a.input)
    best = graph.top_n_each(ranks, a.top) if "source" in ranks.columns else graph.top_n(ranks, a.top)
    keys = [c for c in ("source", "id") if c in best.columns]
    best = best.select(*keys, F.format_string("%.5f", "p").alias("p"))
    readers.write_pairs(best, a.output) if a.output else best.show(a.top * 100, False)


def _dump(spark, a):
    adj, ranks = spark.read.parquet(a.graph), spark.read.parquet(a.input)
    readers.write_pairs(graph.dump_each(adj, ranks) if "source" in ranks.columns else graph.dump(adj, ranks), a.output)


def _components(spark, a):
    readers.write_records(graph.weak_components(*_graph(spark, a)), a.output)


def _hourly(spark, a):
    months = [int(x) for x in a.months.split(",")] if a.months else None
    # a row an hour
    found = stored(temporal.hourly_counts_of_lines(readers.read_lines(spark, a.input, a.min_split_size), a.pattern, months), "hours")
    bad = found.filter("date = 'malformed'").first()
    print(f"Lines that lack fields: {bad.n if bad else 0}")
    readers.write_pairs(found.filter("date <> 'malformed'").coalesce(1).sortWithinPartitions("date", "hour"), a.output)
    discard(found)


TOOLS = {
    "word-count": (_counted(lambda d, a: counting.word_count(d)), "text"),
    "bigram-count": (_counted(lambda d, a: counting.bigram_count(d)), "text"),
    "cooccurrence-pairs": (_counted(lambda d, a: counting.cooccurrence_pairs(d, a.window)), "window"),
    "cooccurrence-stripes": (_counted(lambda d, a: counting.cooccurrence_stripes(d, a.window)), "window"),
    "pmi-pairs": (_counted(lambda d, a: pmi.pmi_pairs(pmi.term_sets(d), a.threshold)), "threshold"),
    "pmi-stripes": (_counted(lambda d, a: pmi.pmi_stripes(pmi.term_sets(d), a.threshold)), "threshold"),
    "build-index": (_build_index, "text"),
    "lookup": (_lookup, "lookup"),
    "boolean": (_boolean, "boolean"),
    "build-graph": (_build_graph, "io"),
    "partition-graph": (_partition, "partition"),
    "pagerank": (_pagerank, "pagerank"),
    "personalized-pagerank": (_personalized, "personalized"),
    "top": (_top, "top"),
    "dump": (_dump, "dump"),
    "weak-components": (_components, "io"),
    "hourly-counts": (_hourly, "hourly"),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomwright", description=__doc__)
    tools = top.add_subparsers(dest="tool", required=True)
    for name, (_, kind) in TOOLS.items():
        p = tools.add_parser(name)
        if kind in ("lookup", "boolean"):
            p.add_argument("--index", required=True)
            p.add_argument("--collection", required=True)
            p.add_argument("--show", type=int, default=1000)
            p.add_argument("terms" if kind == "lookup" else "queries", nargs="+")
            continue
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=kind != "top")
        p.add_argument("--min-split-size", type=int, help="bytes that one task reads at least")
        if kind in ("text", "window", "threshold"):
            p.add_argument("--num-reducers", type=int, help="parts of the output; without it the engine chooses")
        if kind == "window":
            p.add_argument("--window", type=int, default=2)
        if kind == "threshold":
            p.add_argument("--threshold", type=int, default=pmi.THRESHOLD)
        if kind == "partition":
            p.add_argument("--num-partitions", type=int, required=True)
            p.add_argument("--range", action="store_true")
        if kind in ("pagerank", "personalized"):
            p.add_argument("--iterations", type=int, help="rounds (10 without a tolerance)")
            p.add_argument("--jump", type=float, default=graph.ALPHA)
            p.add_argument("--tolerance", type=float, help="stop once no rank moves more")
        if kind == "personalized":
            p.add_argument("--sources", required=True, help="node ids, separated by commas")
        if kind == "top":
            p.add_argument("--top", type=int, default=100)
        if kind == "dump":
            p.add_argument("--graph", required=True, help="records with the neighbours")
        if kind == "hourly":
            p.add_argument("--pattern", help="only messages that contain a match")
            p.add_argument("--months", default="1,2", help="month numbers, separated by commas; empty: all")
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if "tolerance" in a and a.tolerance is None and a.iterations is None:
        a.iterations = 10
    spark = SparkSession.builder.appName(f"loomwright {a.tool}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    TOOLS[a.tool][0](spark, a)


if __name__ == "__main__":
    main()
