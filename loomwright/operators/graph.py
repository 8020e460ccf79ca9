"""Directed graphs as nodes (id) and edges (src, dst): PageRank, personalized PageRank, layout, dumps.

Parallel edges each carry a share. Mass at nodes without outgoing edges, and mass sent to ids
that are not nodes, is missing mass: it returns by the jump rules below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.storage import discard, stored
from .components import components

ALPHA = 0.15


def parse_adjacency(text: DataFrame) -> DataFrame:
    """Lines (value) of an id and its neighbours, separated by white space -> (id, adj).

    A line whose id is no whole number is left out, and so is a neighbour that is none; ``bad_numbers``
    counts them.
    """
    ids = _parsed(text)
    rest = F.filter(F.slice("ids", F.lit(2), F.size("ids")), lambda x: x.isNotNull())
    return ids.filter(F.get("ids", F.lit(0)).isNotNull()).select(F.get("ids", F.lit(0)).alias("id"), rest.alias("adj"))


def _parsed(text: DataFrame) -> DataFrame:
    part = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = text.select(part.alias("p")).filter(F.get("p", F.lit(0)) != "")
    return rows.select(F.transform("p", lambda x: x.try_cast("bigint")).alias("ids"))


def bad_numbers(text: DataFrame) -> DataFrame:
    """One row: lines without a readable id, and neighbours that are no whole numbers on the other lines."""
    first = F.get("ids", F.lit(0)).isNotNull()
    lost = F.when(first, F.size(F.filter("ids", lambda x: x.isNull()))).otherwise(0)
    return _parsed(text).agg(F.count_if(~first).alias("n_lines"), F.coalesce(F.sum(lost), F.lit(0)).alias("n_neighbours"))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, adj): neighbours in ascending order, empty for dangling nodes."""
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("adj"))
    return nodes.join(lists, "id", "left").withColumn("adj", F.coalesce("adj", F.expr("cast(array() as array<bigint>)")))


def edges_of(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("id").alias("src"), F.explode("adj").alias("dst"))


def counters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, nodes with an outgoing edge, dangling nodes."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    both = nodes.join(out, F.col("id") == F.col("src"), "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_edges"),
        F.count("d").alias("n_active"), (F.count(F.lit(1)) - F.count("d")).alias("n_dangling"),
    )


def missing_structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, messages): targets of edges that are not nodes."""
    lost = edges.join(nodes, F.col("dst") == F.col("id"), "left_anti")
    return lost.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("messages"))


def partition_range(nodes: DataFrame, n_nodes: int, k: int) -> DataFrame:
    """(id, part): contiguous id ranges, floor(id k / n) mod k, in whole numbers."""
    return nodes.select("id", F.expr(f"(id * {k} div {n_nodes}) % {k}").alias("part"))


def partition_hash(nodes: DataFrame, k: int) -> DataFrame:
    return nodes.select("id", (F.col("id") % k).alias("part"))


def laid_out(adj: DataFrame, k: int, by_range: bool = False) -> DataFrame:
    """The same rows, dealt over k partitions by id; results never depend on it."""
    return adj.repartitionByRange(k, "id") if by_range else adj.repartition(k, "id")


def _shares(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per source and existing target: the fraction of the source's rank that goes there."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    grouped = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    inside = grouped.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return inside.join(degree, "src").select("src", "dst", (F.col("k") / F.col("d")).alias("share"))


#: Rounds that a run to convergence takes at most.
MOST_ROUNDS = 200


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int | None = None, alpha: float = ALPHA, tolerance: float | None = None, trace: bool = False):
    """(id, p) after ``iterations`` rounds from uniform ranks, or once no rank moves more than ``tolerance``.

    p' = alpha / n + (1 - alpha) (m + missing / n). One job a round: its result is written to the
    shared folder, so plans stay one round long, and the write itself adds up the round's counters;
    what the round before wrote is removed. A round's largest move is known once its missing mass is,
    so the rule is tested on the written moves. With ``trace`` a row for each round instead:
    iteration, missing, nodes, edges, messages (edges from nodes), sent (parallel ones combined, to
    nodes only), received (nodes that a message reached), lost (messages to ids that are not nodes).
    """
    spark = nodes.sparkSession
    nodes = stored(nodes.select(F.col("id").cast("bigint").alias("id")).distinct(), "nodes")
    shares = stored(_shares(nodes, edges), "shares")
    n = nodes.count()
    if not n:
        raise ValueError("a graph without nodes has no ranks")
    if trace:
        own = edges.join(nodes, F.col("src") == F.col("id"), "left_semi")
        inside = own.join(nodes, F.col("dst") == F.col("id"), "left_semi")
        counts = inside.agg(F.count(F.lit(1)), F.count_distinct("src", "dst"), F.count_distinct("dst")).first()
        messages = own.count()
        told_once = (n, edges.count(), messages, counts[1], counts[2], messages - counts[0])
    ranks, rounds, before = nodes.withColumn("p", F.lit(1.0 / n)), [], None
    for turn in range(MOST_ROUNDS if iterations is None else iterations):
        mass = ranks.join(shares, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("p") * F.col("share")).alias("m"))
        got = ranks.join(mass, F.col("id") == F.col("dst"), "left").select("id", F.col("p").alias("old"), F.coalesce("m", F.lit(0.0)).alias("m"))
        told = Observation()
        got = stored(got.observe(told, F.sum("m").alias("mass")), "mass")
        if before is not None:
            discard(before)
        before, missing = got, max(0.0, 1.0 - told.get["mass"])
        if trace:
            rounds.append((turn + 1, missing, *told_once))
        new = F.lit(alpha / n) + (1 - alpha) * (F.col("m") + missing / n)
        ranks = got.select("id", new.alias("p"))
        if tolerance is not None and got.agg(F.max(F.abs(new - F.col("old")))).first()[0] <= tolerance:
            break
    if trace:
        return spark.createDataFrame(rounds, "iteration int, missing double, nodes bigint, edges bigint, messages bigint, sent bigint, received bigint, lost bigint")
    return ranks


def personalized_pagerank(nodes: DataFrame, edges: DataFrame, sources: list[int], iterations: int | None = None, alpha: float = ALPHA, tolerance: float | None = None) -> DataFrame:
    """(source, id, p) for each source, all in one pass: jumps and missing mass return to the source.

    ``iterations`` rounds, or until no rank of any source moves more than ``tolerance``. Between the
    rounds only nodes that a source's mass has reached have a row.
    """
    spark = nodes.sparkSession
    nodes = stored(nodes.select(F.col("id").cast("bigint").alias("id")).distinct(), "nodes")
    wanted = spark.createDataFrame([(s,) for s in sorted(set(sources))], "source bigint")
    # only the caller's few sources are broadcast, here and below
    known = {r.id for r in nodes.join(F.broadcast(wanted), F.col("id") == F.col("source"), "left_semi").collect()}
    if unknown := set(sources) - known:
        raise ValueError(f"sources that are not nodes: {sorted(unknown)}")
    shares = stored(_shares(nodes, edges), "shares")
    ranks, before = wanted.select("source", F.col("source").alias("id"), F.lit(1.0).alias("p")), None
    for _ in range(MOST_ROUNDS if iterations is None else iterations):
        mass = ranks.join(shares, F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("share")).alias("m"))
        old = ranks.select("source", "id", F.col("p").alias("old"))
        got = mass.join(old, ["source", "id"], "full").select("source", "id", F.coalesce("m", F.lit(0.0)).alias("m"), F.coalesce("old", F.lit(0.0)).alias("old"))
        got = stored(got, "mass")
        if before is not None:
            discard(before)
        before = got
        lost = got.groupBy("source").agg(F.greatest(F.lit(0.0), 1.0 - F.sum("m")).alias("missing"))
        at_source = F.lit(alpha) + (1 - alpha) * (F.col("m") + F.col("missing"))
        new = got.join(F.broadcast(lost), "source").select(
            "source", "id", "old", F.when(F.col("id") == F.col("source"), at_source).otherwise((1 - alpha) * F.col("m")).alias("p")
        )
        ranks = new.select("source", "id", "p").filter("p > 0")
        if tolerance is not None and new.agg(F.max(F.abs(F.col("p") - F.col("old")))).first()[0] <= tolerance:
            break
    # the others have rank 0
    every = nodes.crossJoin(F.broadcast(wanted))
    return every.join(ranks, ["source", "id"], "left").select("source", "id", F.coalesce("p", F.lit(0.0)).alias("p"))


def in_order(ranks: DataFrame) -> DataFrame:
    """All ranks, highest first; ties in order of id. Sorted by ranges of the ranks."""
    return ranks.orderBy(F.desc("p"), "id")


def top_n(ranks: DataFrame, n: int) -> DataFrame:
    """Highest ranks; ties in order of id. Each partition keeps n rows before they meet.

    An id that stands twice among them is an error, raised when the rows are computed.
    """
    best = ranks.orderBy(F.desc("p"), "id").limit(n)
    times = F.count(F.lit(1)).over(Window.partitionBy("id"))  # of n rows at most
    checked = [F.when(F.col("_n") > 1, F.raise_error(F.lit("an id has two ranks"))).otherwise(F.col(c)).alias(c) for c in best.columns]
    return best.withColumn("_n", times).select(*checked).orderBy(F.desc("p"), "id")


def top_n_each(ranks: DataFrame, n: int) -> DataFrame:
    """Highest ranks of each source."""
    order = Window.partitionBy("source").orderBy(F.desc("p"), "id")
    return ranks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that edges reach in either direction."""
    roots = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return nodes.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


def dump(adj: DataFrame, ranks: DataFrame, neighbours: int | None = 10) -> DataFrame:
    """(id, node): ``{id rank [neighbours]}`` with four decimals; None: all neighbours."""
    return adj.join(ranks, "id").select("id", F.format_string("{%d %.4f [%s]}", "id", "p", _listed(neighbours)).alias("node"))


def dump_each(adj: DataFrame, ranks: DataFrame, neighbours: int | None = None) -> DataFrame:
    """(id, node): ``{id [rank of each source] [neighbours]}`` from (source, id, p), sources in ascending order."""
    lists = ranks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("source", "p"))).alias("ps"))  # one a source
    texts = F.array_join(F.transform("ps", lambda x: F.format_string("%.4f", x["p"])), ", ")
    return adj.join(lists, "id").select("id", F.format_string("{%d [%s] [%s]}", "id", texts, _listed(neighbours)).alias("node"))


def _listed(neighbours: int | None):
    some = F.col("adj") if neighbours is None else F.slice("adj", 1, neighbours)
    return F.array_join(F.transform(some, lambda x: x.cast("string")), ", ")
