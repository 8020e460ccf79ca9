"""Mixing sources to target weights by Pfair scheduling.

The rows of each source, in the order of md5(doc_id), are cut into blocks of ``block_rows``.
With integer weights n_i and W = their sum, block j (from 0) of a source is released at slot
floor(j W / n_i) and due before slot ceil((j + 1) W / n_i); one block runs per slot, earliest
deadline first (ties: source name). The schedule repeats every W slots, so only one period is
laid out on the driver (W small integers) and each row finds its slot by arithmetic: at every
slot before a source runs out, each source is less than one block away from its share.

All rows are kept: when a source has run out its slots stay empty and the others go on at
their relative weights; ``in_target`` marks slots before the first such gap. Null and empty
sources are one source, ''. Sources that ``weights`` does not name weigh ``other``; they are
scheduled together, as runs of their ranks in order of name, so the driver holds the named
sources' slots only, however many sources there are. Rows are numbered in buckets of the order
key whose count follows the session's partitions, so a source with a third of all rows is no
single task.

Rows with equal doc_id (repeated or null ids, ties) follow each other in any order. Texts, of any
length, are never read. An empty table gives an empty result. The caller's columns travel as one
struct, so their names matter only where they are ``block``, ``slot``, ``place`` or ``in_target``:
these four are replaced by the results.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import stored
from ._common import partitions

#: Production parameters of the query.
WEIGHTS = {"src0": 4, "src1": 3, "src2": 2}
OTHER, BLOCK_ROWS = 1, 64
#: The weights that the caller names may not add up to more: their slots are laid out on the driver.
MOST_WEIGHT = 1_000_000
_RESULTS = ("block", "slot", "place", "in_target")


def schedule(weights: dict[str, int], other: int = 1, unnamed: int = 0, before: dict[str, int] | None = None):
    """(slots of each named source's blocks in one period, rounds of the unnamed ones, the period).

    ``unnamed`` sources weigh ``other`` each; ``before`` counts those whose name is less than a named
    source's. They have the same releases and deadlines, so block j of all of them is a round, of
    which runs of ranks take runs of slots: (first rank, first slot) in order of rank.
    """
    if any(n < 1 for n in (*weights.values(), other)) or sum(weights.values()) > MOST_WEIGHT:
        raise ValueError(f"weights must be positive integers with a sum of at most {MOST_WEIGHT}")
    total, before = sum(weights.values()) + other * unnamed, before or {}
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s, 0) for s in sorted(weights)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # (deadline, source, block)
    rounds: list[list[tuple[int, int]]] = [[] for _ in range(other if unnamed else 0)]
    opened, turn, rank, slot = 0, 0, 0, 0  # rounds released, the round that runs, its next rank
    while slot < total:
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j))
        while opened < len(rounds) and opened * total // other <= slot:
            opened += 1
        due = -(-(turn + 1) * total // other) if turn < opened else None
        if ready and (due is None or ready[0][0] < due or ready[0][0] == due and before.get(ready[0][1], 0) <= rank):
            _, s, j = heapq.heappop(ready)
            slots[s].append(slot)
            if j + 1 < weights[s]:
                heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))
            slot += 1
            continue
        room = [unnamed - rank, *([waiting[0][0] - slot] if waiting else []), *([before.get(ready[0][1], 0) - rank] if ready and ready[0][0] == due else [])]
        rounds[turn].append((rank, slot))
        rank, slot = rank + min(room), slot + min(room)
        if rank == unnamed:
            turn, rank = turn + 1, 0
    return slots, rounds, total


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots, in one period, of each source's blocks: earliest deadline first."""
    return schedule(weights)[0]


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver, by functions only."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _plan(sizes: DataFrame, weights: dict[str, int], other: int, block_rows: int) -> tuple[DataFrame, int, int]:
    """(s, n, slots) of every source; the period; the first slot that a source leaves empty."""
    spark, named = sizes.sparkSession, sorted(weights)
    sizes = stored(sizes, "sources")
    found = sizes.filter(F.col("s").isin(named)).select("s").collect()  # no more than the caller names
    own = {r.s: weights[r.s] for r in found}
    rest = sizes.filter(~F.col("s").isin(named)) if named else sizes
    counts = rest.agg(F.count(F.lit(1)), *[F.count_if(F.col("s") < s) for s in own]).first()
    slots, rounds, total = schedule(own, other, counts[0], dict(zip(own, counts[1:])))
    plan = _rows(spark, [{"s": s, "n": n, "slots": slots[s]} for s, n in own.items()], "s:string,n:bigint,slots:array<bigint>")
    # ranks of the others: sorted by ranges, counted a range; one row a range comes before
    ranged = stored(rest.select("s").repartitionByRange(partitions(sizes), "s").select("s", F.spark_partition_id().alias("part")), "source-ranges")
    ahead = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    ahead = ahead.select("part", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy("s")) - 1
    ranked = ranged.join(ahead, "part").select("s", rank.alias("rank"))
    runs = [{"rounds": [[{"rank": r, "slot": t} for r, t in own] for own in rounds]}]
    runs = _rows(spark, runs, "rounds:array<array<struct<rank:bigint,slot:bigint>>>")  # one row
    last = F.transform("rounds", lambda own: F.element_at(F.filter(own, lambda x: x["rank"] <= F.col("rank")), -1))
    others = ranked.crossJoin(F.broadcast(runs)).select("s", F.lit(other).cast("bigint").alias("n"), F.transform(last, lambda x: x["slot"] + F.col("rank") - x["rank"]).alias("slots"))
    plan = stored(plan.unionByName(others), "schedule")
    blocks = F.expr(f"(rows + {block_rows - 1}) div {block_rows}")
    empty = F.expr("blocks div n") * F.lit(total).cast("bigint") + F.element_at("slots", (F.col("blocks") % F.col("n") + 1).cast("int"))
    gap = plan.join(sizes.withColumn("blocks", blocks), "s").agg(F.coalesce(F.min(empty), F.lit(0))).first()[0]
    return plan, total, gap


def mix(docs: DataFrame, weights: dict[str, int] | None = None, other: int = OTHER, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` (with doc_id and source) and block, slot, place (in the block), in_target for each row.

    Ordered by (slot, place) the rows are the mixture.
    """
    weights, kept = WEIGHTS if weights is None else weights, [c for c in docs.columns if c not in _RESULTS]
    name, id_ = F.coalesce(F.col("source"), F.lit("")), F.col("doc_id")
    plan, total, gap = _plan(docs.groupBy(name.alias("s")).agg(F.count(F.lit(1)).alias("rows")), weights, other, block_rows)

    digits = math.ceil(math.log(16 * partitions(docs), 16))
    key = F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), id_.alias("id"), name.alias("s"), key.alias("key"), F.substring(key, 1, digits).alias("part"))
    tally = docs.select(name.alias("s"), F.substring(key, 1, digits).alias("part")).groupBy("s", "part").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.select("s", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("ahead")).join(plan, "s")
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("s", "part").orderBy("key", "id")))
    # a source has a row a bucket in ``tally``, so the hot one is as many keys as there are buckets
    placed = ranked.join(tally, ["s", "part"]).withColumn("at", F.col("ahead") + F.col("rank") - 1).withColumn("own", F.expr(f"at div {block_rows}"))
    slot = F.expr("(own div n)") * F.lit(total).cast("bigint") + F.element_at("slots", (F.col("own") % F.col("n") + 1).cast("int"))
    placed = placed.select("row", F.struct(F.col("own").alias("block"), slot.alias("slot"), (F.col("at") % block_rows).alias("place"), (slot < gap).alias("in_target")).alias("to"))
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "to.*")


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, source, block, slot, place, in_target of every document."""
    return mix(docs.select("doc_id", "source"))


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS s,
    row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) - 1 AS pos
  FROM documents),
w AS (
  SELECT s, count(*) AS n_rows, (CASE s {" ".join(f"WHEN '{s}' THEN {n}" for s, n in WEIGHTS.items())} ELSE {OTHER} END)::BIGINT AS n,
    row_number() OVER (ORDER BY s) AS i FROM d GROUP BY s),
k AS (SELECT sum(n)::BIGINT AS total, list(n ORDER BY i) AS ns FROM w),
run AS (
  SELECT 0::BIGINT AS slot, list_transform(ns, lambda x: 0::BIGINT) AS done, 0::BIGINT AS took, total, ns FROM k
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(ns) + 1), lambda i: done[i] + (i = pick)::BIGINT), pick, total, ns
  FROM (SELECT *, list_min(list_transform(list_filter(range(1, len(ns) + 1),
            lambda i: done[i] < ns[i] AND done[i] * total // ns[i] <= slot),
            lambda i: ((done[i] + 1) * total + ns[i] - 1) // ns[i] * 100000 + i)) % 100000 AS pick FROM run WHERE slot < total)),
slots AS (
  SELECT took AS i, slot - 1 AS slot, row_number() OVER (PARTITION BY took ORDER BY slot) - 1 AS j FROM run WHERE took > 0),
b AS (SELECT s, n, i, (n_rows + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS blocks FROM w),
gap AS (SELECT min(blocks // n * total + slot) AS gap FROM b, k, slots WHERE slots.i = b.i AND slots.j = blocks % n)
SELECT doc_id, source, (pos // {BLOCK_ROWS})::BIGINT AS block,
  (pos // {BLOCK_ROWS} // n * total + slot)::BIGINT AS slot, (pos % {BLOCK_ROWS})::BIGINT AS place,
  (pos // {BLOCK_ROWS} // n * total + slot) < gap AS in_target
FROM d JOIN w USING (s) CROSS JOIN k CROSS JOIN gap JOIN slots ON slots.i = w.i AND slots.j = (pos // {BLOCK_ROWS}) % n
"""
