"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two aggregations (minimum per node, combined map-side) and joins; the links of
each round are written to the cluster's shared folder, so lineage stays short and a lost
executor costs one round. Nothing is collected but one row of counts per round. A hub's rows
meet only in minima and in joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import discard, stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of longs -> (node, root): root is the least node of the component.

    Nodes without a link are absent. Links to oneself, repeated links and nulls are ignored.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    links = links.filter("u <> v").select(big.alias("u"), small.alias("v")).distinct()
    before, last = None, None
    while True:
        links = stored(links, "components")
        if last is not None:
            discard(last)
        last, now = links, _state(links)
        if now == before or not now[0]:
            break
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = (
            large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
