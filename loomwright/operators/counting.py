"""Text counting and co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import distance_pairs, tokens, units


def word_count(docs: DataFrame) -> DataFrame:
    """(term, n) over all tokens."""
    return docs.select(F.explode(tokens("text")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def term_count(docs: DataFrame, term: str) -> DataFrame:
    """One row: the count of one term, 0 if absent."""
    found = docs.select(F.explode(tokens("text")).alias("term")).filter(F.col("term") == term)
    return found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(term).alias("term"), "n")


def vocabulary_stats(docs: DataFrame) -> DataFrame:
    """One row: tokens, different terms, first and last term in byte order."""
    return word_count(docs).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("n_terms"),
        F.min("term").alias("first_term"), F.max("term").alias("last_term"),
    )


def bigram_count(docs: DataFrame, unit: str = "line") -> DataFrame:
    """(bigram, n): neighbours in a unit, joined by ``_``."""
    pairs = units(docs, unit).select(F.explode(distance_pairs(F.col("toks"), 1)).alias("p"))
    return pairs.groupBy(F.concat_ws("_", "p.a", "p.b").alias("bigram")).agg(F.count(F.lit(1)).alias("n"))


def cooccurrence_pairs(docs: DataFrame, window: int = 2, unit: str = "line") -> DataFrame:
    """(w, u, n): how often u stands within ``window`` places of w, itself excluded by place.

    Pairs are counted once, in text order, and mirrored after the first aggregation.
    """
    near = F.concat(*[distance_pairs(F.col("toks"), d) for d in range(1, window + 1)])
    pairs = units(docs, unit).select(F.explode(near).alias("p"))
    ordered = pairs.groupBy(F.col("p.a").alias("w"), F.col("p.b").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    mirrored = ordered.select(F.inline(F.array(F.struct("w", "u", "n"), F.struct(F.col("u").alias("w"), F.col("w").alias("u"), "n"))))
    return mirrored.groupBy("w", "u").agg(F.sum("n").alias("n"))


def cooccurrence_stripes(docs: DataFrame, window: int = 2, unit: str = "line") -> DataFrame:
    """(w, stripe): all neighbours of w as ``u:n`` in byte order of u."""
    pairs = cooccurrence_pairs(docs, window, unit)
    entries = F.sort_array(F.collect_list(F.struct("u", "n")))
    joined = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["u"], e["n"].cast("string"))), " ")
    return pairs.groupBy("w").agg(joined.alias("stripe"))


def cooccurrence_maps(docs: DataFrame, window: int = 2, unit: str = "line") -> DataFrame:
    """(w, stripe): all neighbours of w as a map from neighbour to count."""
    pairs = cooccurrence_pairs(docs, window, unit)
    return pairs.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("u", "n"))).alias("stripe"))


def merged_maps(stripes: DataFrame) -> DataFrame:
    """(w, stripe) with maps of one w added up, entry by entry."""
    entries = stripes.select("w", F.explode("stripe").alias("u", "n")).groupBy("w", "u").agg(F.sum("n").alias("n"))
    return entries.groupBy("w").agg(F.map_from_entries(F.collect_list(F.struct("u", "n"))).alias("stripe"))
