"""Pointwise mutual information of terms that share a unit (a line)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..functions.text import lines, rounded, tokens
from ..functions.workers import ship
from . import pairs

THRESHOLD = 10


def term_sets(docs: DataFrame) -> DataFrame:
    """(id, terms): the different terms of each line, one id a line."""
    return lines(docs).select(F.struct("doc_id", "line_no").alias("id"), F.array_distinct(tokens("line")).alias("terms"))


def marginals(sets: DataFrame) -> DataFrame:
    """(term, df): units that hold the term."""
    return sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


#: Terms that may be sent to every executor, as bytes (about 12 a term); beyond it lines are put together again by a shuffle.
SENT_TERMS = 2_000_000


def frequent_terms(df: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, bool]:
    """(term, df) at the threshold, and whether they are few enough to be sent to every executor."""
    some = stored(df.filter(F.col("df") >= threshold).select("term", "df"), "frequent")
    return some, some.count() <= SENT_TERMS


def _frequent_pairs(sets: DataFrame, threshold: int, df: DataFrame | None = None) -> tuple[DataFrame, object]:
    """(a, b, c_xy) of the terms' numbers, and the terms as they were sent; or (x, y, c_xy) of the terms, and None."""
    frequent, few = frequent_terms(marginals(sets) if df is None else df, threshold)
    if few:
        ship(sets.sparkSession)
        table = frequent.toArrow().sort_by([("df", "descending"), ("term", "ascending")])  # at most SENT_TERMS, counted above
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        sent = sets.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
        return pairs.frequent_pairs(stored(pairs.encoded(sets, sent), "lines"), table.column("df").to_numpy(), threshold), sent
    kept = sets.select("id", F.explode("terms").alias("term")).join(frequent.select("term"), "term")
    kept = kept.groupBy("id").agg(F.sort_array(F.collect_list("term")).alias("t"))
    both = kept.select("t", F.posexplode("t").alias("i", "x")).select("x", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("y"))
    counted = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c_xy"))
    return counted.filter(F.col("c_xy") >= threshold), None


def pair_counts(sets: DataFrame, threshold: int = THRESHOLD, df: DataFrame | None = None) -> DataFrame:
    """(x, y, c_xy) with x < y and at least ``threshold`` common units.

    A pair is no more frequent than its rarer term, so pairs with a term below the threshold leave
    where they are made; marginals are those of all terms. ``pairs`` counts the rest as numbers.
    """
    found, sent = _frequent_pairs(sets, threshold, df)
    return found if sent is None else pairs.named(found, sent).select("x", "y", "c_xy")


def _with_marginals(sets: DataFrame, threshold: int) -> DataFrame:
    """(x, y, c_xy, c_x, c_y) for pairs at the threshold."""
    df = stored(marginals(sets), "marginals")
    found, sent = _frequent_pairs(sets, threshold, df)
    if sent is not None:
        return pairs.named(found, sent)
    found = found.join(df.select(F.col("term").alias("x"), F.col("df").alias("c_x")), "x")
    return found.join(df.select(F.col("term").alias("y"), F.col("df").alias("c_y")), "y")


def conditional(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(x, y, p_y_given_x) for pairs at the threshold."""
    joined = _with_marginals(sets, threshold)
    return joined.select("x", "y", rounded(F.col("c_xy") / F.col("c_x")).alias("p_y_given_x"))


def scores(sets: DataFrame, threshold: int = THRESHOLD, total: int | None = None) -> DataFrame:
    """(x, y, c_xy, pmi): ln of the joint share over the product of the shares; total = units."""
    counted = _with_marginals(sets, threshold)
    if total is None:  # one row
        counted = counted.crossJoin(F.broadcast(sets.agg(F.count(F.lit(1)).alias("n_units"))))
    else:
        counted = counted.withColumn("n_units", F.lit(total))
    ratio = F.col("c_xy").cast("double") * F.col("n_units") / (F.col("c_x").cast("double") * F.col("c_y"))
    return counted.select("x", "y", "c_xy", F.ln(ratio).alias("pmi"))


def pmi_pairs(sets: DataFrame, threshold: int = THRESHOLD, total: int | None = None) -> DataFrame:
    return scores(sets, threshold, total).withColumn("pmi", rounded(F.col("pmi")))


def pmi_stripes(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(x, stripe): ``y:pmi`` in byte order of y."""
    entries = F.sort_array(F.collect_list(F.struct("y", "pmi")))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["y"], F.format_string("%.6f", e["pmi"]))), " ")
    return pmi_pairs(sets, threshold).groupBy("x").agg(text.alias("stripe"))


def pmi_top(sets: DataFrame, n: int = 10, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs of highest PMI; ties in order of x, y."""
    return pmi_pairs(sets, threshold).orderBy(F.desc("pmi"), "x", "y").limit(n)


def pmi_top_for_term(sets: DataFrame, term: str, n: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """The partners of highest PMI of one term, on either side of the pair. Only lines that hold the term make pairs."""
    df, total = marginals(sets), sets.agg(F.count(F.lit(1)).alias("n_units"))
    mine = marginals(sets.filter(F.array_contains("terms", term))).filter(F.col("df") >= threshold)
    own = mine.filter(F.col("term") == term).select(F.col("df").alias("c_x"))
    found = mine.filter(F.col("term") != term).select("term", F.col("df").alias("c_xy")).join(df, "term")
    for one in (own, total):  # one row each
        found = found.crossJoin(F.broadcast(one))
    ratio = F.col("c_xy").cast("double") * F.col("n_units") / (F.col("c_x").cast("double") * F.col("df"))
    found = found.select(F.lit(term).alias("term"), F.col("term").alias("partner"), rounded(F.ln(ratio)).alias("pmi"))
    return found.orderBy(F.desc("pmi"), "partner").limit(n)


def pmi_pair_total(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return _frequent_pairs(sets, threshold)[0].agg(F.count(F.lit(1)).alias("n_pairs"))
