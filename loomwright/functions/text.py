"""Tokens and lines as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Maximal runs of anything but ASCII white space. Case and punctuation are kept.
TOKEN = r"[^ \t\n\x0B\f\r]+"


def tokens(text: str | Column) -> Column:
    """Array of the tokens of a text; no empty strings."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def lines(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """One row per line: id, line_no (from 0), line. Empty lines count; null texts have none."""
    return docs.select(id_, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def units(docs: DataFrame, unit: str = "line") -> DataFrame:
    """Token arrays of the counting unit, a line (default) or a whole document: (toks)."""
    if unit == "line":
        return lines(docs).select(tokens("line").alias("toks"))
    if unit == "doc":
        return docs.select(tokens("text").alias("toks"))
    raise ValueError(f"unit must be 'line' or 'doc', not {unit!r}")


def distance_pairs(toks: Column, distance: int) -> Column:
    """Array of (a, b): each token and the one ``distance`` places later."""
    left = F.greatest(F.size(toks) - distance, F.lit(0))
    return F.arrays_zip(F.slice(toks, F.lit(1), left).alias("a"), F.slice(toks, F.lit(1 + distance), left).alias("b"))


def rounded(value: Column, places: int = 6) -> Column:
    return F.round(value, places)
