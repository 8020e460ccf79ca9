"""Queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from . import decontaminate, language, mixing, quality, simhash, spotsigs, suffixarray, toxicity, urlfilter, warc
from ._common import table

QUERIES = {
    "op1_quality": lambda spark, d: quality.op1(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_warc": lambda spark, d: warc.op2(table(spark, d, "pages")),
    "op3_spotsigs": lambda spark, d: spotsigs.op3(table(spark, d, "documents")),
    "op4_decontaminate": lambda spark, d: decontaminate.op4(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op5_url_filter": lambda spark, d: urlfilter.op5(table(spark, d, "pages")),
    "op6_language": lambda spark, d: language.op6(table(spark, d, "documents")),
    "op7_mixing": lambda spark, d: mixing.op7(table(spark, d, "documents")),
    "op8_suffix_array": lambda spark, d: suffixarray.op8(table(spark, d, "documents")),
    "op9_simhash": lambda spark, d: simhash.op9(table(spark, d, "documents")),
    "op10_toxicity": lambda spark, d: toxicity.op10(table(spark, d, "documents"), table(spark, d, "labels")),
}

#: DuckDB SQL where SQL can state the query; the others are tested against brute force.
ORACLES = {"op2_warc": warc.ORACLE, "op5_url_filter": urlfilter.ORACLE, "op7_mixing": mixing.ORACLE}
