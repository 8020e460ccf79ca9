"""Inverted index and Boolean retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import decoded, encoded, vint_length
from ..functions.text import tokens


def term_frequencies(docs: DataFrame, docid: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, docid, tf)"""
    exploded = docs.select(F.col(docid).cast("bigint").alias("docid"), F.explode(tokens(text)).alias("term"))
    return exploded.groupBy("term", "docid").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def postings(docs: DataFrame, docid: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, postings), the postings sorted by docid; each term once."""
    entries = F.sort_array(F.collect_list(F.struct("docid", "tf"))).alias("postings")
    return term_frequencies(docs, docid, text).groupBy("term").agg(F.count(F.lit(1)).alias("df"), entries)


def postings_text(index: DataFrame) -> DataFrame:
    """Postings as ``docid:tf`` separated by blanks; whole lists or segments."""
    text = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["docid"].cast("string"), p["tf"].cast("string"))), " ")
    return index.select(*[c for c in index.columns if c != "postings"], text.alias("postings"))


#: Document ids that one task of ``gaps`` or one segment of a posting list spans at most.
SPAN = 1 << 20


def segments(docs: DataFrame, span: int = SPAN, docid: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, segment, df, postings): posting lists cut at multiples of ``span`` ids.

    A term that every document holds is a list of bounded rows, not one row that grows with the
    collection; ``df`` counts the segment.
    """
    entries = F.sort_array(F.collect_list(F.struct("docid", "tf"))).alias("postings")
    keyed = term_frequencies(docs, docid, text).withColumn("segment", F.floor(F.col("docid") / span))
    return keyed.groupBy("term", "segment").agg(F.count(F.lit(1)).alias("df"), entries)


def gaps(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(term, docid, gap, tf): distance to the previous document of the term (the first: to 0).

    Each term is walked in stretches of ``span`` ids, so a term of all documents is many tasks;
    a stretch learns where the one before it ended from a table with one row a stretch.
    """
    found = term_frequencies(docs).withColumn("part", F.floor(F.col("docid") / span))
    ends = found.groupBy("term", "part").agg(F.max("docid").alias("last"))
    ends = ends.select("term", "part", F.lag("last", 1, 0).over(Window.partitionBy("term").orderBy("part")).alias("before"))
    inside = F.lag("docid").over(Window.partitionBy("term", "part").orderBy("docid"))
    walked = found.withColumn("previous", inside).join(ends, ["term", "part"])
    return walked.select("term", "docid", (F.col("docid") - F.coalesce("previous", "before")).alias("gap"), "tf")


def size_bytes(docs: DataFrame) -> DataFrame:
    """One row: bytes of all compressed posting lists."""
    total = F.sum(vint_length(F.col("gap")) + vint_length(F.col("tf")))
    return gaps(docs).agg(F.coalesce(total, F.lit(0)).cast("bigint").alias("n_bytes"))


def compressed(docs: DataFrame, span: int = SPAN, docid: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, segment, df, data): the compressed index; ids in a segment count from its first."""
    cut = segments(docs, span, docid, text)
    inside = F.transform("postings", lambda p: F.struct((p["docid"] - F.col("segment") * span).alias("docid"), p["tf"].alias("tf")))
    return cut.select("term", "segment", "df", encoded(inside).alias("data"))


def decompressed(index: DataFrame, span: int = SPAN) -> DataFrame:
    """(term, docid, tf) from the compressed index."""
    return index.select("term", "segment", F.inline(decoded("data"))).select("term", (F.col("segment") * span + F.col("docid")).alias("docid"), "tf")


def lookup(index: DataFrame, term: str) -> DataFrame:
    """The term's rows; no row for an unknown term."""
    return index.filter(F.col("term") == term)


def found_postings(index: DataFrame, term: str, span: int = SPAN) -> DataFrame:
    """(term, segment, df, postings) of one term in a compressed index; only its bytes are decoded."""
    whole = F.transform(decoded("data"), lambda p: F.struct((F.col("segment") * span + p["docid"]).alias("docid"), p["tf"].alias("tf")))
    return lookup(index, term).select("term", "segment", "df", whole.alias("postings"))


def tf_histogram(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(term, tf, n): documents by how often they hold the term."""
    found = term_frequencies(docs).filter(F.col("term").isin(terms))
    return found.groupBy("term", "tf").agg(F.count(F.lit(1)).alias("n"))


def parse_postfix(query: str):
    """Postfix query -> a term or (operator, left, right). Operators are exactly AND and OR."""
    stack: list = []
    for token in query.split():
        if token in ("AND", "OR"):
            if len(stack) < 2:
                raise ValueError(f"operator {token} lacks an operand in {query!r}")
            right, left = stack.pop(), stack.pop()
            stack.append((token, left, right))
        else:
            stack.append(token)
    if len(stack) != 1:
        raise ValueError(f"{query!r} is not one postfix expression: {len(stack)} operands remain")
    return stack[0]


def _terms(tree) -> set[str]:
    return {tree} if isinstance(tree, str) else _terms(tree[1]) | _terms(tree[2])


def _condition(tree, held: dict[str, Column]) -> Column:
    if isinstance(tree, str):
        return held[tree]
    left, right = _condition(tree[1], held), _condition(tree[2], held)
    return left & right if tree[0] == "AND" else left | right


def boolean(collection: DataFrame, query: str) -> DataFrame:
    """Rows (docid, line) of ``collection`` that satisfy a postfix query.

    A row is judged where it is read, on its own token array: no shuffle, no index, no fetch
    by seek. Unknown terms hold nowhere.
    """
    tree = parse_postfix(query)
    held = {t: F.array_contains("_toks", t) for t in _terms(tree)}
    return collection.withColumn("_toks", tokens("line")).filter(_condition(tree, held)).select("docid", "line")


def boolean_from_index(index: DataFrame, collection: DataFrame, query: str) -> DataFrame:
    """The same from an index (term, docid, tf): one aggregation over the query's postings, then the lines."""
    tree = parse_postfix(query)
    names = sorted(_terms(tree))
    some = index.filter(F.col("term").isin(names)).groupBy("docid")
    flags = some.agg(*[F.bool_or(F.col("term") == t).alias(f"t{k}") for k, t in enumerate(names)])
    found = flags.filter(_condition(tree, {t: F.col(f"t{k}") for k, t in enumerate(names)})).select("docid")
    return collection.join(found, "docid").select("docid", "line")
