"""Every query by name, and DuckDB SQL that states the same for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import shared_dir
from ..functions.text import lines
from ..operators import counting, graph, pmi, retrieval, temporal
from ..sources.readers import read_table, write_index

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters of the queries.
TERM, RARE_TERM, UNKNOWN_TERM = "the", "of", "no-such-term"
HISTOGRAM_TERMS = ["the", "of"]
BOOLEAN = {
    "boolean_and": "the of AND",
    "boolean_or": "was only OR",
    "boolean_q1": "the of AND is AND",
    "boolean_q2": "with by OR this only OR AND",
    "boolean_q3": "la de AND el que OR AND",
    "boolean_q4": "der no-such-term OR und AND",
    "boolean_q5": "the of AND and to AND OR this AND",
}
FILTER = "(?i)error|sign"
PARTS, ITERATIONS, SOURCES, TOP = 7, 5, [1, 5, 42], 10
#: A run has settled once no rank moves more; the statement below it lays out so many rounds at most.
TOLERANCE, ROUNDS = 1e-4, 30


def _docs(spark, d):
    return read_table(spark, d, "documents")


def _english(spark, d):
    return pmi.term_sets(_docs(spark, d).filter(F.col("lang") == "en"))


def _lines(spark, d):
    docid = (F.col("doc_id") * 1000000 + F.col("line_no")).alias("docid")
    return lines(_docs(spark, d)).select(docid, "line")


def _nodes(spark, d):
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("id"))


def part_edges(spark, d):
    """src -> dst: neighbours among the well discounted items of an order."""
    items = read_table(spark, d, "lineitem").filter("l_discount >= 0.09").select("l_orderkey", "l_linenumber", "l_partkey")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return items.select(F.col("l_partkey").alias("src"), following.alias("dst")).filter("dst is not null")


def _g(spark, d):
    return _nodes(spark, d), part_edges(spark, d)


def _rounded(ranks: DataFrame) -> DataFrame:
    """Ranks to the precision of a 32-bit float: decimal places would often end exactly on a half."""
    return ranks.withColumn("p", F.col("p").cast("float").cast("double"))


def _graph_adjacency(spark, d):
    adj = graph.adjacency(*_g(spark, d))
    return adj.select("id", F.array_join(F.transform("adj", lambda x: x.cast("string")), " ").alias("adj"))


def _graph_dump(spark, d):
    nodes, edges = _g(spark, d)
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    uniform = nodes.crossJoin(F.broadcast(n)).select("id", (F.lit(1.0) / F.col("n")).alias("p"))
    return graph.dump(graph.adjacency(nodes, edges), uniform)


def _adjacency_text(spark, d):
    """The graph as lines of text: an id and its neighbours; every 97th id is no number."""
    lists = graph.adjacency(*_g(spark, d))
    id_ = F.when(F.col("id") % 97 == 0, F.concat(F.lit("x"), F.col("id").cast("string"))).otherwise(F.col("id").cast("string"))
    return lists.select(F.concat(id_, F.lit("\t"), F.array_join(F.transform("adj", lambda x: x.cast("string")), "  ")).alias("value"))


def _from_text(spark, d):
    return graph.parse_adjacency(_adjacency_text(spark, d)).select("id", F.array_join(F.transform("adj", lambda x: x.cast("string")), " ").alias("adj"))


def _counters_of_rounds(spark, d):
    return graph.pagerank(*_g(spark, d), ITERATIONS, trace=True).withColumn("missing", F.round("missing", 8))


def _range(spark, d):
    nodes = _nodes(spark, d)
    return graph.partition_range(nodes, nodes.count(), PARTS)


def _ppr_dump(spark, d):
    nodes, edges = _g(spark, d)
    ranks = _rounded(graph.personalized_pagerank(nodes, edges, SOURCES, ITERATIONS))
    return graph.dump_each(graph.adjacency(nodes, edges), ranks)


def _message_lines(spark, d):
    """Events as message lines; every 89th lacks its fields."""
    m = temporal.as_messages(read_table(spark, d, "events"))
    line = F.concat_ws("\t", "id", "timestamp", "user", "message")
    return m.select(F.when(F.col("id").cast("bigint") % 89 == 0, F.col("id")).otherwise(line).alias("value"))


def _stored_lookup(spark, d, term):
    """One term's postings, from the bytes of a stored index sorted by term."""
    path = shared_dir(spark, "index")
    write_index(retrieval.compressed(_docs(spark, d)), path)
    return retrieval.postings_text(retrieval.found_postings(spark.read.parquet(path), term))


def _missing(spark, d):
    nodes, edges = _g(spark, d)
    return graph.missing_structure(nodes.filter("id % 10 <> 3"), edges)


def _roundtrip(spark, d):
    return retrieval.decompressed(retrieval.compressed(_docs(spark, d)))


QUERIES: dict[str, Query] = {
    "word_count": lambda s, d: counting.word_count(_docs(s, d)),
    "vocabulary_stats": lambda s, d: counting.vocabulary_stats(_docs(s, d)),
    "term_count": lambda s, d: counting.term_count(_docs(s, d), TERM),
    "bigram_count": lambda s, d: counting.bigram_count(_docs(s, d)),
    "cooccurrence_pairs": lambda s, d: counting.cooccurrence_pairs(_docs(s, d)),
    "cooccurrence_maps": lambda s, d: counting.cooccurrence_maps(_docs(s, d)).select("w", F.size("stripe").alias("n_neighbours"), F.aggregate(F.map_values("stripe"), F.lit(0).cast("bigint"), lambda t, n: t + n).alias("n")),
    "cooccurrence_stripes": lambda s, d: counting.cooccurrence_stripes(_docs(s, d)),
    "pmi_marginals": lambda s, d: pmi.marginals(_english(s, d)),
    "pmi_pair_counts": lambda s, d: pmi.pair_counts(_english(s, d)),
    "pmi_conditional": lambda s, d: pmi.conditional(_english(s, d)),
    "pmi_pairs": lambda s, d: pmi.pmi_pairs(_english(s, d)),
    "pmi_stripes": lambda s, d: pmi.pmi_stripes(_english(s, d)),
    "pmi_pair_total": lambda s, d: pmi.pmi_pair_total(_english(s, d)),
    "pmi_top": lambda s, d: pmi.pmi_top(_english(s, d)),
    "pmi_top_for_term": lambda s, d: pmi.pmi_top_for_term(_english(s, d), TERM),
    "index_postings": lambda s, d: retrieval.postings_text(retrieval.segments(_docs(s, d))),
    "index_dgap": lambda s, d: retrieval.gaps(_docs(s, d)),
    "index_size_bytes": lambda s, d: retrieval.size_bytes(_docs(s, d)),
    "index_roundtrip": _roundtrip,
    "postings_lookup": lambda s, d: _stored_lookup(s, d, RARE_TERM),
    "postings_lookup_missing": lambda s, d: _stored_lookup(s, d, UNKNOWN_TERM),
    "tf_histogram": lambda s, d: retrieval.tf_histogram(_docs(s, d), HISTOGRAM_TERMS),
    **{n: (lambda s, d, q=q: retrieval.boolean(_lines(s, d), q)) for n, q in BOOLEAN.items()},
    "boolean_from_index": lambda s, d: retrieval.boolean_from_index(
        retrieval.term_frequencies(_lines(s, d), "docid", "line"), _lines(s, d), BOOLEAN["boolean_q2"]
    ),
    "hourly_counts_all": lambda s, d: temporal.hourly_counts(read_table(s, d, "events")),
    "hourly_counts_filtered": lambda s, d: temporal.hourly_counts_filtered(read_table(s, d, "events"), "event_type", FILTER),
    "hourly_counts_lines": lambda s, d: temporal.hourly_counts_of_lines(_message_lines(s, d), FILTER),
    "hourly_counts_substring": lambda s, d: temporal.hourly_counts_substring(temporal.as_messages(read_table(s, d, "events"))),
    "graph_adjacency": _graph_adjacency,
    "graph_from_text": _from_text,
    "graph_bad_numbers": lambda s, d: graph.bad_numbers(_adjacency_text(s, d)),
    "graph_counters": lambda s, d: graph.counters(*_g(s, d)),
    "graph_missing_structure": _missing,
    "graph_partition_range": _range,
    "graph_partition_hash": lambda s, d: graph.partition_hash(_nodes(s, d), PARTS),
    "graph_dump": _graph_dump,
    "pagerank_k": lambda s, d: _rounded(graph.pagerank(*_g(s, d), ITERATIONS)),
    "pagerank_mass": lambda s, d: _counters_of_rounds(s, d).select("iteration", "missing"),
    "pagerank_counters": _counters_of_rounds,
    "pagerank_top_n": lambda s, d: graph.top_n(_rounded(graph.pagerank(*_g(s, d), ITERATIONS)), TOP),
    "pagerank_converged": lambda s, d: graph.in_order(_rounded(graph.pagerank(*_g(s, d), tolerance=TOLERANCE))),
    "ppr_k": lambda s, d: _rounded(graph.personalized_pagerank(*_g(s, d), SOURCES, ITERATIONS)),
    "ppr_top_n": lambda s, d: graph.top_n_each(_rounded(graph.personalized_pagerank(*_g(s, d), SOURCES, ITERATIONS)), TOP),
    "ppr_converged": lambda s, d: graph.in_order(_rounded(graph.personalized_pagerank(*_g(s, d), SOURCES[:1], tolerance=TOLERANCE))),
    "ppr_dump": _ppr_dump,
    "weak_components": lambda s, d: graph.weak_components(*_g(s, d)),
}

_TOK = r"[^ \t\n\x0B\f\r]+"
_WORDS = f"words AS (SELECT unnest(regexp_extract_all(text, '{_TOK}')) AS term FROM documents)"
_LINES = """parts AS (SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, lang, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM parts)"""
_TOKS = f"toks AS (SELECT doc_id, line_no, regexp_extract_all(line, '{_TOK}') AS t FROM lines)"
_FLAT = "flat AS (SELECT doc_id, line_no, unnest(range(len(t))) AS i, unnest(t) AS w FROM toks)"
_COOC = f"""WITH {_LINES}, {_TOKS}, {_FLAT},
pairs AS (SELECT a.w AS w, b.w AS u, count(*) AS n FROM flat a JOIN flat b
  ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.i <> a.i AND b.i BETWEEN a.i - 2 AND a.i + 2 GROUP BY 1, 2)"""
_PMI = f"""WITH {_LINES},
sets AS (SELECT doc_id, line_no, list_distinct(regexp_extract_all(line, '{_TOK}')) AS t FROM lines WHERE lang = 'en'),
total AS (SELECT count(*) AS n_units FROM sets),
one AS (SELECT doc_id, line_no, unnest(t) AS term FROM sets),
df AS (SELECT term, count(*) AS df FROM one GROUP BY term),
few AS (SELECT one.* FROM one JOIN df USING (term) WHERE df >= {pmi.THRESHOLD}),
counted AS (SELECT a.term AS x, b.term AS y, count(*) AS c_xy FROM few a JOIN few b
  ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.term < b.term GROUP BY 1, 2 HAVING count(*) >= {pmi.THRESHOLD}),
scored AS (SELECT x, y, c_xy, round(ln(c_xy::DOUBLE * n_units / (dx.df::DOUBLE * dy.df)), 6) AS pmi
  FROM counted JOIN df dx ON dx.term = x JOIN df dy ON dy.term = y CROSS JOIN total)"""
_TF = f"""WITH words AS (SELECT doc_id AS docid, unnest(regexp_extract_all(text, '{_TOK}')) AS term FROM documents),
tf AS (SELECT term, docid, count(*)::INTEGER AS tf FROM words GROUP BY 1, 2),
gaps AS (SELECT term, docid, docid - lag(docid, 1, 0) OVER (PARTITION BY term ORDER BY docid) AS gap, tf FROM tf)"""
_POSTINGS = f"SELECT term, docid // {retrieval.SPAN} AS segment, count(*) AS df, string_agg(docid || ':' || tf, ' ' ORDER BY docid) AS postings FROM tf"


def _length(v: str) -> str:
    return f"CASE WHEN {v} <= 127 THEN 1 WHEN {v} <= 255 THEN 2 WHEN {v} <= 65535 THEN 3 WHEN {v} <= 16777215 THEN 4 ELSE 5 END"


def _boolean_sql(query: str) -> str:
    def sql(tree) -> str:
        if isinstance(tree, str):
            return f"coalesce(bool_or(w = '{tree}'), false)"
        return f"({sql(tree[1])} {tree[0]} {sql(tree[2])})"

    return f"""WITH {_LINES}, {_TOKS}, {_FLAT},
    hit AS (SELECT doc_id, line_no FROM flat GROUP BY 1, 2 HAVING {sql(retrieval.parse_postfix(query))})
    SELECT doc_id * 1000000 + line_no AS docid, line FROM hit JOIN lines USING (doc_id, line_no)"""


def _hourly_sql(where: str = "true") -> str:
    return f"""SELECT month(ts) || '/' || strftime(ts, '%d') AS date, strftime(ts, '%H') AS hour, count(*) AS n
    FROM events WHERE month(ts) IN (1, 2) AND {where} GROUP BY 1, 2"""


_GRAPH = """nodes AS (SELECT p_partkey AS id FROM part),
edges AS (SELECT src, dst FROM (SELECT l_partkey AS src,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst
  FROM lineitem WHERE l_discount >= 0.09) WHERE dst IS NOT NULL),
degree AS (SELECT src, count(*) AS d FROM edges GROUP BY src), size AS (SELECT count(*) AS n FROM nodes)"""


def _pagerank_sql(k: int, last: str, trace: bool = False) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS p FROM nodes, size)"]
    for i in range(1, k + 1):
        steps.append(f"""m{i} AS MATERIALIZED (SELECT nodes.id, coalesce(x.m, 0) AS m FROM nodes LEFT JOIN
          (SELECT dst AS id, sum(p / d) AS m FROM r{i - 1} JOIN edges ON src = id JOIN degree USING (src) GROUP BY dst) x USING (id)),
        l{i} AS MATERIALIZED (SELECT greatest(0, 1 - sum(m)) AS missing FROM m{i}),
        r{i} AS MATERIALIZED (SELECT id, 0.15 / n + 0.85 * (m + missing / n) AS p FROM m{i}, l{i}, size)""")
    if trace:
        last = " UNION ALL ".join(f"SELECT {i} AS iteration, round(missing, 8) AS missing FROM l{i}" for i in range(1, k + 1))
    return f"WITH {_GRAPH}, {', '.join(steps)} {last}"


def _ppr_sql(k: int, sources: list[int], last: str) -> str:
    steps = [f"s(source) AS (VALUES {', '.join(f'({x}::BIGINT)' for x in sources)})",
             "r0 AS MATERIALIZED (SELECT source, id, (id = source)::INTEGER::DOUBLE AS p FROM nodes, s)"]
    for i in range(1, k + 1):
        steps.append(f"""m{i} AS MATERIALIZED (SELECT s.source, nodes.id, coalesce(x.m, 0) AS m FROM nodes CROSS JOIN s LEFT JOIN
          (SELECT source, dst AS id, sum(p / d) AS m FROM r{i - 1} JOIN edges ON src = id JOIN degree USING (src) GROUP BY 1, 2) x
          ON x.source = s.source AND x.id = nodes.id),
        l{i} AS MATERIALIZED (SELECT source, greatest(0, 1 - sum(m)) AS missing FROM m{i} GROUP BY source),
        r{i} AS MATERIALIZED (SELECT source, id, CASE WHEN id = source THEN 0.15 + 0.85 * (m + missing) ELSE 0.85 * m END AS p
          FROM m{i} JOIN l{i} USING (source))""")
    return f"WITH {_GRAPH}, {', '.join(steps)} {last}"


def _settled(keys: str) -> str:
    """The ranks of the first round in which none moved more than the tolerance."""
    moves = " UNION ALL ".join(f"SELECT {i} AS k, max(abs(a.p - coalesce(b.p, 0))) AS moved FROM r{i} a LEFT JOIN r{i - 1} b USING ({keys})" for i in range(1, ROUNDS + 1))
    ranks = " UNION ALL ".join(f"SELECT {i} AS k, {keys}, p FROM r{i}" for i in range(1, ROUNDS + 1))
    return f", moves AS ({moves}), last AS (SELECT min(k) AS k FROM moves WHERE moved <= {TOLERANCE}) SELECT {keys}, p::FLOAT::DOUBLE AS p FROM ({ranks}) JOIN last USING (k)"


_TOP_EACH = f"""SELECT source, id, p, rank FROM (SELECT source, id, p::FLOAT::DOUBLE AS p,
  row_number() OVER (PARTITION BY source ORDER BY p::FLOAT::DOUBLE DESC, id)::INTEGER AS rank FROM r{ITERATIONS}) WHERE rank <= {TOP}"""

ORACLES: dict[str, str] = {
    "word_count": f"WITH {_WORDS} SELECT term, count(*) AS n FROM words GROUP BY term",
    "vocabulary_stats": f"WITH {_WORDS} SELECT count(*) AS n_tokens, count(DISTINCT term) AS n_terms, min(term) AS first_term, max(term) AS last_term FROM words",
    "term_count": f"WITH {_WORDS} SELECT '{TERM}' AS term, count(*) AS n FROM words WHERE term = '{TERM}'",
    "bigram_count": f"""WITH {_LINES}, {_TOKS}, {_FLAT} SELECT a.w || '_' || b.w AS bigram, count(*) AS n FROM flat a JOIN flat b
      ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.i = a.i + 1 GROUP BY 1""",
    "cooccurrence_pairs": f"{_COOC} SELECT w, u, n FROM pairs",
    "cooccurrence_maps": f"{_COOC} SELECT w, count(*)::INTEGER AS n_neighbours, sum(n)::BIGINT AS n FROM pairs GROUP BY w",
    "cooccurrence_stripes": f"{_COOC} SELECT w, string_agg(u || ':' || n, ' ' ORDER BY u) AS stripe FROM pairs GROUP BY w",
    "pmi_marginals": f"{_PMI} SELECT term, df FROM df",
    "pmi_pair_counts": f"{_PMI} SELECT x, y, c_xy FROM counted",
    "pmi_conditional": f"{_PMI} SELECT x, y, round(c_xy / df, 6) AS p_y_given_x FROM counted JOIN df ON term = x",
    "pmi_pairs": f"{_PMI} SELECT x, y, c_xy, pmi FROM scored",
    "pmi_stripes": f"{_PMI} SELECT x, string_agg(y || ':' || format('{{:.6f}}', pmi), ' ' ORDER BY y) AS stripe FROM scored GROUP BY x",
    "pmi_pair_total": f"{_PMI} SELECT count(*) AS n_pairs FROM counted",
    "pmi_top": f"{_PMI} SELECT x, y, c_xy, pmi FROM scored ORDER BY pmi DESC, x, y LIMIT 10",
    "pmi_top_for_term": f"""{_PMI} SELECT '{TERM}' AS term, CASE WHEN x = '{TERM}' THEN y ELSE x END AS partner, pmi
      FROM scored WHERE x = '{TERM}' OR y = '{TERM}' ORDER BY pmi DESC, partner LIMIT 3""",
    "index_postings": f"{_TF} {_POSTINGS} GROUP BY 1, 2",
    "index_dgap": f"{_TF} SELECT term, docid, gap, tf FROM gaps",
    "index_size_bytes": f"{_TF} SELECT coalesce(sum({_length('gap')} + {_length('tf')}), 0)::BIGINT AS n_bytes FROM gaps",
    "index_roundtrip": f"{_TF} SELECT term, docid, tf FROM tf",
    "postings_lookup": f"{_TF} {_POSTINGS} WHERE term = '{RARE_TERM}' GROUP BY 1, 2",
    "postings_lookup_missing": f"{_TF} {_POSTINGS} WHERE term = '{UNKNOWN_TERM}' GROUP BY 1, 2",
    "tf_histogram": f"{_TF} SELECT term, tf, count(*) AS n FROM tf WHERE term IN ('the', 'of') GROUP BY 1, 2",
    **{n: _boolean_sql(q) for n, q in BOOLEAN.items()},
    "boolean_from_index": _boolean_sql(BOOLEAN["boolean_q2"]),
    "hourly_counts_all": _hourly_sql(),
    "hourly_counts_filtered": _hourly_sql(f"regexp_matches(event_type, '{FILTER}')"),
    "hourly_counts_lines": f"""SELECT CASE WHEN event_id % 89 = 0 THEN 'malformed' ELSE month(ts) || '/' || strftime(ts, '%d') END AS date,
      CASE WHEN event_id % 89 <> 0 THEN strftime(ts, '%H') END AS hour, count(*) AS n
      FROM events WHERE event_id % 89 = 0 OR (month(ts) IN (1, 2) AND regexp_matches(event_type, '{FILTER}')) GROUP BY 1, 2""",
    "hourly_counts_substring": "SELECT month(ts) || '/' || strftime(ts, '%d %H') AS day_hour, count(*) AS n FROM events WHERE month(ts) IN (1, 2) GROUP BY 1",
    "graph_adjacency": f"""WITH {_GRAPH} SELECT id, coalesce(string_agg(dst::VARCHAR, ' ' ORDER BY dst), '') AS adj
      FROM nodes LEFT JOIN edges ON src = id GROUP BY id""",
    "graph_from_text": f"""WITH {_GRAPH} SELECT id, coalesce(string_agg(dst::VARCHAR, ' ' ORDER BY dst), '') AS adj
      FROM nodes LEFT JOIN edges ON src = id WHERE id % 97 <> 0 GROUP BY id""",
    "graph_bad_numbers": "SELECT count_if(p_partkey % 97 = 0)::BIGINT AS n_lines, 0::BIGINT AS n_neighbours FROM part",
    "graph_counters": f"""WITH {_GRAPH} SELECT count(*) AS n_nodes, coalesce(sum(d), 0)::BIGINT AS n_edges, count(d) AS n_active,
      count(*) - count(d) AS n_dangling FROM nodes LEFT JOIN degree ON src = id""",
    "graph_missing_structure": f"WITH {_GRAPH} SELECT dst AS id, count(*) AS messages FROM edges WHERE dst NOT IN (SELECT id FROM nodes WHERE id % 10 <> 3) GROUP BY dst",
    "graph_partition_range": f"SELECT p_partkey AS id, (p_partkey * {PARTS} // (SELECT count(*) FROM part)) % {PARTS} AS part FROM part",
    "graph_partition_hash": f"SELECT p_partkey AS id, p_partkey % {PARTS} AS part FROM part",
    "graph_dump": f"""WITH {_GRAPH}, lists AS (SELECT id, list(dst ORDER BY dst) FILTER (dst IS NOT NULL) AS adj FROM nodes LEFT JOIN edges ON src = id GROUP BY id)
      SELECT id, format('{{{{{{}} {{:.4f}} [{{}}]}}}}', id, 1.0::DOUBLE / n, coalesce(array_to_string(adj[1:10], ', '), '')) AS node FROM lists, size""",
    "pagerank_k": _pagerank_sql(ITERATIONS, f"SELECT id, p::FLOAT::DOUBLE AS p FROM r{ITERATIONS}"),
    "pagerank_mass": _pagerank_sql(ITERATIONS, "", trace=True),
    "pagerank_top_n": _pagerank_sql(ITERATIONS, f"SELECT id, p::FLOAT::DOUBLE AS p FROM r{ITERATIONS} ORDER BY p::FLOAT::DOUBLE DESC, id LIMIT {TOP}"),
    "pagerank_converged": _pagerank_sql(ROUNDS, _settled("id")),
    "pagerank_counters": f"""SELECT * FROM ({_pagerank_sql(ITERATIONS, "", trace=True)}) CROSS JOIN (WITH {_GRAPH} SELECT (SELECT n FROM size) AS nodes, count(*) AS edges,
      count(*) AS messages, count(DISTINCT (src, dst)) AS sent, count(DISTINCT dst) AS received, 0::BIGINT AS lost FROM edges)""",
    "ppr_k": _ppr_sql(ITERATIONS, SOURCES, f"SELECT source, id, p::FLOAT::DOUBLE AS p FROM r{ITERATIONS}"),
    "ppr_top_n": _ppr_sql(ITERATIONS, SOURCES, _TOP_EACH),
    "ppr_converged": _ppr_sql(ROUNDS, SOURCES[:1], _settled("source, id")),
    "ppr_dump": _ppr_sql(ITERATIONS, SOURCES, f""", ps AS (SELECT id, string_agg(format('{{:.4f}}', p::FLOAT::DOUBLE), ', ' ORDER BY source) AS ps FROM r{ITERATIONS} GROUP BY id),
      lists AS (SELECT id, string_agg(dst::VARCHAR, ', ' ORDER BY dst) AS adj FROM nodes LEFT JOIN edges ON src = id GROUP BY id)
      SELECT id, '{{' || id || ' [' || ps || '] [' || coalesce(adj, '') || ']}}' AS node FROM ps JOIN lists USING (id)"""),
    "weak_components": f"""WITH RECURSIVE {_GRAPH}, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
      reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT b, root FROM reach JOIN both_ways ON a = id WHERE root < b)
      SELECT id, min(root) AS component FROM reach GROUP BY id""",
}
