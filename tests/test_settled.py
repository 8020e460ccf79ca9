"""A run to convergence goes on until it has settled, however many rounds the SQL lays out."""

import pytest

from loomwright.operators import graph


def test_a_long_chain_settles_after_30_rounds(spark):
    # 0 -> 1 -> ... -> 79: the front carries 0.85 ** k, below 1e-4 after 57 rounds
    nodes, edges = spark.range(80), spark.range(79).selectExpr("id src", "id + 1 dst")
    found = {r.id: r.p for r in graph.personalized_pagerank(nodes, edges.coalesce(1), [0], tolerance=1e-4).collect()}
    assert len(found) == 80 and sum(found.values()) == pytest.approx(1)
    assert all(found[k] == pytest.approx(0.15 * 0.85**k) for k in range(57)) and found[57] > 0 and found[58] == 0
