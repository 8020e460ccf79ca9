"""Every query against its DuckDB statement on the smallest tables."""

import pytest

from loomwright.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, rows_of, name):
    assert rows_of(catalog.QUERIES[name](spark, SF)) == duck(catalog.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"x", "y", "c_xy", "pmi"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
