import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Rows of SQL over a data folder, as (sorted columns, sorted rows)."""
    import duckdb

    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def run(sql: str, folder: str = "/root/testdata/sf0.001"):
        con = duckdb.connect()
        for n in names:
            con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
        found = con.execute(sql)
        return same([c[0] for c in found.description], found.fetchall())

    return run


def same(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    return sorted(columns), sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="session")
def rows_of():
    return lambda df: same(df.columns, [tuple(r) for r in df.collect()])
