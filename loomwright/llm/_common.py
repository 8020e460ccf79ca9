"""Helpers that the operators of this subpackage share: tables, folders, text mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import ship

#: Rows handed on to Spark at once by the mapping functions below.
ROWS_OUT = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only Spark's readers touch the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """Shuffle width of the session, at least 2 per core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """True for documents whose crc32(doc_id as text) has this remainder; a null id is never held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def map_rows(
    df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str, rows: int = ROWS_OUT
) -> DataFrame:
    """Apply a Python function to each row, Arrow batch by Arrow batch.

    ``make`` runs once per task and returns the function of one row's values; this function
    returns one output tuple. Output goes out in small batches, so memory follows the rows.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                out = [function(*values) for values in zip(*(c.to_pylist() for c in part.columns))]
                columns = zip(*out) if out else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow
                )

    return df.mapInArrow(run, schema)


def settled(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does when the driver's garbage goes."""
    import gc
    import time

    gc.collect()
    time.sleep(0.2)  # the wrappers' release reaches the JVM by another thread
    spark.sparkContext._jvm.System.gc()
    if not spark.sparkContext.master.startswith("local["):
        time.sleep(1)  # executors delete the files by and by; the next step should not lie beside them
