"""A stored step leaves its rows behind, and none of the shuffle files that its plan wrote."""

import os
import time

import pytest
from pyspark.sql import functions as F

from loomwright.functions import storage


def _shuffled(spark) -> set[str]:
    tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in tops for _, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}


def test_shuffle_files_go_with_the_step(spark):
    before = _shuffled(spark)
    df = spark.range(100000).groupBy((F.col("id") % 5000).alias("k")).count()
    step = storage.stored(df, "test")
    until = time.time() + 10
    while (left := _shuffled(spark) - before) and time.time() < until:
        time.sleep(0.1)  # files go by another thread
    assert not left
    # the frame can be planned anew, and the step read again
    assert df.count() == step.count() == 5000 and {r["count"] for r in step.collect()} == {20}
    storage.discard(step)


@pytest.mark.parametrize("own", [None, "false", "true"])
def test_the_session_keeps_its_setting(spark, own):
    held = spark.conf.get(storage._CLEANUP, None)
    try:
        spark.conf.unset(storage._CLEANUP) if own is None else spark.conf.set(storage._CLEANUP, own)
        now = spark.conf.get(storage._CLEANUP, None)
        storage.discard(storage.stored(spark.range(3), "test"))
        assert spark.conf.get(storage._CLEANUP, None) == now
        with pytest.raises(Exception):
            storage.stored(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), "test")
        assert spark.conf.get(storage._CLEANUP, None) == now
    finally:
        spark.conf.unset(storage._CLEANUP) if held is None else spark.conf.set(storage._CLEANUP, held)
