"""Materialized steps in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Spark deletes a statement's shuffle files as it ends; else they lie there until the driver's garbage goes.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Shuffled files of a join's side, each partition, up to which Spark looks up the other side's rows in it, not sorting both.
_LOOKED_UP, _LOOKUP_BYTES = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent and the session runs on this machine alone (a ``local`` master, as
    in tests) a temporary folder is used, which goes when the program ends. On a cluster the setting
    is needed: executors do not share a machine's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir names no shared folder, and {master} has executors on other machines")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="steps-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, label: str, lookup: bool = False) -> DataFrame:
    """Write and read again: the plan ends here, and a lost executor costs nothing written.

    The shuffle files of the plan go with it: nothing reads them but the statement that wrote them.
    ``discard`` removes what was written once nothing reads it any more. With ``lookup`` joins do
    not sort where all partitions of a side, once shuffled, are small.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    wanted = {_CLEANUP: "true"} | ({_LOOKED_UP: _LOOKUP_BYTES} if lookup else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*steps: DataFrame) -> None:
    """Remove the files of ``stored`` steps whose readers have all been written themselves."""
    for step in steps:
        if path := getattr(step, "_stored_at", None):
            remove_dir(step.sparkSession, path)
