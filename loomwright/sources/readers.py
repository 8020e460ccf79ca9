"""Sources and sinks: text, byte-offset text, tab-separated messages, graphs, sorted indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MESSAGE_SCHEMA = "id string, timestamp string, user string, message string"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_lines(spark: SparkSession, path: str, min_split: int | None = None) -> DataFrame:
    """(value): lines of text files; gzip by suffix. ``min_split``: bytes that one task reads at least, where there are as many."""
    if min_split:
        widen_splits(spark, min_split)
    return spark.read.text(path)


def widen_splits(spark: SparkSession, least: int) -> None:
    """From now on the session's scans take splits of ``least`` bytes or more, where there are as many."""
    now = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(now, least)))
    spark.conf.set("spark.sql.files.minPartitionNum", "1")


#: Suffixes of files whose bytes are not those of their lines.
COMPRESSED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst", ".xz")
#: Offsets of the files of a folder lie so far apart.
FILE_SPAN = 1 << 44


def read_lines_with_offset(spark: SparkSession, path: str) -> DataFrame:
    """(docid, line): each line under the byte offset of its first byte.

    Lines end in LF, or CR LF. In a folder the k-th file by name (from 0) begins at k * ``FILE_SPAN``,
    so no two lines share an id. Offsets are sums of line lengths: first those of a file's blocks (a
    row a block), then inside each block, so a file of any size is as many tasks as it has blocks.
    Compressed files are refused: their offsets would lead nowhere.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    if refused := [f for f in text.inputFiles() if f.endswith(COMPRESSED)]:
        raise ValueError(f"offsets need files that are not compressed, not {refused[0]}")
    size = F.octet_length("value") + 1
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = text.select(*at, F.monotonically_increasing_id().alias("turn"), "value", size.alias("size"))
    # no more rows than blocks of the files
    blocks = text.select(*at, size.alias("size")).groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = (F.dense_rank().over(Window.orderBy("file")) - 1).cast("bigint") * FILE_SPAN
    blocks = blocks.select("file", "block", (base + F.coalesce(before, F.lit(0))).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("file", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(blocks, ["file", "block"])
    return placed.select((F.col("base") + F.col("inside")).alias("docid"), F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")).alias("line"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Four strings a line, separated by tabs, without quoting; missing fields are null."""
    return spark.read.schema(MESSAGE_SCHEMA).options(sep="\t", quote="", escape="", mode="PERMISSIVE").csv(path)


def write_pairs(df: DataFrame, path: str) -> None:
    """Text sink: the columns separated by tabs; an existing output is replaced."""
    text = F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns])
    df.select(text.alias("value")).write.mode("overwrite").text(path)


def write_index(index: DataFrame, path: str, parts: int | None = None) -> None:
    """Index sink, range-partitioned and sorted by term: lookups prune by the files' statistics."""
    width = parts or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index.repartitionByRange(width, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
