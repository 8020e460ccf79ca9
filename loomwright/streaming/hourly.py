"""The hourly count as a stream: tumbling one-hour windows with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(events: DataFrame, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """(start, n) of a streaming (or finished) table of events."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "n")
