"""Hourly counts of messages and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = (1, 2)


def parse_messages(text: DataFrame) -> DataFrame:
    """Lines (value) of tab-separated id, timestamp, user, message -> fields; what is missing is null."""
    part = F.split("value", "\t")
    return text.select(*[F.get(part, i).alias(n) for i, n in enumerate(("id", "timestamp", "user", "message"))])


def message_time(timestamp: str | Column) -> Column:
    """``Sun Jan 23 00:05:00 +0000 2011`` -> timestamp; null if it does not read so."""
    return F.try_to_timestamp(F.substring(timestamp, 5, 26), F.lit("MMM dd HH:mm:ss Z yyyy"))


def hourly_counts(events: DataFrame, ts: str = "ts", months=MONTHS) -> DataFrame:
    """(date as M/dd, hour as HH, n) of rows in the given months (None: all); empty hours have no row."""
    kept = events if months is None else events.filter(F.month(ts).isin(list(months)))
    return kept.groupBy(F.date_format(ts, "M/dd").alias("date"), F.date_format(ts, "HH").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def hourly_counts_filtered(events: DataFrame, column: str, pattern: str, ts: str = "ts", months=MONTHS) -> DataFrame:
    """The same for rows whose ``column`` contains a match of ``pattern``; nulls do not."""
    return hourly_counts(events.filter(F.col(column).rlike(pattern)), ts, months)


def as_messages(events: DataFrame) -> DataFrame:
    """Events in the message layout: all strings."""
    stamp = F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    return events.select(F.col("event_id").cast("string").alias("id"), stamp.alias("timestamp"), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("message"))


#: Month names as they stand in the layout, and their numbers.
MONTH_NUMBERS = {"Jan": "1", "Feb": "2"}


def hourly_counts_substring(messages: DataFrame, pattern: str | None = None) -> DataFrame:
    """(day_hour, n) by cutting the timestamp's text: months named in ``MONTH_NUMBERS`` only."""
    kept = messages if pattern is None else messages.filter(F.col("message").rlike(pattern))
    month, day, hour = (F.substring("timestamp", a, n) for a, n in ((5, 3), (9, 2), (12, 2)))
    number = F.create_map(*[F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair])[F.col("month")]
    cut = kept.select(month.alias("month"), day.alias("day"), hour.alias("hour")).filter(F.col("month").isin(list(MONTH_NUMBERS)))
    return cut.groupBy(F.concat(number, F.lit("/"), "day", F.lit(" "), "hour").alias("day_hour")).agg(F.count(F.lit(1)).alias("n"))


def _guarded(line: str | Column = "value") -> Column:
    """True for lines with more than one field."""
    return F.size(F.split(line, "\t")) > 1


def malformed(text: DataFrame) -> DataFrame:
    """One row: lines without a tab, which no count includes."""
    return text.filter(~_guarded()).agg(F.count(F.lit(1)).alias("n_malformed"))


def hourly_counts_of_lines(text: DataFrame, pattern: str | None = None, months=MONTHS) -> DataFrame:
    """(date, hour, n) of message lines (value), and in the same pass a row (``malformed``, null, n) where lines lack fields."""
    part = F.split("value", "\t")
    rows = text.select(F.get(part, 1).alias("timestamp"), F.get(part, 3).alias("message"), (~_guarded()).alias("bad")).withColumn("ts", message_time("timestamp"))
    counted = F.lit(True) if pattern is None else F.coalesce(F.col("message").rlike(pattern), F.lit(False))
    if months is not None:
        counted &= F.coalesce(F.month("ts").isin(list(months)), F.lit(False))
    date, hour = F.when(F.col("bad"), "malformed").otherwise(F.date_format("ts", "M/dd")), F.when(~F.col("bad"), F.date_format("ts", "HH"))
    return rows.filter(F.col("bad") | counted).groupBy(date.alias("date"), hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
