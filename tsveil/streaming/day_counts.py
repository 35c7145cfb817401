"""An extension: daily event counts per user as a stream, which a batch read turns into the user-day series table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsveil.sources.series import DAYS, FIRST_DAY, SeriesTable


def daily_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(user_id, day, n, errors) of a stream of events (ts, user_id, event_type); a day is final once the watermark passes it."""
    found = (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "user_id")
        .agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    )
    return found.select("user_id", F.to_date("window.start").alias("day"), "n", "errors")


def series_of(days: DataFrame) -> SeriesTable:
    """The user-day series table of daily counts, each day of a user once."""
    at = F.datediff("day", F.lit(FIRST_DAY).cast("date"))
    rows = days.select("user_id", at.alias("d"), "n", "errors")
    counts = [F.sum(F.when(F.col("d") == k, F.col("n")).otherwise(0)).cast("double") for k in range(DAYS)]
    out = rows.groupBy("user_id").agg(F.sum("errors").alias("sensitive"), F.array(*counts).alias("series"))
    return SeriesTable(out.select(F.col("user_id").alias("id"), "sensitive", "series"), DAYS)
