"""The monthly and windowed series over streams, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """``(start, end, key, n)`` of tumbling or sliding windows; rows later than ``late`` are dropped by the watermark.  Works on streams and tables."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(span.alias("_w"), key).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """``(key, start, end, n)``: runs of events of a key with pauses shorter than ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("_w"), key).agg(F.count("*").alias("n")).select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """Each key once within the watermark; the basis of distinct counts over a stream."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over what is there, appends the finished windows to Parquet, and ends."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def closing_row(events: DataFrame, time: str, after: str = "interval 10 years") -> DataFrame:
    """One row long after the last event, all else null: it moves the watermark beyond every window that holds events."""
    last = events.agg((F.max(time) + F.expr(after)).alias(time))
    return last.select(*(F.col(c) if c == time else F.lit(None).cast(t).alias(c) for c, t in events.dtypes))
