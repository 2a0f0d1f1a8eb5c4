"""Event counts by tumbling window, over a stream or a table alike: on a stream the watermark bounds the state, on a table
it has no effect. An addition: the reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, by: list[str], value: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(by, start, n, total) of each window; rows without a time are in none."""
    # A watermark needs a time with a zone; the result goes back to one without.
    rows = events.withColumn(at, F.col(at).cast("timestamp")).filter(F.col(at).isNotNull()).withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), *by)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*by, F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")
