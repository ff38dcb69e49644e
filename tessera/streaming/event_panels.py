"""Panels from event tables, in batch or from a stream: tumbling windows of a unit's values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, unit: str, ts: str, value: str, width: str = "1 day", lateness: str | None = None) -> DataFrame:
    """(unit, time, y, n_events): sums by unit and window. On a stream, ``lateness`` sets the watermark after which a
    window is final; the plan is the same for both."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need instants
    rows = rows.withWatermark(ts, lateness) if lateness else rows
    grouped = rows.groupBy(F.window(ts, width).alias("w"), F.col(unit).alias("unit")).agg(F.sum(value).alias("y"), F.count(F.lit(1)).alias("n_events"))
    return grouped.select("unit", F.col("w.start").alias("time"), "y", "n_events")


def write_panel(events: DataFrame, path: str, checkpoint: str, unit: str, ts: str, value: str, width: str = "1 day", lateness: str = "1 hour"):
    """Append finished windows of a stream to a Parquet panel; exactly once, by the checkpoint."""
    panel = windowed(events, unit, ts, value, width, lateness)
    return panel.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
