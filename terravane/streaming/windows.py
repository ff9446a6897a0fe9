"""An extension: the per-cell statistics of ``operators.ndvi.monthly`` over a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_statistics(events: DataFrame, key: str, value: str, ts: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean, min, max and deviation by key and tumbling window; rows later than ``late`` are dropped on a stream."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    v = F.col(value)
    out = rows.groupBy(F.window(ts, window).alias("w"), key).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("stddev"))
    return out.select(F.col("w.start").alias("start"), key, "mean", "min", "max", "stddev")
