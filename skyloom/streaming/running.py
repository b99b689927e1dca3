"""Structured Streaming forms of the additive aggregates: an extension, the batch engine needs none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_mean(samples: DataFrame, stamp: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, cell, value, n) of a stream of (stamp, cell, v, w): weighted means in event-time windows; samples
    later than ``late`` behind the newest are dropped, and a window is final once the watermark passes it."""
    w = F.coalesce(F.col("w"), F.lit(1.0))
    g = samples.withWatermark(stamp, late).groupBy(F.window(stamp, window), "cell")
    out = g.agg((F.sum(F.col("v") * w) / F.greatest(F.sum(w), F.lit(1e-12))).alias("value"), F.count("v").alias("n"))
    return out.select(F.col("window.start").alias("start"), "cell", "value", "n")
