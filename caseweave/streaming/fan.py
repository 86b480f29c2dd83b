"""Fan-in over a stream of transfers: an extension beyond the batch rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fan_in_stream(transfers: DataFrame, window: str = "2 hours", slide: str = "30 minutes", lateness: str = "1 hour", least: int = 8) -> DataFrame:
    """account, start, end, sources of sliding windows in which an account had enough (approximately counted) sources."""
    w = transfers.withWatermark("ts", lateness).groupBy(F.window("ts", window, slide).alias("w"), F.col("dst").alias("account"))
    out = w.agg(F.approx_count_distinct("src", 0.02).alias("sources")).filter(F.col("sources") >= least)
    return out.select("account", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "sources")
