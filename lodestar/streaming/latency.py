"""The one rolling measure of the reference workload, as a stream (an extra: nothing else there is a stream).

Latencies arrive as events; each time window reports nearest-rank percentiles once it has enough samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_percentiles(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes", least: int = 100) -> DataFrame:
    """events: ts, value. Windows with least samples or more; state is dropped after the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count("value").alias("n"), F.percentile_approx("value", [0.5, 0.95, 0.99], 10_000).alias("p"))
    return w.where(F.col("n") >= least).select(F.col("window.start").alias("start"), "n", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"))
