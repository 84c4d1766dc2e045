"""Live rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_metrics(df: DataFrame, seconds: int = 60, delay: str = "1 day", ts: str = "ts", n_bytes: str = "n_bytes") -> DataFrame:
    """Records and bytes per namespace and time window.

    Run it in update mode: each batch then writes only the windows it changed,
    and windows older than ``delay`` leave the state.
    """
    windows = df.withWatermark(ts, delay).groupBy("namespace", F.window(ts, f"{seconds} seconds").alias("w"))
    return windows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(n_bytes), F.lit(0)).alias("n_bytes")
    ).select("namespace", F.unix_millis(F.col("w.start")).alias("bucket_ms"), "n", "n_bytes")
