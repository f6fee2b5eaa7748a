"""Live cost ledger over an arriving call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_cost(calls: DataFrame, ts: str = "ts", cost: str = "cents", window: str = "1 day",
                  late: str = "1 hour") -> DataFrame:
    """Calls and cost per phase and window; a window is final, and its state
    dropped, once the watermark has passed its end. State is one small row per
    phase and open window, folded map-side, so a hot phase costs nothing extra."""
    return (calls.withWatermark(ts, late).groupBy(F.window(ts, window), "phase")
            .agg(F.count("*").alias("calls"), F.sum(cost).alias("spent"))
            .select(F.col("window.start").alias("window_start"), "phase", "calls", "spent"))


def running_cost(calls: DataFrame, cost: str = "cents") -> DataFrame:
    """Cost per phase since the start, for update or complete mode."""
    return calls.groupBy("phase").agg(F.count("*").alias("calls"), F.sum(cost).alias("spent"))
