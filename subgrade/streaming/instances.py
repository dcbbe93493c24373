"""Summaries of instance points as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def running_stats(points: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """By event time window and instance: number and mean height. Rows later than `late` are left out."""
    return points.withWatermark("ts", late).groupBy(F.window("ts", window), "instance").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"))
