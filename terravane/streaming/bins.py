"""Bins over a stream of points: windowed counts and coordinate sums per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.vec3 import cells


def windowed_bins(points: DataFrame, shape: tuple, time: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """window start, gx, gy, gz, n and the centroid of the points of each time window;
    rows later than ``late`` behind the newest are dropped, which bounds the state.
    Works alike on a batch DataFrame."""
    placed = points.withWatermark(time, late) if points.isStreaming else points
    placed = placed.withColumns(cells(shape))
    grouped = placed.groupBy(F.window(time, window).alias("w"), "gx", "gy", "gz")
    made = grouped.agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in "xyz"])
    return made.select(F.col("w.start").alias("start"), "gx", "gy", "gz", "n", "x", "y", "z")
