"""Streams of detections: pairs in a time range, and counts of windows, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_in_range(left: DataFrame, right: DataFrame, key: str, time: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Rows of two streams with equal keys and times at most so far apart; state is dropped once no such pair can come.

    On tables this is a plain join with the same rows.
    """
    a = left.select(*[F.col(c).alias(f"{c}_a") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"{c}_b") for c in right.columns])
    if left.isStreaming:
        a, b = a.withWatermark(f"{time}_a", late), b.withWatermark(f"{time}_b", late)
    near = F.col(f"{time}_b").between(F.col(f"{time}_a") - F.expr(f"INTERVAL {seconds} SECONDS"), F.col(f"{time}_a") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return a.join(b, (F.col(f"{key}_a") == F.col(f"{key}_b")) & near)


def windowed(events: DataFrame, time: str, value: str, by: list[str], size: str, late: str = "10 minutes") -> DataFrame:
    """Count and sum of each window and key."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    out = e.groupBy(F.window(time, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")
