"""An optional streaming form of the weighted profile (an extension of ours)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_profile(rows: DataFrame, time: str, by: list[str], value: str, weight: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, by, n, weight, weighted_sum): mergeable sums per tumbling window with a watermark; works on streams and tables."""
    kept = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0)).withWatermark(time, late)
    return kept.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), F.sum(F.col(value) * F.col(weight)).alias("weighted_sum"))
