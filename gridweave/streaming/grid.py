"""The grid over a stream of points.

Buckets close when the watermark passes them; then each is emitted once. Batch and stream give the same rows for
points that are not later than the watermark allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.scalar import finite


def resample_stream(points: DataFrame, seconds: int, late: str, expected: int | None = None) -> DataFrame:
    """Streaming form of resample: (point_code, ts, value, raw_count) in append mode.

    Spark's windows are closed on the left; shifted by a microsecond they are closed on the right.
    """
    rows = points.filter(finite(F.col("value"))).withColumn("_at", F.timestamp_micros(F.unix_micros("ts") - 1))
    grouped = rows.withWatermark("_at", late).groupBy("point_code", F.window("_at", f"{seconds} seconds").alias("_w")).agg(F.avg("value").alias("_mean"), F.count("*").alias("raw_count"))
    value = F.col("_mean") if expected is None else F.when(F.col("raw_count") == expected, F.col("_mean"))
    return grouped.select("point_code", F.col("_w.end").alias("ts"), value.alias("value"), "raw_count")

