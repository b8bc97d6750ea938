"""From points to a regular grid, and from the grid to wide frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.scalar import finite


def bucket_end(ts: Column, seconds: int) -> Column:
    """The end of the right-closed bucket that holds ts; exact, and right before 1970 too."""
    us = F.unix_micros(ts)
    return F.timestamp_micros(us + F.pmod(-us, F.lit(seconds * 1_000_000)))


def resample(points: DataFrame, seconds: int, expected: int | None = None, distinct_seconds: bool = False) -> DataFrame:
    """(point_code, ts, value, raw_count): means over right-closed buckets.

    With expected, a bucket of another number of rows has a null value; distinct_seconds counts each second once,
    so that a repeated one can't stand for a missing one. Values that are not finite are not there.
    """
    rows = points.filter(finite(F.col("value"))).withColumn("_bucket", bucket_end(F.col("ts"), seconds))
    count = F.count_distinct(F.date_trunc("second", "ts")) if distinct_seconds else F.count("*")
    out = rows.groupBy("point_code", F.col("_bucket").alias("ts")).agg(F.avg("value").alias("_mean"), count.alias("raw_count"))
    value = F.col("_mean") if expected is None else F.when(F.col("raw_count") == expected, F.col("_mean"))
    return out.select("point_code", "ts", value.alias("value"), "raw_count")


def resample_report(long: DataFrame) -> DataFrame:
    return long.groupBy("point_code").agg(
        F.count("*").alias("rows"), F.count("value").alias("non_null"), (1 - F.count("value") / F.count("*")).alias("missing_rate"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def to_wide(long: DataFrame, codes: Sequence[str]) -> DataFrame:
    """One row an instant that any point has. The codes are given, so no job looks for them."""
    return long.filter(F.col("point_code").isin(list(codes))).groupBy("ts").pivot("point_code", list(codes)).agg(F.first("value"))


def audit_wide(points: DataFrame, seconds: int, codes: Sequence[str]) -> DataFrame:
    return to_wide(resample(points, seconds), codes)


def to_long(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ts, point_code, value), nulls kept."""
    return wide.unpivot("ts", list(columns), "point_code", "value")


def to_map(long: DataFrame) -> DataFrame:
    """One row an instant with a map of all points: for more points than columns bear."""
    return long.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("point_code", "value"))).alias("points"))


def dedupe(df: DataFrame, keys: Sequence[str], order: str, last: bool = True) -> DataFrame:
    """One row a key: the last, or the first, in order."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def halo_chunks(df: DataFrame, seconds: int, back: int, forward: int, ts: str = "ts") -> DataFrame:
    """df with chunk_id and is_core: each row in its own chunk, and in those whose halo it is in.

    Chunks are seconds long and know back seconds before them and forward after them. Windows partitioned by chunk_id
    then run in parallel over a timeline that has no other key, and are right for the rows that are core.
    """
    at = F.unix_seconds(ts)
    first, last = F.floor((at - forward) / seconds), F.floor((at + back) / seconds)
    spread = df.withColumn("chunk_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return spread.withColumn("is_core", F.floor(F.unix_seconds(ts) / seconds) == F.col("chunk_id"))


def core(df: DataFrame) -> DataFrame:
    return df.filter("is_core")
