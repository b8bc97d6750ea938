"""Chronological splits, purging, reconciliation with manifests. Manifests have one row a chunk."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.order import numbered


def manifest(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """chunk_id, rows, core_rows, valid_rows, windows, core_start, core_end."""
    core = F.col("is_core")
    a = frames.groupBy("chunk_id").agg(
        F.count("*").alias("rows"), F.count_if(core).alias("core_rows"), F.count_if(core & F.col("valid_for_training")).alias("valid_rows"), F.min(F.when(core, F.col("ts"))).alias("core_start"), F.max(F.when(core, F.col("ts"))).alias("core_end")
    )
    b = windows.groupBy("chunk_id").agg(F.count("*").alias("windows"))
    return a.join(b, "chunk_id", "left").withColumn("windows", F.coalesce("windows", F.lit(0)))


def split_chunks(chunks: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """split by the windows so far: train up to its share, test from the end of val's on, val between."""
    order = Window.orderBy("core_start")
    rows = chunks.filter("windows > 0").withColumns({"_cum": F.sum("windows").over(order), "_all": F.sum("windows").over(Window.partitionBy())})
    split = F.when(F.col("_cum") <= F.col("_all") * train, "train").when(F.col("_cum") - F.col("windows") >= F.col("_all") * (train + val), "test").otherwise("val")
    return rows.withColumn("split", split).drop("_cum", "_all")


def purge(chunks: DataFrame, p: int) -> DataFrame:
    """split with p chunks on each side of a boundary relabelled purge; the second boundary is found after the first."""
    rows = chunks.withColumn("_i", F.row_number().over(Window.orderBy("core_start")))
    for split in ("train", "val"):
        last = F.max(F.when(F.col("split") == split, F.col("_i"))).over(Window.partitionBy())
        rows = rows.withColumn("_last", last).withColumn("split", F.when((F.col("_i") > F.col("_last") - p) & (F.col("_i") <= F.col("_last") + p), "purge").otherwise(F.col("split"))).drop("_last")
    return rows.drop("_i")


def split_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("split").agg(F.count("*").alias("chunks"), F.sum("windows").alias("windows"), F.min("core_start").alias("first_core"), F.max("core_end").alias("last_core"))


def ratio_split(n: int, seq: int, train: float = 0.7, test: float = 0.2, retrain: bool = False, least: int = 0) -> dict[str, tuple[int, int]]:
    """Row ranges [from, to): val and test reach back seq rows; too short a val is made longer at train's cost."""
    n_train, n_test = int(n * train), int(n * test)
    n_val = n - n_train - n_test
    if retrain:
        n_train, n_val = n - n_test, 0
    elif n_val < least:
        n_train, n_val = n_train - (least - n_val), least
    return {"train": (0, n_train), "val": (max(n_train - seq, 0), n_train + n_val) if n_val else (n_train, n_train), "test": (max(n - n_test - seq, 0), n)}


def fixed_split(per_month: int, seq: int, months: Sequence[int] = (12, 4, 4)) -> dict[str, tuple[int, int]]:
    a, b, c = (m * 30 * per_month for m in months)
    return {"train": (0, a), "val": (a - seq, a + b), "test": (a + b - seq, a + b + c)}


def in_ranges(df: DataFrame, ranges: dict[str, tuple[int, int]], pos: str) -> DataFrame:
    """One row for each range that the position is in."""
    hits = [F.when((F.col(pos) >= a) & (F.col(pos) < b), F.lit(k)) for k, (a, b) in ranges.items()]
    return df.withColumn("split", F.explode(F.array_compact(F.array(*hits))))


def segment_split(df: DataFrame, val: float, test: float, least: int) -> DataFrame:
    """df (segment, ts): all segments but the last are train; the last is cut into train, val and test.

    It is an error if the last segment's val or test would have fewer than least rows.
    """
    last = df.agg(F.max("segment")).first()[0]
    n = df.filter(F.col("segment") == last).count()
    n_val, n_test = int(n * val), int(n * test)
    if min(n_val, n_test) < least:
        raise ValueError("the last segment is too short")
    pos = F.row_number().over(Window.partitionBy("segment").orderBy("ts"))
    split = F.when(F.col("segment") != last, "train").when(pos > n - n_test, "test").when(pos > n - n_test - n_val, "val").otherwise("train")
    return df.withColumn("split", split)


def tail_split(n: int, share: float = 0.2) -> dict[str, tuple[int, int]]:
    cut = n - int(n * share)
    return {"train": (0, cut), "val": (cut, n)}


def calibration_split(df: DataFrame, order: str, share: float = 0.4) -> DataFrame:
    """df with part: calibration for the first share of the distinct values of order, evaluation for the others; nulls go."""
    values = numbered(df.select(order).filter(F.col(order).isNotNull()).distinct(), [order], "_i")
    last = values.filter(F.col("_i") == math.floor(values.count() * share) - 1).select(order).first()
    calibration = F.col(order) <= F.lit(last[0]).cast(df.schema[order].dataType) if last else F.lit(False)
    return df.filter(F.col(order).isNotNull()).withColumn("part", F.when(calibration, "calibration").otherwise("evaluation"))


def select_chunks(df: DataFrame, chunks: DataFrame, gap: int = 1) -> DataFrame:
    """df with part for the chunks (chunk_id): the first half calibration, the second replication, gap chunks between gone."""
    placed = chunks.select("chunk_id").distinct().withColumns({"_i": F.row_number().over(Window.orderBy("chunk_id")), "_n": F.count("*").over(Window.partitionBy())})
    half = F.floor(F.col("_n") / 2)
    part = F.when(F.col("_i") <= half, "calibration").when(F.col("_i") > half + gap, "replication")
    return df.join(placed.select("chunk_id", part.alias("part")).filter("part is not null"), "chunk_id")


def validate_splits(chunks: DataFrame, splits: DataFrame) -> DataFrame:
    """(chunk_id, problem): split rows that the manifest doesn't know or knows otherwise, and chunks without a split."""
    a, b = chunks.select("chunk_id", F.col("windows").alias("_w")).alias("a"), splits.select("chunk_id", F.col("windows").alias("_v")).alias("b")
    both = a.join(b, F.col("a.chunk_id") == F.col("b.chunk_id"), "full")
    problem = F.when(F.col("_w").isNull(), "unknown").when(F.col("_v").isNull() & (F.col("_w") > 0), "missing").when(F.col("_w") != F.col("_v"), "outdated")
    return both.select(F.coalesce("a.chunk_id", "b.chunk_id").alias("chunk_id"), problem.alias("problem")).filter("problem is not null")
