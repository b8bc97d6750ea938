"""Intervals from flags, flags from intervals, and the training mask.

Windows over a timeline are partitioned by the columns in by: chunk_id from halo_chunks, or a series id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.framed import CHUNK, framed, plain, summed
from gridweave.operators.grid import halo_chunks
from gridweave.operators.order import running
from gridweave.operators.quality import low_candidates, row_valid_rate


def stitched(pieces: DataFrame, max_gap: int, by: Sequence[str] = ()) -> DataFrame:
    """Pieces (start_time, end_time, rows) joined where the gap is at most max_gap seconds.

    There are few pieces: one a chunk and interval.
    """
    w = Window.partitionBy(*by).orderBy("start_time")
    gap = F.unix_micros("start_time") - F.lag(F.unix_micros("end_time")).over(w)
    numbered = pieces.withColumn("_new", F.coalesce((gap > max_gap * 1_000_000).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    return numbered.groupBy(*by, "_run").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("rows").alias("rows")).drop("_run")


def intervals(df: DataFrame, flag: str, max_gap: int, min_duration: int, reason: str, by: Sequence[str] = (), ts: str = "ts", chunk: int | None = None) -> DataFrame:
    """Runs of true rows: start_time, end_time (closed), rows, duration_seconds, reason.

    A gap of more than max_gap seconds ends a run, one of exactly that doesn't. Runs shorter than min_duration go.
    Without a series id in by, chunk seconds of the timeline are worked on at a time and their runs joined.
    """
    hits = df.filter(flag)
    keys = list(by)
    if chunk:
        hits, keys = hits.withColumn("_chunk", F.floor(F.unix_seconds(ts) / chunk)), [*by, "_chunk"]
    w = Window.partitionBy(*keys).orderBy(ts)
    gap = F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(w)
    numbered = hits.withColumn("_new", F.coalesce((gap > max_gap * 1_000_000).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    runs = numbered.groupBy(*keys, "_run").agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.count("*").alias("rows")).drop("_run")
    if chunk:
        runs = stitched(runs.drop("_chunk"), max_gap, by)
    seconds = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6
    return runs.withColumns({"duration_seconds": seconds, "reason": F.lit(reason)}).filter(F.col("duration_seconds") >= min_duration)


def interval_mask(df: DataFrame, spans: DataFrame, name: str, ts: str = "ts") -> DataFrame:
    """df with a boolean: ts is in one of spans (closed).

    A sweep: a span is 1 at its start and -1 after its end, and an instant is inside where the sum so far is above 0. A
    span is two rows, however long it is, and however many others it overlaps.
    """
    good = spans.filter(F.col("start_time") <= F.col("end_time"))
    at = lambda c, d, seen: good.select(c.alias("_t"), F.lit(d).alias("_d"), F.lit(seen).alias("_seen"))
    instants = df.select(F.unix_micros(ts).alias("_t"), F.lit(0).alias("_d"), F.lit(True).alias("_seen")).filter("_t is not null")
    events = at(F.unix_micros("start_time"), 1, False).unionByName(at(F.unix_micros("end_time") + 1, -1, False)).unionByName(instants)
    events = running(events.groupBy("_t").agg(F.sum("_d").alias("_d"), F.max("_seen").alias("_seen")), "_t", F.col("_d"), "_open")
    inside = events.filter(F.col("_seen") & (F.col("_open") + F.col("_d") > 0)).select("_t", F.lit(True).alias(name))
    return df.join(inside, F.unix_micros(ts) == F.col("_t"), "left").withColumn(name, F.coalesce(name, F.lit(False))).drop("_t")


def persistent(df: DataFrame, flag: str, seconds: int, grid: int, name: str, chunk: int) -> DataFrame:
    """df with a boolean: the flag holds for at least seconds there, gaps up to 1.5 grid steps bridged."""
    runs = intervals(df, flag, int(1.5 * grid), seconds, name, chunk=chunk)
    return interval_mask(df, runs, name)


def rolling_mean_centered(value: Column, width: int, by: Sequence[str], ts: str = "ts") -> Column:
    """Mean of width rows around; a third of them must be there."""
    frame = Window.partitionBy(*by).orderBy(ts).rowsBetween(-(width - 1 - (width - 1) // 2), (width - 1) // 2)
    return F.when(F.count(value).over(frame) >= max(1, width // 3), F.avg(value).over(frame))


def expand_mask(flag: Column, rows: int, by: Sequence[str], ts: str = "ts") -> Column:
    return F.max(flag).over(Window.partitionBy(*by).orderBy(ts).rowsBetween(-rows, rows))


def expand_mask_seconds(flag: Column, seconds: int, by: Sequence[str], ts: str = "ts") -> Column:
    return F.max(flag).over(Window.partitionBy(*by).orderBy(F.unix_seconds(ts)).rangeBetween(-seconds, seconds))


def low_share(long: DataFrame, cuts: DataFrame) -> DataFrame:
    """(ts, low_share): share of the candidate columns that are at or below their cut."""
    return long.join(cuts.select("point_code", "low_cut"), "point_code").groupBy("ts").agg(F.avg((F.coalesce("value", F.lit(float("inf"))) <= F.col("low_cut")).cast("int")).alias("low_share"))


def common_low(long: DataFrame, width: int, threshold: float, max_gap: int, min_duration: int, chunk: int, grid: int, least: int = 5, per_chunk: bool = False) -> DataFrame:
    """Intervals in which most columns are low together; none if fewer than least columns qualify."""
    cuts = low_candidates(long)
    n = cuts.count()
    shares = low_share(long, cuts)
    half = width * grid
    chunked = halo_chunks(shares, chunk, half, half)
    smooth = chunked.withColumn("smooth", rolling_mean_centered(F.col("low_share"), width, ["chunk_id"])).filter("is_core")
    flagged = smooth.withColumn("low", (F.col("smooth") >= threshold) & F.lit(n >= least))
    return intervals(flagged, "low", max_gap, min_duration, "common_low", chunk=chunk)


def excluded_intervals(wide: DataFrame, columns: Sequence[str], indicators: dict[str, float], limit: float, grid: int, duration: int, chunk: int, strict: bool = True) -> DataFrame:
    """Intervals with too much missing at once, and those with a shutdown indicator below its threshold."""
    missing = 1 - row_valid_rate(columns)
    out = intervals(wide.withColumn("_f", missing > limit if strict else missing >= limit), "_f", int(1.5 * grid), 0, "collective_missing", chunk=chunk)
    for name, low in indicators.items():
        out = out.unionByName(intervals(wide.withColumn("_f", F.coalesce(F.col(name) < low, F.lit(False))), "_f", int(1.5 * grid), duration, f"shutdown:{name}", chunk=chunk))
    return out


def invalid_intervals(mask: DataFrame, grid: int, chunk: int, flag: str = "valid_for_training") -> DataFrame:
    return intervals(mask.withColumn("_f", ~F.col(flag)), "_f", int(1.5 * grid), 0, "invalid", chunk=chunk)


def training_mask(
    wide: DataFrame, required: Sequence[str], targets: Sequence[str], optional: Sequence[str] = (), indicators: dict[str, float] | None = None, grid: int = 10, duration: int = 0, buffer_rows: int = 0,
    chunk: int = 86_400, low_spans: DataFrame | None = None,
) -> DataFrame:
    """wide with the reasons and valid_for_training.

    Every required column and every target must be there; no indicator may be below its threshold for duration
    seconds or more, no row may be in low_spans, nor within buffer_rows of such a row. A target can't be optional.
    """
    if both := set(optional) & set(targets):
        raise ValueError(f"targets can't be optional: {sorted(both)}")
    need = [c for c in required if c not in optional]
    out = wide.withColumns({"model_valid_rate": row_valid_rate(need), "collective_missing_rate": 1 - row_valid_rate(need), "bad_missing": row_valid_rate(need) < 1, "bad_target": row_valid_rate(list(targets)) < 1})
    reasons = []
    for name, low in (indicators or {}).items():
        out = persistent(out.withColumn("_low", F.coalesce(F.col(name) < low, F.lit(False))), "_low", duration, grid, f"bad_shutdown_{name}", chunk).drop("_low")
        reasons.append(f"bad_shutdown_{name}")
    if low_spans is not None:
        out = interval_mask(out, low_spans, "bad_common_low")
        reasons.append("bad_common_low")
    operational = F.lit(False)
    for r in reasons:
        operational = operational | F.col(r)
    out = out.withColumn("bad_operational", operational)
    if buffer_rows and reasons:
        around = halo_chunks(out, chunk, buffer_rows * grid, buffer_rows * grid)
        out = around.withColumn("bad_operational", expand_mask(F.col("bad_operational"), buffer_rows, ["chunk_id"])).filter("is_core").drop("chunk_id", "is_core")
    return out.withColumn("valid_for_training", ~(F.col("bad_missing") | F.col("bad_target") | F.col("bad_operational")))


def coverage(windows: DataFrame, start: str, end: str, seconds: int, by: Sequence[str] = ()) -> DataFrame:
    """Distinct grid instants that any window covers, and hours, by starts and ends rather than by instants."""
    events = windows.select(*by, F.unix_seconds(start).alias("_t"), F.lit(1).alias("_d")).unionByName(windows.select(*by, (F.unix_seconds(end) + seconds).alias("_t"), F.lit(-1).alias("_d")))
    events = events.groupBy(*by, "_t").agg(F.sum("_d").alias("_d"))
    steps = running(events, "_t", F.col("_d"), "_open", by)
    # What is covered is the ends of covered stretches less their begins.
    begins, ends = (F.col("_open") == 0) & (F.col("_d") > 0), (F.col("_open") > 0) & (F.col("_open") + F.col("_d") == 0)
    covered = F.coalesce(F.sum(F.when(ends, F.col("_t")).when(begins, -F.col("_t")).otherwise(0)), F.lit(0))
    return steps.groupBy(*by).agg(F.floor(covered / seconds).alias("instants"), (covered / 3600).alias("hours"), (covered / (F.max("_t") - F.min("_t"))).alias("fraction"))


def union_reports(parts: Sequence[DataFrame]) -> DataFrame:
    """Fragments of reports, columns that one lacks null, what halos reported twice once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.distinct()


def segments(df: DataFrame, gap: int, by: Sequence[str] = (), ts: str = "ts", chunk: int = CHUNK) -> DataFrame:
    """df with the number of its segment: a gap of more than gap seconds begins one. A series may have any length."""
    rows = framed(df, by, [ts], 1, 0, lambda w: {"_step": F.unix_micros(ts) - F.lag(F.unix_micros(ts)).over(w)}, chunk)
    begins = F.coalesce((F.col("_step") > gap * 1_000_000).cast("int"), F.lit(0))
    return plain(summed(rows, by, begins, "segment")).drop("_step")
