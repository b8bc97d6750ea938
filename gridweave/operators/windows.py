"""Sliding windows over chunked frames, samples and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridweave.functions.scalar import unit_random
from gridweave.operators.framed import CHUNK, framed, plain, positions
from gridweave.operators.order import _summed, in_ranges, numbered, running, with_quantiles
from gridweave.sources.scratch import written


def window_index(frame: DataFrame, seq: int, pred: int, stride: int, seconds: int, valid: str = "valid_for_training", by: Sequence[str] = ("chunk_id",), core: str | None = "is_core") -> DataFrame:
    """Starts of gap-free windows of seq + pred valid rows: positions and times of both segments.

    Positions count from 0 in each partition of by; only starts that are core count, at positions that stride divides.
    """
    length = seq + pred
    order = Window.partitionBy(*by).orderBy("ts")
    ahead = order.rowsBetween(0, length - 1)
    rows = frame.withColumns({"_pos": F.row_number().over(order) - 1, "_step": F.unix_seconds("ts") - F.lag(F.unix_seconds("ts")).over(order)})
    rows = rows.withColumn("_bad", (F.coalesce(F.col("_step"), F.lit(seconds)) != seconds).cast("int"))
    after = order.rowsBetween(1, length - 1)
    ok = (F.sum(F.col(valid).cast("int")).over(ahead) == length) & (F.coalesce(F.sum("_bad").over(after), F.lit(0)) == 0)
    times = {
        "input_end_time": F.lead("ts", seq - 1).over(order), "target_start_time": F.lead("ts", seq).over(order), "target_end_time": F.lead("ts", length - 1).over(order), "_ok": ok,
    }
    out = rows.withColumns(times).filter("_ok")
    if core:
        out = out.filter(core)
    out = out.filter(F.col("_pos") % stride == 0)
    pos = F.col("_pos")
    return out.select(
        *by, pos.alias("input_start_pos"), (pos + seq - 1).alias("input_end_pos"), (pos + seq).alias("target_start_pos"), (pos + length - 1).alias("target_end_pos"), (pos + length).alias("window_end_pos"),
        F.col("ts").alias("input_start_time"), "input_end_time", "target_start_time", "target_end_time",
    )


def strided_windows(df: DataFrame, width: int, step: int, values: Sequence[str], by: Sequence[str], ts: str = "ts", chunk: int = CHUNK) -> DataFrame:
    """Every step-th start with the width rows from there, as arrays. A series may have any length."""
    rows = framed(df, by, [ts], 0, width - 1, lambda w: {f"{v}_window": F.collect_list(v).over(w.rowsBetween(0, width - 1)) for v in values}, chunk)
    return rows.filter((F.col("_pos") + width <= F.col("_n")) & (F.col("_pos") % step == 0)).select(*by, F.col("_pos").alias("start_pos"), F.col(ts).alias("start_ts"), *(f"{v}_window" for v in values))


def materialize(windows: DataFrame, frame: DataFrame, features: Sequence[str], seq: int, label: int, pred: int, seconds: int) -> DataFrame:
    """For each window and feature its seq_x (seq rows) and seq_y (label and pred rows).

    Rows are reached by time, and each feature has arrays of its own, so a window of many features is many rows. The
    frame is cut in stretches of a window's length, each with the one after it; a window's rows are cut out of the
    arrays of its stretch, so a row of the frame is shuffled twice however many windows have it.
    """
    length, span = seq + pred, (seq + pred) * seconds
    slot = lambda ts: F.unix_seconds(ts)
    long = frame.select("ts", F.explode(F.map_from_arrays(F.array(*(F.lit(f) for f in features)), F.array(*features))).alias("feature", "value"))
    own = F.floor(slot("ts") / span)
    near = long.withColumn("_b", F.explode(F.array(own, own - 1)))
    stretches = near.groupBy("_b", "feature").agg(F.sort_array(F.collect_list(F.struct(slot("ts").alias("t"), "value"))).alias("_r"))
    starts = windows.select(F.col("input_start_time").alias("origin"), F.floor(slot("input_start_time") / span).alias("_b"))
    begin = slot("origin")
    rows = F.filter("_r", lambda x: (x["t"] >= begin) & (x["t"] < begin + length * seconds) & (F.pmod(x["t"] - begin, F.lit(seconds)) == 0))
    both = starts.join(stretches, "_b").withColumn("_v", F.transform(rows, lambda x: x["value"])).filter(F.size("_v") > 0)
    return both.select("origin", "feature", F.slice("_v", 1, seq).alias("seq_x"), F.slice("_v", seq - label + 1, label + pred).alias("seq_y"))


def trailing_range(value: Column, rows: int, by: Sequence[str], ts: str = "ts") -> Column:
    frame = Window.partitionBy(*by).orderBy(ts).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) == rows, F.max(value).over(frame) - F.min(value).over(frame))


def history_delta(value: str, rows: int, by: Sequence[str], ts: str = "ts") -> Column:
    return F.col(value) - F.lag(value, rows).over(Window.partitionBy(*by).orderBy(ts))


def window_missing_fraction(missing: Column, rows: int, columns: int, by: Sequence[str], ts: str = "ts") -> Column:
    """Share of missing cells in the last rows rows."""
    return F.sum(missing).over(Window.partitionBy(*by).orderBy(ts).rowsBetween(-(rows - 1), 0)) / (rows * columns)


def moving_average(value: str, width: int, order: WindowSpec) -> Column:
    """Centred mean of an odd width over a window of framed(); beyond an end of the series its value is repeated."""
    half = width // 2
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A row so near to an end that it repeats it has that end in its chunk's halo.
    before, after = F.greatest(half - F.col("_pos"), F.lit(0)), F.greatest(F.col("_pos") + half - (F.col("_n") - 1), F.lit(0))
    return (F.sum(value).over(order.rowsBetween(-half, half)) + before * F.first(value).over(whole) + after * F.last(value).over(whole)) / width


def decompose(df: DataFrame, value: str, widths: Sequence[int], by: Sequence[str], ts: str = "ts", chunk: int = CHUNK) -> DataFrame:
    """Adds trend, the mean of moving averages of all widths, and remainder. A series may have any length."""
    half = max(widths) // 2
    rows = framed(df, by, [ts], half, half, lambda w: {"trend": sum((moving_average(value, k, w) for k in widths), F.lit(0.0)) / len(widths)}, chunk)
    return plain(rows).withColumn("remainder", F.col(value) - F.col("trend"))


def smooth3(df: DataFrame, origin: DataFrame, by: Sequence[str] = ("window_id", "target")) -> DataFrame:
    """Forecasts averaged over three steps, the last observation standing in for steps before the first."""
    before = origin.select(*by, F.explode(F.array(F.lit(-1), F.lit(0))).alias("horizon"), F.col("y0").alias("yhat"))
    rows = df.select(*by, "horizon", "yhat").unionByName(before)
    smooth = F.avg("yhat").over(Window.partitionBy(*by).orderBy("horizon").rowsBetween(-2, 0))
    return rows.withColumn("smooth", smooth).filter("horizon > 0")


def interpolate_linear(df: DataFrame, value: str, by: Sequence[str], ts: str = "ts") -> Column:
    """The column's values, missing ones on the line between their neighbours, beyond the ends the nearest."""
    order = Window.partitionBy(*by).orderBy(ts)
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col(value).isNotNull(), F.struct(F.unix_micros(ts).alias("t"), F.col(value).alias("v")))
    a, b, t = F.last(point, ignorenulls=True).over(back), F.first(point, ignorenulls=True).over(ahead), F.unix_micros(ts)
    line = a["v"] + (b["v"] - a["v"]) * F.try_divide(t - a["t"], b["t"] - a["t"])
    return F.coalesce(F.col(value), line, a["v"], b["v"])


def block_mean(df: DataFrame, value: str, size: int, by: Sequence[str], ts: str = "ts") -> DataFrame:
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(ts)) - 1
    return df.withColumn("block", F.floor(pos / size)).groupBy(*by, "block").agg(F.avg(value).alias(value))


def every_kth(df: DataFrame, k: int, by: Sequence[str], ts: str = "ts") -> DataFrame:
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(ts)) - 1
    return df.withColumn("_pos", pos).filter(F.col("_pos") % k == 0).drop("_pos")


def insample_window(values: Column, length: int, at: Column | None = None) -> Column:
    """(values, mask): the last length values, or those before position at, zeros before a shorter series."""
    cut = values if at is None else F.slice(values, F.lit(1), at)
    last = F.slice(cut, F.greatest(F.size(cut) - length + 1, F.lit(1)), F.lit(length))
    missing = F.lit(length) - F.size(last)
    return F.struct(F.concat(F.array_repeat(F.lit(0.0), missing), last).alias("values"), F.concat(F.array_repeat(F.lit(0), missing), F.transform(last, lambda _: F.lit(1))).alias("mask"))


def random_cut(values: Column, seed: int, *keys: str) -> Column:
    """A cut point from 1 to the length, which follows from seed and keys."""
    return F.floor(unit_random(seed, *keys) * F.size(values)).cast("int") + 1


def validate_windows(windows: DataFrame, seq: int, pred: int, seconds: int) -> DataFrame:
    """Windows whose lengths, contiguity or times are wrong: all of them are looked at."""
    span = F.unix_seconds("target_end_time") - F.unix_seconds("input_start_time")
    ok = (F.col("input_end_pos") - F.col("input_start_pos") == seq - 1) & (F.col("target_start_pos") == F.col("input_end_pos") + 1) & (F.col("target_end_pos") - F.col("target_start_pos") == pred - 1) & (span == (seq + pred - 1) * seconds)
    return windows.filter(~ok)


def prefix_of(origins: DataFrame, series: DataFrame, length: int, origin: str = "origin_ts", ts: str = "ts", by: Sequence[str] = ()) -> DataFrame:
    """Each origin with the rows of (origin - length seconds, origin] and, if given, of its own by: history only.

    A range join by buckets of length seconds: an origin looks at its bucket and the one before.
    """
    o = origins.withColumn("_b", F.explode(F.array(*(F.floor(F.unix_seconds(origin) / length) - k for k in (0, 1)))))
    s = series.withColumn("_b", F.floor(F.unix_seconds(ts) / length))
    t, end = F.unix_micros(ts), F.unix_micros(origin)
    return o.join(s, [*by, "_b"]).filter((t <= end) & (t > end - length * 1_000_000)).drop("_b")


def last_of(origins: DataFrame, series: DataFrame, rows: int, by: Sequence[str], order: Sequence[str] = (), origin: str = "origin_ts", ts: str = "ts") -> DataFrame:
    """Each origin with the last rows of its series up to it, however many there are before.

    Rows of one time go by order. Origins are put in one order with the rows, so the rows before them tell their place,
    and the places before it are looked up: work goes with the rows and origins, not with how long a history is.
    """
    point = series.filter(F.col(ts).isNotNull()).select(*by, F.col(ts).alias("_t"), F.lit(1).alias("_one"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.struct(*series.columns).alias("_row"))
    asked = origins.filter(F.col(origin).isNotNull()).select(*by, F.col(origin).alias("_t"), F.lit(0).alias("_one"), F.struct(*origins.columns).alias("_origin"))
    marks = point.unionByName(asked, allowMissingColumns=True).withColumn("_asks", 1 - F.col("_one"))
    placed = _summed(in_ranges(marks, [*by, "_t", "_asks", *(f"_o{k}" for k in range(len(order)))]), "_at", "_one", "_place", by)
    looks = placed.filter((F.col("_one") == 0) & (F.col("_place") > 0)).select(*by, "_origin", F.explode(F.sequence(F.greatest(F.col("_place") - rows, F.lit(0)), F.col("_place") - 1)).alias("_place"))
    found = looks.join(placed.filter("_one = 1").select(*by, "_place", "_row"), [*by, "_place"])
    return found.select("_origin.*", *(F.col("_row")[c].alias(c) for c in series.columns if c not in by))


# Selections


def linspace_sample(df: DataFrame, n: int, order: Sequence[str], total: int) -> DataFrame:
    """n rows evenly spaced over the total of df, first and last among them."""
    picks = df.sparkSession.range(n).select(F.expr(f"id * {total - 1} div {max(n - 1, 1)}").alias("_pos")).distinct()
    return numbered(df, order, "_pos").join(picks, "_pos", "left_semi").drop("_pos")


def stride_sample(df: DataFrame, stride: int, by: Sequence[str], order: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return df.withColumn("_pos", pos).filter(F.col("_pos") % stride == 0).drop("_pos")


def nonoverlapping(windows: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """(by, start, end): windows taken in order, if they start after the last one taken ends; start and end as whole numbers.

    Each window points to the first one that starts after its end, found by counting starts in one order of starts and
    ends. The windows that pointers lead to from the first are marked by doubling: each round knows twice as many
    steps, so rounds go with the logarithm of what is taken, and no task follows a series of windows alone. Without
    by the windows are one timeline.
    """
    rows = windows.select(*by, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).filter("s is not null and e is not null").distinct()
    rows = positions(rows, by, ["s", "e"])
    # At each instant the starts so far; an end reads those up to itself.
    marks = rows.select(*by, F.col("s").alias("t"), F.lit(1).alias("d")).unionByName(rows.select(*by, F.col("e").alias("t"), F.lit(0).alias("d")))
    marks = running(marks.groupBy(*by, "t").agg(F.sum("d").alias("d")), "t", F.col("d"), "_less", by).select(*by, F.col("t").alias("e"), (F.col("_less") + F.col("d")).alias("next"))
    pointed = written(rows.join(marks, [*by, "e"]).select(*by, "s", "e", "_pos", F.when(F.col("next") < F.col("_n"), F.col("next")).alias("next")), "pointed")
    keys = [*by, "_pos"]
    taken = pointed.filter("_pos = 0").select(*keys)
    jumps = pointed.filter("next is not null").select(*keys, "next")
    while not jumps.isEmpty():
        further = taken.join(jumps, keys).select(*by, F.col("next").alias("_pos"))
        taken = written(taken.unionByName(further), "taken")
        on = jumps.select(*by, F.col("_pos").alias("next"), F.col("next").alias("_after"))
        jumps = written(jumps.join(on, [*by, "next"]).select(*keys, F.col("_after").alias("next")), "jumps")
    return pointed.join(taken, keys, "left_semi").select(*by, F.col("s").alias(start), F.col("e").alias(end))


def greedy_nonoverlap(windows: DataFrame, most: int, start: str = "start", end: str = "end", by: str | None = "chunk_id") -> DataFrame:
    """Windows of each chunk (or of all) taken in order, if they start after the last one taken ends; then most of them, evenly."""
    keys = [by] if by else []
    kept = positions(nonoverlapping(windows, keys, start, end), keys, [start])
    # The place of the i-th of most is i * (n - 1) div (most - 1); the least i that reaches a place must give it.
    gaps = max(most - 1, 1)
    i = F.expr(f"(_pos * {gaps} + _n - 2) div greatest(_n - 1, 1)")
    even = (F.col("_n") <= most) | ((i < most) & (F.floor(i * (F.col("_n") - 1) / gaps) == F.col("_pos")))
    return kept.filter(even).select(*keys, start, end)


def representative(df: DataFrame, value: str, q: float, by: Sequence[str], tie: str) -> DataFrame:
    """For each group the row whose value is nearest to its quantile q; ties go to the smallest tie."""
    near = with_quantiles(df, value, {"_q": q}, by).withColumn("_d", F.round(F.abs(F.col(value) - F.col("_q")), 9))
    return near.groupBy(*by).agg(F.min_by(F.struct(tie, value), F.struct("_d", tie)).alias("_r")).select(*by, "_r.*")


def worst_case(df: DataFrame, value: str, by: Sequence[str], tie: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(F.struct(tie, value), F.struct(value, -F.col(tie).cast("long"))).alias("_r")).select(*by, "_r.*")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def limit_samples(df: DataFrame, limit: float, seed: int, *keys: str) -> DataFrame:
    """A random part of df that follows from seed and keys: limit rows if it is more than 1, else that share."""
    if limit > 1:
        return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(int(limit))
    return df.filter(unit_random(seed, *keys) < limit)


def limit_windows(manifest: DataFrame, most: int) -> DataFrame:
    """Chunks (chunk_id, windows) with the windows that each gives until most are reached."""
    run = F.sum("windows").over(Window.orderBy("chunk_id"))  # one row a chunk
    rows = manifest.withColumn("offset", run - F.col("windows"))
    return rows.withColumn("used", F.greatest(F.least("windows", most - F.col("offset")), F.lit(0))).filter("used > 0")


def shuffle_by_chunk(windows: DataFrame, seed: int, epoch: int, key: str) -> DataFrame:
    """Windows in an order that seed and epoch decide, those of a chunk together."""
    return windows.orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), "chunk_id"), "chunk_id", F.xxhash64(F.lit(seed), F.lit(epoch), key))
