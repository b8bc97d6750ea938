"""Forecast tables: building, checking against frames, blending and correcting.

A forecast table has window_id, target, horizon, ts, y, yhat and y0, the last value observed.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forecasts(frame: DataFrame, windows: DataFrame, targets: Sequence[str], pred: int, seconds: int, model: Column | None = None) -> DataFrame:
    """A forecast table of windows (input_end_time) over frame; yhat is the model, an expression on the origin's row.

    model may use the target's values as the column value and those of the rows before as lag1 and lag2; the default
    is persistence.
    """
    long = frame.unpivot(["ts"], list(targets), "target", "value")
    origin = windows.select(F.col("input_end_time").alias("origin_ts"), F.unix_seconds("input_end_time").alias("window_id")).distinct()
    at = F.unix_micros("origin_ts")
    back = origin.select("window_id", "origin_ts", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("_k"))
    back = back.withColumn("ts", F.timestamp_micros(at - F.col("_k").cast("long") * (seconds * 1_000_000))).join(long, "ts")
    past = back.groupBy("window_id", "origin_ts", "target").agg(*(F.max(F.when(F.col("_k") == k, F.col("value"))).alias(n) for k, n in enumerate(("value", "lag1", "lag2"))))
    past = past.select("window_id", "origin_ts", "target", F.col("value").alias("y0"), (F.col("value") if model is None else model).alias("yhat"))
    steps = past.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(pred)))).withColumn("ts", F.timestamp_micros(at + F.col("horizon").cast("long") * (seconds * 1_000_000)))
    return steps.join(long.withColumnRenamed("value", "y"), ["ts", "target"]).select("window_id", "origin_ts", "target", "horizon", "ts", "y", "yhat", "y0")


def attach_origin(windows: DataFrame, frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """windows with the columns at the end of the input and, as <column>_first, at the first target row."""
    a = windows.join(frame.select(F.col("ts").alias("input_end_time"), *columns), "input_end_time")
    return a.join(frame.select(F.col("ts").alias("target_start_time"), *(F.col(c).alias(f"{c}_first") for c in columns)), "target_start_time")


def check_alignment(fc: DataFrame, frame: DataFrame, targets: Sequence[str], rtol: float = 1e-4, atol: float = 1e-4) -> DataFrame:
    """For each target how many first truths were compared and how many differ from the frame."""
    long = frame.unpivot(["ts"], list(targets), "target", "frame_value")
    both = fc.filter("horizon = 1").join(long, ["ts", "target"])
    off = F.abs(F.col("y") - F.col("frame_value")) > atol + rtol * F.abs("frame_value")
    return both.groupBy("target").agg(F.count("*").alias("compared"), F.count_if(off).alias("different"))


def compare_methods(methods: dict[str, DataFrame]) -> DataFrame:
    """Forecast tables one below the other, with their method."""
    parts = [df.withColumn("method", F.lit(k)) for k, df in methods.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grid_apply(fc: DataFrame, values: Sequence[float], name: str = "alpha") -> DataFrame:
    """Each row with each value of a grid that is given by hand."""
    return fc.withColumn(name, F.explode(F.array(*(F.lit(float(v)) for v in values))))


def blended(fc: DataFrame, weights: DataFrame) -> DataFrame:
    """yhat pulled towards y0 by weights (target, horizon, weight); no weight leaves it."""
    joined = fc.join(weights, ["target", "horizon"], "left")
    return joined.withColumn("yhat", F.col("y0") + F.coalesce("weight", F.lit(1.0)) * (F.col("yhat") - F.col("y0"))).drop("weight")


def bias_correct(fc: DataFrame, bias: DataFrame, keys: Sequence[str]) -> DataFrame:
    joined = fc.join(bias, list(keys), "left")
    return joined.withColumn("yhat", F.col("yhat") - F.coalesce("bias", F.lit(0.0))).drop("bias")


def interpolate_weights(knots: DataFrame, horizons: int) -> DataFrame:
    """(target, horizon, weight) for every horizon, on lines between knots, flat beyond them."""
    w = Window.partitionBy("target").orderBy("horizon")
    spans = knots.withColumns({"_h": F.lead("horizon").over(w), "_w": F.lead("weight").over(w), "_first": F.row_number().over(w) == 1})
    low = F.when(F.col("_first"), 1).otherwise(F.col("horizon"))
    high = F.coalesce(F.col("_h") - 1, F.lit(horizons))
    rows = spans.select("target", F.explode(F.sequence(low, high)).alias("h"), "horizon", "weight", "_h", "_w")
    part = F.coalesce(F.try_divide(F.col("h") - F.col("horizon"), F.col("_h") - F.col("horizon")), F.lit(0.0))
    weight = F.when(F.col("h") <= F.col("horizon"), F.col("weight")).otherwise(F.col("weight") + part * (F.coalesce("_w", "weight") - F.col("weight")))
    return rows.select("target", F.col("h").alias("horizon"), weight.alias("weight"))


#: Rows of history that the gate looks at, and those of its range.
GATE_ROWS, RANGE_ROWS = 61, 30


def stability(history: Column) -> Column:
    """Restlessness of the end of a history: range of the last rows or net change over all; null if a value is missing."""
    last = F.slice(history, -GATE_ROWS, GATE_ROWS)
    short = F.slice(history, -RANGE_ROWS, RANGE_ROWS)
    score = F.greatest(F.array_max(short) - F.array_min(short), F.abs(F.element_at(last, -1) - F.element_at(last, 1)))
    return F.when((F.size(history) >= GATE_ROWS) & ~F.exists(last, lambda x: x.isNull() | F.isnan(x)), score)


def gated_shrink(fc: DataFrame, history: DataFrame, threshold: float, end: int, seconds: int = 10) -> DataFrame:
    """Forecasts of calm windows pulled to the last value, less and less until end seconds ahead.

    history has window_id, target and the array history.
    """
    score = stability(F.col("history"))
    gate = F.when(score.isNotNull(), F.greatest(F.least(1 - score / threshold, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    rows = fc.join(history.select("window_id", "target", gate.alias("gate")), ["window_id", "target"], "left")
    ahead = F.col("horizon") * seconds
    taper = F.when(ahead < end, 0.5 * (1 + F.cos(pi * ahead / end))).otherwise(0.0)
    pull = F.coalesce("gate", F.lit(0.0)) * taper
    return rows.withColumn("yhat", F.when(ahead < end, F.col("yhat") + pull * (F.col("y0") - F.col("yhat"))).otherwise(F.col("yhat")))


def offset_correct(fc: DataFrame, usable: DataFrame, config: dict) -> DataFrame:
    """Forecasts shifted by kind: none, constant, anchor (decaying) or linear (in the state, ramped).

    usable (window_id, target, usable) tells which windows have what it takes; the others stay as they are.
    Options: bias, limit, decay, slope, center, ramp.
    """
    kind = config.get("kind", "none")
    if kind not in ("none", "constant", "anchor", "linear"):
        raise ValueError(f"no such correction: {kind}")
    limit = float(config.get("limit", float("inf")))
    if not limit > 0 or kind == "anchor" and not config.get("decay", 1.0) > 0:
        raise ValueError("limit and decay must be positive")
    rows = fc.join(usable, ["window_id", "target"], "left")
    w = Window.partitionBy("window_id", "target")
    first = F.min_by("yhat", "horizon").over(w)
    all_finite = F.count_if(F.col("yhat").isNull() | F.isnan("yhat")).over(w) == 0
    shift = {
        "none": F.lit(0.0),
        "constant": F.lit(float(config.get("bias", 0.0))),
        "anchor": F.col("y0") - first,
        "linear": float(config.get("slope", 0.0)) * (F.col("y0") - float(config.get("center", 0.0))) + float(config.get("bias", 0.0)),
    }[kind]
    shift = F.greatest(F.least(shift, F.lit(limit)), F.lit(-limit))
    if kind == "anchor":
        shift = shift * F.exp(-(F.col("horizon") - 1) / float(config.get("decay", 1.0)))
    if kind == "linear":
        shift = shift * F.least(F.col("horizon") / float(config.get("ramp", 1.0)), F.lit(1.0))
    good = F.coalesce("usable", F.lit(False)) & all_finite
    return rows.withColumn("yhat", F.when(good, F.col("yhat") + shift).otherwise(F.col("yhat"))).drop("usable")


#: Residuals that are folded in one array.
BLOCK = 256


def rolling_bias(fc: DataFrame, step: int, seconds: int, alpha: float, least: int = 6, limit: float = float("inf"), by: Sequence[str] = ("target", "horizon")) -> DataFrame:
    """Adds correction: the running mean of residuals that were known at the origin, once least of them are.

    The residual of the forecast made horizon steps before is known. A gap in the origins begins anew. Residuals are
    folded in blocks of BLOCK; a block turns the mean before it into a * mean + b, so blocks are joined by these pairs.
    """
    keys = [*by, "_run"]
    at = F.unix_seconds("origin_ts")
    order = Window.partitionBy(*by).orderBy(at)
    rows = fc.withColumn("_run", F.sum(F.coalesce((at - F.lag(at).over(order) > step * seconds).cast("int"), F.lit(0))).over(order))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(at)) - 1
    placed = rows.select(*keys, at.alias("_t"), (F.col("y") - F.col("yhat")).alias("_e"), place.alias("_i"))
    folded = placed.groupBy(*keys, F.expr(f"_i div {BLOCK}").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_i", "_t", "_e"))).alias("_x"))
    # The first residual of a run is its first mean.
    first = F.col("_b") == 0
    own = F.aggregate("_x", F.lit(0.0), lambda m, x: F.when(first & (x["_i"] == 0), x["_e"]).otherwise(m + alpha * (x["_e"] - m)))
    keep = F.pow(F.lit(1 - alpha), F.size("_x").cast("double"))
    chain = folded.select(*keys, "_b", own.alias("_own"), keep.alias("_keep")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", "_own", "_keep"))).alias("_all"))
    start = F.array(F.lit(0.0))
    before = F.aggregate("_all", start, lambda out, x: F.array_append(out, F.element_at(out, -1) * x["_keep"] + x["_own"]))
    entry = chain.select(*keys, F.posexplode(before).alias("_b", "_m"))
    means = folded.join(entry, [*keys, "_b"])
    begin = F.struct(F.col("_m").alias("m"), F.array().cast("array<double>").alias("all"))

    def fold(a: Column, x: Column) -> Column:
        m = F.when(x["_i"] == 0, x["_e"]).otherwise(a["m"] + alpha * (x["_e"] - a["m"]))
        return F.struct(m.alias("m"), F.array_append(a["all"], m).alias("all"))

    each = means.select(*keys, F.explode(F.arrays_zip("_x", F.aggregate("_x", begin, fold, lambda a: a["all"]).alias("all"))).alias("_z"))
    each = each.select(*keys, F.col("_z._x._t").alias("_t"), F.lit(0).alias("_kind"), F.struct(F.col("_z.all").alias("m"), (F.col("_z._x._i") + 1).alias("n")).alias("_known"))
    # Each forecast meets the last mean whose residual was known at its origin.
    asked = rows.select(*rows.columns, (at - F.col("horizon") * seconds).alias("_t"), F.lit(1).alias("_kind"))
    met = asked.unionByName(each, allowMissingColumns=True)
    known = F.last("_known", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    told = met.withColumn("_known", known).filter("_kind = 1")
    correction = F.when(F.col("_known.n") >= least, F.greatest(F.least(F.col("_known.m"), F.lit(limit)), F.lit(-limit))).otherwise(0.0)
    return told.withColumn("correction", correction).select(*fc.columns, "correction")


def fixed_lead_series(fc: DataFrame, horizon: int, width: str = "10 minutes") -> DataFrame:
    """Truth and forecast of one lead, averaged over left-closed windows of width."""
    rows = fc.filter(F.col("horizon") == horizon).groupBy("target", F.window("ts", width).alias("_w")).agg(F.avg("y").alias("y"), F.avg("yhat").alias("yhat"))
    return rows.select("target", F.col("_w.start").alias("ts"), "y", "yhat")


# Regimes


def trend_scenario(past: Column, future: Column, scale: Column) -> Column:
    limit = 0.1 * scale
    calm_past, calm_future = F.abs(past) < limit, F.abs(future) < limit
    return F.when(calm_past & calm_future, "small").when(calm_past, "emerging").when(calm_future, "fading").when(F.sign(past) == F.sign(future), "continuing").otherwise("reversing")


def event_groups(fc: DataFrame, scale: float, first: int = 6) -> DataFrame:
    """(window_id, target, net, rapid, event) by the change of truth at the end and within the first steps."""
    change = F.col("y") - F.col("y0")
    early = F.when(F.col("horizon") <= first, change)
    one = fc.groupBy("window_id", "target").agg(F.max_by(change, "horizon").alias("net"), F.max(early).alias("_up"), F.min(early).alias("_down"))
    limit = 0.1 * scale
    rapid = F.when(F.col("_up") >= scale, "rapid_rise").when(F.col("_down") <= -scale, "rapid_fall").otherwise("none")
    event = F.when(F.col("net") >= limit, "rising").when(F.col("net") <= -limit, "falling").otherwise("small")
    return one.select("window_id", "target", "net", rapid.alias("rapid"), event.alias("event"))


def history_group(delta: Column, limit: float) -> Column:
    return F.when(delta >= limit, "rising").when(delta <= -limit, "falling").otherwise("stable")


def change_regime(fc: DataFrame) -> DataFrame:
    """(window_id, target, mean_change, regime) by the mean distance of truth from the last value."""
    one = fc.groupBy("window_id", "target").agg(F.avg(F.abs(F.col("y") - F.col("y0"))).alias("mean_change"))
    return one.withColumn("regime", F.when(F.col("mean_change") <= 1, "calm").when(F.col("mean_change") <= 3, "moving").otherwise("fast"))
