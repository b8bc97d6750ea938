"""Scalar expressions: finiteness, bounds, text, shares, calendar features, scaling, blends and corrections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that switch a variable off, and advice that leaves it out.
FALSE_TEXTS = ("0", "false", "no", "n", "否", "不纳入", "排除", "剔除")
EXCLUDE_START = "不纳入"
EXCLUDE_PARTS = ("暂不纳入", "剔除")
#: What is an input or an output, and how such names end.
INPUT_TYPES, INPUT_END = ("输入", "input", "x"), "入"
OUTPUT_TYPES, OUTPUT_END = ("输出", "output", "target", "y"), "出"


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def only_finite(c: Column) -> Column:
    return F.when(finite(c), c)


def bound(c: Column, low: float | None, high: float | None) -> Column:
    """Null outside [low, high]; a missing end is open."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (c >= low)
    if high is not None:
        inside = inside & (c <= high)
    return F.when(inside, c)


def clean_text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def time_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def safe_name(c: Column) -> Column:
    return F.translate(clean_text(c), '/\\:*?"<>| ', "__________")


def effective(manual: Column, suggested: Column) -> Column:
    return F.coalesce(F.nullif(clean_text(manual), F.lit("")), clean_text(suggested))


def is_excluded(flag: Column, advice: Column) -> Column:
    """A manual flag decides; without one the advice does."""
    said = F.lower(clean_text(flag))
    text = clean_text(advice)
    left_out = reduce(Column.__or__, (text.contains(w) for w in EXCLUDE_PARTS), text.startswith(EXCLUDE_START))
    return F.when(said != "", said.isin(*FALSE_TEXTS)).otherwise(left_out)


def is_input(io_type: Column) -> Column:
    kind = F.lower(clean_text(io_type))
    return kind.isin(*INPUT_TYPES) | kind.endswith(INPUT_END)


def is_output(io_type: Column) -> Column:
    kind = F.lower(clean_text(io_type))
    return kind.isin(*OUTPUT_TYPES) | kind.endswith(OUTPUT_END)


def range_for_specs(specs: DataFrame, ranges: DataFrame) -> DataFrame:
    """low and high of each spec: of the first token (by pos) found in its code, name and target, else 0..100 if the unit has %."""
    text = F.upper(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("point_code", "point_name", "target_name"))))
    rows = specs.withColumn("_text", text)
    # ranges is a registry that people keep, of some tens of rows; whether it is broadcast the optimiser decides by its size.
    hit = rows.join(ranges, F.contains("_text", F.upper("token")), "left")
    first = hit.groupBy(*specs.columns).agg(F.min_by(F.struct("low", "high"), "pos").alias("_r"))
    percent = F.contains("unit", F.lit("%"))
    return first.withColumns({"low": F.coalesce("_r.low", F.when(percent, 0.0)), "high": F.coalesce("_r.high", F.when(percent, 100.0))}).drop("_r")


def ensure_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def filter_input_series(series: Sequence[str], targets: Sequence[str], allowed: Sequence[str] | None) -> list[str]:
    """Targets, and the allowed other series, in their order."""
    return [s for s in series if s in targets or allowed is None or s in allowed]


def row_sum(columns: Sequence[str]) -> Column:
    """Sum over what is there; null if nothing is."""
    some = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x))


def row_mean(columns: Sequence[str]) -> Column:
    some = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, x: a + x), F.size(some))


def share(c: Column, total: Column) -> Column:
    return F.try_divide(c, total)


def eps_ratio(a: Column, b: Column) -> Column:
    return a / (a + b + 1e-5)


def add_derived(df: DataFrame, config: Sequence[dict]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """df with the features of config ({name, kind, sources}), and notes on those not built.

    kinds: mean, sum, share (first source of the sum of all), ratio (of the first two).
    """
    columns, notes = {}, []
    for c in config:
        there = [s for s in c["sources"] if s in df.columns]
        if not there or c["kind"] in ("ratio", "share") and len(there) < len(c["sources"]):
            notes.append((c["name"], "not built: sources missing"))
            continue
        columns[c["name"]] = {
            "mean": lambda s: row_mean(s), "sum": lambda s: row_sum(s), "share": lambda s: share(F.col(s[0]), row_sum(s)), "ratio": lambda s: eps_ratio(F.col(s[0]), F.col(s[1])),
        }[c["kind"]](there)
    return df.withColumns(columns), notes


def time_marks(ts: str) -> dict[str, Column]:
    """Calendar marks from 0 to 1."""
    return {
        "month": F.month(ts) / 12, "day": F.dayofmonth(ts) / 31, "weekday": F.weekday(ts) / 6, "hour": F.hour(ts) / 23, "minute": F.minute(ts) / 59, "second": F.second(ts) / 59,
    }


#: Which centred calendar features go with a frequency, from fine to coarse.
FREQUENCIES = {
    "s": ("second", "minute", "hour", "weekday", "day", "yearday"), "min": ("minute", "hour", "weekday", "day", "yearday"), "h": ("hour", "weekday", "day", "yearday"),
    "d": ("weekday", "day", "yearday"), "w": ("day", "week"), "m": ("month",),
}


def time_features(ts: str, freq: str) -> dict[str, Column]:
    """Calendar features from -0.5 to 0.5 that suit a frequency."""
    every = {
        "second": F.second(ts) / 59 - 0.5, "minute": F.minute(ts) / 59 - 0.5, "hour": F.hour(ts) / 23 - 0.5, "weekday": F.weekday(ts) / 6 - 0.5, "day": (F.dayofmonth(ts) - 1) / 30 - 0.5,
        "yearday": (F.dayofyear(ts) - 1) / 365 - 0.5, "month": (F.month(ts) - 1) / 11 - 0.5, "week": (F.weekofyear(ts) - 1) / 52 - 0.5,
    }
    return {k: every[k] for k in FREQUENCIES[freq]}


def integer_stamps(ts: str, minute_bin: bool = False) -> dict[str, Column]:
    out = {"month": F.month(ts), "day": F.dayofmonth(ts), "weekday": F.weekday(ts), "hour": F.hour(ts)}
    return out | ({"minute": F.floor(F.minute(ts) / 15).cast("int")} if minute_bin else {})


def standardize(x: Column, mean: Column, scale: Column) -> Column:
    z = (x - mean) / scale
    return F.when(finite(z), z).otherwise(0.0)


def destandardize(z: Column, mean: Column, scale: Column) -> Column:
    return z * scale + mean


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.fill(0.0, list(columns))


def blend(y0: Column, yhat: Column, weight: Column) -> Column:
    return y0 + weight * (yhat - y0)


def time_weight(distance: Column, decay: float, least: float) -> Column:
    return F.greatest(F.exp(-decay * distance), F.lit(least))


def unit_random(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that follows from seed and keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)


def subsample(values: Column, limit: int = 256, factor: int = 2) -> Column:
    """Every factor-th value of an array longer than limit, from the first on; a shorter one as it is."""
    return F.when(F.size(values) > limit, F.filter(values, lambda _, i: i % factor == 0)).otherwise(values)


def mask_random(df: DataFrame, column: str, rate: float, seed: int, *keys: str) -> DataFrame:
    """Adds masked, and the column's values as 0 where they are."""
    df = df.withColumn("masked", unit_random(seed, *keys) <= rate)
    return df.withColumn(column, F.when(F.col("masked"), 0.0).otherwise(F.col(column)))


def digitize(x: Column, cuts: Sequence[float]) -> Column:
    """How many of the cuts are at or below x."""
    return F.when(x.isNotNull(), sum(((x >= c).cast("int") for c in cuts), F.lit(0)))


# Arrays


def pad_sequence(a: Column, length: int) -> Column:
    return F.concat(F.slice(a, 1, length), F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(a), F.lit(0))))


def pad_mask(a: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i <= F.size(a))


def patches(a: Column, size: int, step: int, pad: int) -> Column:
    """Slices of size elements every step, after the last element is repeated pad times."""
    padded = F.concat(a, F.array_repeat(F.element_at(a, -1), pad))
    return F.transform(F.sequence(F.lit(1), F.size(a) + pad - size + 1, F.lit(step)), lambda i: F.slice(padded, i, size))


def array_mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def given(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once a row, however often a lambda inside body looks at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def instance_norm(a: Column, last: bool = False) -> Column:
    """(center, scale, values) of an array: mean or last value off, over the population deviation plus 1e-5."""

    def normal(m: Column) -> Column:
        var = array_mean(F.transform(a, lambda x: (x - m["mean"]) * (x - m["mean"])))
        stated = F.struct((F.try_element_at(a, F.lit(-1)) if last else m["mean"]).alias("center"), F.sqrt(var + 1e-5).alias("scale"))
        return given(stated, lambda s: F.struct(s["center"].alias("center"), s["scale"].alias("scale"), F.transform(a, lambda x: (x - s["center"]) / s["scale"]).alias("values")))

    return given(F.struct(array_mean(a).alias("mean")), normal)


def instance_denorm(s: Column) -> Column:
    return F.transform(s["values"], lambda x: x * s["scale"] + s["center"])


def decoder_input(history: Column, label_len: int, pred_len: int, target: bool) -> Column:
    """What a decoder may see: the label segment, then its mean for a target or the last value for others."""
    label = F.slice(history, -label_len, label_len)
    fill = array_mean(label) if target else F.element_at(history, -1)
    return F.concat(label, F.array_repeat(fill, pred_len))


def extended_input(history: Column, future: Column, label_len: int, known: bool) -> Column:
    """Offline studies only: a covariate whose future is known keeps it; a target has its history's mean there."""
    label = F.slice(history, -label_len, label_len)
    return F.concat(label, future) if known else F.concat(label, F.array_repeat(array_mean(history), F.size(future)))
