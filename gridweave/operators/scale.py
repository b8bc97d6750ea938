"""Scalers and other normalisers, and joint statistics of columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.scalar import standardize
from gridweave.operators.framed import CHUNK, framed
from gridweave.operators.order import _summed, counted, in_ranges, quantiles, quantiles_of, with_quantiles
from gridweave.sources.scratch import written


#: Partial products that are merged before all of a column's are.
FAN = 64


def fit_scaler(long: DataFrame) -> DataFrame:
    """(feature, n, mean, scale) of long (feature, value), which holds valid training rows only."""
    stats = long.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("_v"))
    return stats.select("feature", "n", "mean", F.when(F.col("n") <= 1, 1.0).otherwise(F.sqrt(F.greatest("_v", F.lit(1e-12)))).alias("scale"))


def drop_near_constant(scaler: DataFrame, keep: Sequence[str], limit: float = 1e-5) -> DataFrame:
    return scaler.filter((F.col("scale") > limit) | F.col("feature").isin(list(keep)))


def apply_scaler(long: DataFrame, scaler: DataFrame) -> DataFrame:
    joined = long.join(scaler.select("feature", "mean", "scale"), "feature")
    return joined.withColumn("z", standardize(F.col("value"), F.col("mean"), F.col("scale")))


def apply_missing_policy(long: DataFrame, scaler: DataFrame, sparse: Sequence[str]) -> DataFrame:
    """Registered sparse features are their training mean everywhere, so 0 once scaled."""
    joined = long.join(scaler.select("feature", "mean"), "feature")
    return joined.withColumn("value", F.when(F.col("feature").isin(list(sparse)), F.col("mean")).otherwise(F.col("value"))).drop("mean")


def normalize(df: DataFrame, kind: str, value: str, by: Sequence[str]) -> Column:
    """standard (sample deviation) or minmax over each group of by; a constant group gives 0."""
    w = Window.partitionBy(*by)
    if kind == "standard":
        return F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)), F.lit(0.0))
    low, high = F.min(value).over(w), F.max(value).over(w)
    return (F.col(value) - low) / (high - low + 1e-9)


def robust_rescale(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Adds scaled: the value between its 1 % and 99 % quantiles as 0 to 1."""
    return with_quantiles(df, value, {"_a": 0.01, "_b": 0.99}, by).withColumn("scaled", F.try_divide(F.least(F.greatest(value, "_a"), "_b") - F.col("_a"), F.col("_b") - F.col("_a"))).drop("_a", "_b")


def distribution(df: DataFrame, value: str, *by: str) -> DataFrame:
    each = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return with_quantiles(each, value, {"p10": 0.1, "median": 0.5, "p90": 0.9}, by, df)


def histogram(df: DataFrame, value: str, low: float, high: float, n: int, *by: str) -> DataFrame:
    """Density on n equal bins of [low, high); the last bin is closed."""
    bin_no = F.least(F.floor((F.col(value) - low) / ((high - low) / n)), F.lit(n - 1)).cast("int")
    inside = df.filter(F.col(value).between(low, high))
    counts = inside.groupBy(*by, bin_no.alias("bin")).agg(F.count("*").alias("_n"))
    total = inside.groupBy(*by).agg(F.count("*").alias("_all"))
    return counts.join(total, list(by)).select(*by, "bin", (F.col("_n") / (F.col("_all") * ((high - low) / n))).alias("density"))


def tertile_cuts(df: DataFrame, value: str, *by: str) -> DataFrame:
    return quantiles(df, value, [1 / 3, 2 / 3], by).select(*by, F.col("q")[0].alias("low_cut"), F.col("q")[1].alias("high_cut"))


def average_ranks(values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(_value, _v, rank): the mean place of each distinct value of each of columns among all rows.

    Only distinct values are ordered; their counts carry the ties. values are read once.
    """
    counts = _summed(counted(values, {c: c for c in columns}), "_v", "_n", "_less", ["_value"])
    return counts.select("_value", "_v", (F.col("_less") + (F.col("_n") + 1) / 2).alias("rank"))


def response_diagnostics(df: DataFrame, x: str, y: str, least: int = 100) -> DataFrame:
    """rows, pearson, spearman and status of one control and response."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranks = written(average_ranks(both, [x, y]), "ranks")
    of = lambda name, c: ranks.filter(F.col("_value") == name).select(F.col("_v").alias(f"{c}_v"), F.col("rank").alias(c))
    ranked = both.join(of(x, "_rx"), F.col(x).cast("double") == F.col("_rx_v")).join(of(y, "_ry"), F.col(y).cast("double") == F.col("_ry_v"))
    out = ranked.agg(F.count("*").alias("rows"), F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))
    few = F.col("rows") < least
    return out.select("rows", F.when(~few, F.col("pearson")).alias("pearson"), F.when(~few, F.col("spearman")).alias("spearman"), F.when(few, "too_few_rows").otherwise("ok").alias("status"))


def binned_medians(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """(bin, median) of y over quantile bins of x, closed on the right, equal edges once."""
    pairs = written(df.filter(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_k")), "pairs")
    found = quantiles_of(in_ranges(pairs.groupBy(F.lit("_x").alias("_value"), F.col("_x").alias("_v")).agg(F.sum("_k").alias("_n")), ["_value", "_v"]), {"_x": [i / bins for i in range(bins + 1)]}).first()
    edges = sorted(set(found[0])) if found else []
    place = sum(((F.col("_x") > e).cast("int") for e in edges[1:-1]), F.lit(0))
    counts = pairs.filter("_y is not null").groupBy(place.alias("bin"), F.lit("_y").alias("_value"), F.col("_y").alias("_v")).agg(F.sum("_k").alias("_n"))
    return quantiles_of(in_ranges(counts, ["bin", "_value", "_v"]), {"_y": [0.5]}, ["bin"]).select("bin", F.col("_y")[0].alias("median"))


def monotone_share(curve: DataFrame) -> DataFrame:
    """Share of steps of a curve (bin, median) that rise."""
    step = F.col("median") - F.lag("median").over(Window.orderBy("bin"))  # one row a bin
    return curve.withColumn("_d", step).filter("_d is not null").agg(F.avg((F.col("_d") > 0).cast("int")).alias("increasing_share"))


def correlations(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) for each pair of columns over the rows that have both, in one pass; null where one of them is constant.

    Tasks make products of centred blocks of rows, of which each is merged with the others as means and co-moments,
    so neither plans nor what is shuffled grow with the pairs and rows together. Null and NaN are missing.
    """
    names, c = list(columns), len(columns)
    parts = ("n", "mx", "my", "xx", "yy", "xy")
    schema = "a int, " + ", ".join(f"{p} array<double>" for p in parts)

    def table(at: np.ndarray, stats: list[np.ndarray], more: dict | None = None) -> pa.Table:
        return pa.table({"a": pa.array(at.astype(np.int32)), **{p: pa.array(list(s), pa.list_(pa.float64())) for p, s in zip(parts, stats, strict=True)}, **(more or {})})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.column_stack([col.cast(pa.float64()).to_numpy(zero_copy_only=False) for col in batch.columns]) if batch.num_rows else np.zeros((0, c))
            there = ~np.isnan(x)
            shift = np.where(there, x, 0).sum(0) / np.maximum(there.sum(0), 1)
            z, v = np.where(there, x - shift, 0.0), there.astype(float)
            n = v.T @ v
            safe = np.maximum(n, 1)
            sx = z.T @ v
            sy, square = sx.T, (z * z).T @ v
            own = [n, shift[:, None] + sx / safe, shift[None, :] + sy / safe, square - sx * sx / safe, square.T - sy * sy / safe, z.T @ z - sx * sy / safe]
            total = own if total is None else merged_moments(total, own)
        if total is not None:
            part = pa.array(np.full(c, TaskContext.get().partitionId() % FAN, np.int32))
            yield from table(np.arange(c), total, {"part": part}).to_batches()

    def merge(group: pa.Table) -> pa.Table:
        rows = [[np.array(r, float) for r in group[p].to_pylist()] for p in parts]
        total = [r[0] for r in rows]
        for k in range(1, group.num_rows):
            total = merged_moments(total, [r[k] for r in rows])
        return table(group["a"].to_numpy()[:1], [t[None, :] for t in total])

    each = wide.select(*(F.col(n) for n in names)).mapInArrow(blocks, f"{schema}, part int")
    whole = each.groupBy("a", "part").applyInArrow(merge, schema).groupBy("a").applyInArrow(merge, schema)
    label = F.array(*(F.lit(n) for n in names))
    corr = lambda k: F.try_divide(F.get("xy", k), F.sqrt(F.get("xx", k)) * F.sqrt(F.get("yy", k)))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.lit(c - 1)), lambda k: k > F.col("a")), lambda k: F.struct(F.get(label, k).alias("b"), corr(k).alias("corr")))
    return whole.select(F.get(label, F.col("a")).alias("_a"), F.explode(pairs).alias("p")).select(F.col("_a").alias("a"), "p.b", "p.corr")


def merged_moments(one: Sequence[np.ndarray], other: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Counts, means and co-moments (n, mx, my, xx, yy, xy) of two sets of rows together."""
    n = one[0] + other[0]
    share = np.divide(one[0] * other[0], n, out=np.zeros_like(n), where=n > 0)
    part = np.divide(other[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = other[1] - one[1], other[2] - one[2]
    return [n, one[1] + dx * part, one[2] + dy * part, one[3] + other[3] + dx * dx * share, one[4] + other[4] + dy * dy * share, one[5] + other[5] + dx * dy * share]


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept and rmse of the residuals, by sums."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.sqrt((F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)) / F.regr_count(y, x)).alias("rmse")
    )


def lag_correlation(df: DataFrame, a: str, b: str, most: int, by: Sequence[str], order: str, chunk: int = CHUNK) -> DataFrame:
    """(lag, corr) of a with b lag rows later, for lags from -most to most, each series for itself, whatever its length."""
    shift = lambda w, k: F.lead(b, k).over(w) if k >= 0 else F.lag(b, -k).over(w)
    rows = df.select(*by, order, F.col(a), F.col(b))
    shifted = framed(rows, by, [order], most, most, lambda w: {f"_{k + most}": shift(w, k) for k in range(-most, most + 1)}, chunk)
    row = shifted.agg(F.array(*(F.struct(F.lit(k).alias("lag"), F.corr(a, f"_{k + most}").alias("corr")) for k in range(-most, most + 1))).alias("r"))
    return row.select(F.explode("r").alias("r")).select("r.*")
