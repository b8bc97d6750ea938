"""Calibrated intervals, evidence scores, fitted weights and acceptance gates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators.forecast import grid_apply
from gridweave.operators.order import _joined, counted, quantiles_of
from gridweave.operators.splits import calibration_split
from gridweave.sources.scratch import written


#: Draws that a task weighs its blocks for at a time.
DRAWS = 512


def calibrate_intervals(fc: DataFrame, share: float = 0.4, level: float = 0.9) -> DataFrame:
    """For each target and horizon residual quantiles of the first windows, and what they cover of the others."""
    # fc is read once: what follows needs residuals only, and of those how often each occurs.
    residuals = written(fc.select("target", "horizon", "window_id", (F.col("y") - F.col("yhat")).alias("_r")), "residuals")
    keys, tail = ["target", "horizon"], (1 - level) / 2
    counts = counted(calibration_split(residuals, "window_id", share), {"_r": "_r"}, ["part", *keys])
    bounds = quantiles_of(counts.filter("part = 'calibration'"), {"_r": [tail, 1 - tail]}, keys).select(*keys, F.col("_r")[0].alias("low"), F.col("_r")[1].alias("high"))
    rest = counts.filter("part = 'evaluation'").join(bounds, keys)
    inside = F.when(F.col("_v").between(F.col("low"), F.col("high")), F.col("_n")).otherwise(0)
    return rest.groupBy(*keys).agg(F.max("low").alias("low"), F.max("high").alias("high"), (F.sum(inside) / F.sum("_n")).alias("coverage"), F.max(F.col("high") - F.col("low")).alias("width"))


def _clip(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)))


def confidence(df: DataFrame) -> DataFrame:
    """Adds score and level from improvement, direction, coverage and saved (share of the test that was saved)."""
    raw = 0.45 * _clip(F.col("improvement") / 0.5) + 0.30 * _clip((F.col("direction") - 0.5) / 0.4) + 0.25 * _clip(1 - F.abs(F.col("coverage") - 0.9) / 0.9)
    score = F.round(F.when(F.col("saved") < 0.95, F.least(raw, F.lit(0.65))).otherwise(raw), 4)
    level = F.when((F.col("improvement") <= 0) | (F.col("direction") < 0.6), "low").when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")
    return df.withColumns({"score": score, "level": level})


def fit_blend_weights(fc: DataFrame, step: float = 0.05) -> DataFrame:
    """(target, horizon, weight, mae): the weight of the grid with the least error, the smaller one of two alike."""
    values = [round(i * step, 10) for i in range(round(1 / step) + 1)]
    rows = grid_apply(fc.select("target", "horizon", "y", "yhat", "y0"), values)
    err = F.abs(F.col("y0") + F.col("alpha") * (F.col("yhat") - F.col("y0")) - F.col("y"))
    each = rows.groupBy("target", "horizon", "alpha").agg(F.round(F.avg(err), 9).alias("mae"))
    best = each.groupBy("target", "horizon").agg(F.min(F.struct("mae", "alpha")).alias("b"))
    return best.select("target", "horizon", F.col("b.alpha").alias("weight"), F.col("b.mae").alias("mae"))


def horizon_group(horizon: Column, cuts: Sequence[int]) -> Column:
    return sum(((horizon > c).cast("int") for c in cuts), F.lit(0))


def fit_shrink(fc: DataFrame, cuts: Sequence[int] = (12, 30)) -> DataFrame:
    """(target, group, weight, bias): the least-squares weight of forecast changes, from 0 to 1, and the mean error."""
    dy, dp = F.col("y") - F.col("y0"), F.col("yhat") - F.col("y0")
    weight = _clip(F.coalesce(F.try_divide(F.sum(dp * dy), F.sum(dp * dp)), F.lit(0.0)))
    return fc.groupBy("target", horizon_group(F.col("horizon"), cuts).alias("group")).agg(weight.alias("weight"), F.avg(F.col("yhat") - F.col("y")).alias("bias"))


def fit_ridge(fc: DataFrame, features: Sequence[str], lambdas: Sequence[float] = (0.01, 0.1, 1.0)) -> DataFrame:
    """(target, ridge, intercept, a coefficient a feature) of the residual on features; Spark sums, the driver solves.

    What reaches the driver is one row of sums a target.
    """
    x = [F.lit(1.0), *(F.col(f) for f in features)]
    k, r = len(x), F.col("y") - F.col("yhat")
    sums = fc.groupBy("target").agg(F.count("*").alias("n"), F.array(*(F.sum(a * b) for a in x for b in x)).alias("xx"), F.array(*(F.sum(a * r) for a in x)).alias("xr")).collect()
    out = []
    for row in sums:
        xx, xr = np.array(row["xx"]).reshape(k, k), np.array(row["xr"])
        for lam in lambdas:
            penalty = lam * row["n"] * np.eye(k)
            penalty[0, 0] = 0
            out.append((row["target"], float(lam), *map(float, np.linalg.solve(xx + penalty, xr))))
    return fc.sparkSession.createDataFrame(out, ", ".join(["target string", "ridge double", "intercept double", *(f"{f} double" for f in features)]))


def fit_offset(fc: DataFrame) -> DataFrame:
    """(target, bias, limit): median residual, and the 99 % quantile of its size."""
    r = F.col("y") - F.col("yhat")
    found = quantiles_of(counted(fc, {"bias": r, "limit": F.abs(r)}, ["target"]), {"bias": [0.5], "limit": [0.99]}, ["target"])
    return found.select("target", F.col("bias")[0].alias("bias"), F.col("limit")[0].alias("limit"))


def unit(block: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each block's hash and draw."""
    with np.errstate(over="ignore"):
        x = block + (draw.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def block_bootstrap(blocks: DataFrame, key: str, draws: int, seed: int, statistic: Callable[[], Column], by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """low and high of a statistic over draws of blocks (one row a block, numbers to sum).

    Each draw weighs each block by a Poisson number of mean 1 that follows from seed, draw and block. A task sums its
    blocks for all draws at once, as a product of matrices, so a row comes out a draw and task, never one a draw and
    block. Numbers that are missing count as 0.
    """
    numbers = [n for n, t in blocks.dtypes if n not in (key, *by) and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    kinds = dict(blocks.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "_d int", *(f"{n} double" for n in numbers)])
    cumulated = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for group, rows in batch.groupby(list(by), dropna=False) if by else [((), batch)]:
                group = group if isinstance(group, tuple) else (group,)
                values = np.nan_to_num(rows[numbers].to_numpy(float))
                total = sums.setdefault(group, np.zeros((draws, len(numbers))))
                for begin in range(0, draws, DRAWS):
                    d = np.arange(begin, min(begin + DRAWS, draws))
                    total[d] += np.searchsorted(cumulated, unit(rows["_h"].to_numpy().view("u8")[None, :], d[:, None]), side="right") @ values
        for group, total in sums.items():
            yield pd.DataFrame({**{b: [g] * draws for b, g in zip(by, group, strict=True)}, "_d": np.arange(draws, dtype=np.int32), **{n: total[:, k] for k, n in enumerate(numbers)}})

    keyed = blocks.select(*by, *numbers, F.xxhash64(F.lit(seed), key, *by).alias("_h"))
    drawn = keyed.mapInPandas(summed, schema).groupBy(*by, "_d").agg(statistic().alias("_s"))
    tail = (1 - level) / 2
    return drawn.groupBy(*by).agg(F.percentile("_s", tail).alias("low"), F.percentile("_s", 1 - tail).alias("high"), F.count("*").alias("draws"))


def causal_audit(full: DataFrame, prefix: DataFrame, keys: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """origins, differing: a feature from all data against the same from history only (both keys and feature)."""
    a, b = full.withColumnRenamed("feature", "_f"), prefix.withColumnRenamed("feature", "_p")
    off = ~F.coalesce(F.abs(F.col("_f") - F.col("_p")) <= tol, F.col("_f").isNull() & F.col("_p").isNull())
    return _joined(b, a, keys).agg(F.count("*").alias("origins"), F.count_if(off).alias("differing"))


def acceptance(policies: DataFrame) -> DataFrame:
    """Adds accepted to rows of improvement, rmse_ratio, direction_change, worst_group_ratio, days, days_not_worse."""
    ok = (F.col("improvement") > 0) & (F.col("rmse_ratio") <= 1.02) & (F.col("direction_change") >= -0.01) & (F.col("worst_group_ratio") <= 1.02) & (2 * F.col("days_not_worse") >= F.col("days"))
    return policies.withColumn("accepted", F.coalesce(ok, F.lit(False)))


def select_policy(policies: DataFrame, by: Sequence[str], name: str = "policy") -> DataFrame:
    """The accepted policy of each group that improves most; the first name of two alike."""
    best = acceptance(policies).filter("accepted").groupBy(*by).agg(F.min(F.struct((-F.round("improvement", 9)).alias("_i"), F.col(name))).alias("b"))
    return best.select(*by, F.col(f"b.{name}").alias(name), (-F.col("b._i")).alias("improvement"))
