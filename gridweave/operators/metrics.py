"""Metrics of forecast tables (window_id, target, horizon, y, yhat, y0), grouped as asked. All are sums and quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from gridweave.operators.order import quantiles, with_quantiles
from gridweave.sources.scratch import written

EPS = 1e-8


def error() -> Column:
    return F.col("yhat") - F.col("y")


def path() -> WindowSpec:
    return Window.partitionBy("window_id", "target").orderBy("horizon")


def metrics(fc: DataFrame, by: Sequence[str], where: Column | None = None) -> DataFrame:
    """mae, mse, rmse, mape, mspe, bias, r2 over the rows that where lets through."""
    rows = fc if where is None else fc.filter(where)
    n, y = F.count("*"), F.col("y")
    return rows.groupBy(*by).agg(
        n.alias("n"), F.avg(F.abs(error())).alias("mae"), F.avg(error() * error()).alias("mse"), F.sqrt(F.avg(error() * error())).alias("rmse"), F.avg(F.abs(F.try_divide(error(), y))).alias("mape"),
        F.avg(F.try_divide(error(), y) * F.try_divide(error(), y)).alias("mspe"), F.avg(error()).alias("bias"), (1 - F.try_divide(F.sum(error() * error()), F.sum(y * y) - F.sum(y) * F.sum(y) / n)).alias("r2"),
    )


def rse(fc: DataFrame, by: Sequence[str]) -> DataFrame:
    """Root of squared errors over squared distances from the group's mean."""
    y = F.col("y")
    return fc.groupBy(*by).agg(F.sqrt(F.try_divide(F.sum(error() * error()), F.sum(y * y) - F.sum(y) * F.sum(y) / F.count("*"))).alias("rse"))


def corr_metric(fc: DataFrame, kind: str = "reference") -> DataFrame:
    """Over (target, horizon): the mean of sum(ab) / sqrt(sum(a²b²)), or of Pearson's coefficient."""
    if kind == "pearson":
        return fc.groupBy("target", "horizon").agg(F.corr("y", "yhat").alias("c")).agg(F.avg("c").alias("corr"))
    w = Window.partitionBy("target", "horizon")
    a, b = F.col("y") - F.avg("y").over(w), F.col("yhat") - F.avg("yhat").over(w)
    rows = fc.select("target", "horizon", (a * b).alias("ab"))
    return rows.groupBy("target", "horizon").agg(F.try_divide(F.sum("ab"), F.sqrt(F.sum(F.col("ab") * F.col("ab")))).alias("c")).agg(F.avg("c").alias("corr"))


def evaluate(fc: DataFrame) -> DataFrame:
    """mae, rmse, r2, mape and smape in percent for each target, and their mean as target macro."""
    rows = fc.filter(F.col("y").isNotNull() & F.col("yhat").isNotNull() & ~F.isnan("y") & ~F.isnan("yhat"))
    y, n = F.col("y"), F.count("*")
    each = rows.groupBy("target").agg(
        F.avg(F.abs(error())).alias("mae"), F.sqrt(F.avg(error() * error())).alias("rmse"), (1 - F.try_divide(F.sum(error() * error()), F.sum(y * y) - F.sum(y) * F.sum(y) / n)).alias("r2"),
        (100 * F.avg(F.abs(error()) / (F.abs(y) + EPS))).alias("mape"), (100 * F.avg(2 * F.abs(error()) / (F.abs(y) + F.abs("yhat") + EPS))).alias("smape"),
    )
    names = ["mae", "rmse", "r2", "mape", "smape"]
    return each.unionByName(each.agg(*(F.avg(c).alias(c) for c in names)).withColumn("target", F.lit("macro")))


def tail_metrics(fc: DataFrame, by: Sequence[str]) -> DataFrame:
    """95 % and 99 % quantile and maximum of the absolute error, and the 95 % quantile of windows' mean errors."""
    errors = written(fc.select(*by, "window_id", F.abs(error()).alias("_e")), "errors")  # fc is read once
    most = errors.groupBy(*by).agg(F.max("_e").alias("max_abs"))
    out = with_quantiles(most, "_e", {"p95": 0.95, "p99": 0.99}, by, errors)
    return with_quantiles(out, "_m", {"p95_window_mae": 0.95}, by, errors.groupBy(*by, "window_id").agg(F.avg("_e").alias("_m")))


def skill(fc: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of persistence's error that is saved: absolute and squared."""
    p = F.col("y0") - F.col("y")
    return fc.groupBy(*by).agg(
        F.avg(F.abs(error())).alias("mae"), F.avg(F.abs(p)).alias("mae_persistence"), (1 - F.try_divide(F.sum(F.abs(error())), F.sum(F.abs(p)))).alias("skill"), (1 - F.try_divide(F.sum(error() * error()), F.sum(p * p))).alias("mse_skill")
    )


def at_horizons(fc: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Mean absolute error of each target at some horizons, side by side."""
    return fc.groupBy("target").agg(*(F.avg(F.when(F.col("horizon") == h, F.abs(error()))).alias(f"mae_h{h}") for h in horizons))


def daily_metrics(fc: DataFrame) -> DataFrame:
    """skill by target and day of the origin."""
    return skill(fc.withColumn("day", F.to_date("origin_ts")), ["target", "day"])


def days_better(daily: DataFrame) -> DataFrame:
    return daily.groupBy("target").agg(F.count("*").alias("days"), F.count_if(F.col("skill") > 0).alias("better"))


def daily_pivot(fc: DataFrame, methods: Sequence[str]) -> DataFrame:
    """A row a target and day, a column a method; rows of methods have method."""
    return fc.withColumn("day", F.to_date("origin_ts")).groupBy("target", "day").pivot("method", list(methods)).agg(F.avg(F.abs(error())))


def _ends(fc: DataFrame, reference: str) -> DataFrame:
    """(window_id, target, dy, dp): change of truth and of forecast to the last horizon."""
    one = fc.groupBy("window_id", "target").agg(*(f("y" if c == "y" else "yhat", "horizon").alias(f"{c}{k}") for c in ("y", "p") for k, f in (("a", F.min_by), ("b", F.max_by))), F.max("y0").alias("_o"))
    if reference == "first_step":
        return one.select("window_id", "target", (F.col("yb") - F.col("ya")).alias("dy"), (F.col("pb") - F.col("pa")).alias("dp"))
    return one.select("window_id", "target", (F.col("yb") - F.col("_o")).alias("dy"), (F.col("pb") - F.col("_o")).alias("dp"))


def direction(fc: DataFrame, scale: float, reference: str = "origin") -> DataFrame:
    """Share of windows whose forecast ends on the right side, where truth moves by a tenth of scale or more.

    reference: origin, or first_step. With origin also the gain, the least-squares slope of forecast on true change.
    """
    moved = _ends(fc, reference).filter(F.abs("dy") >= 0.1 * scale)
    out = [F.count("*").alias("eligible"), F.avg((F.sign("dy") == F.sign("dp")).cast("int")).alias("accuracy")]
    if reference == "origin":
        out.append(F.try_divide(F.sum(F.col("dy") * F.col("dp")), F.sum(F.col("dy") * F.col("dy"))).alias("gain"))
    return moved.groupBy("target").agg(*out)


def direction_adaptive(fc: DataFrame, q: float = 0.1) -> DataFrame:
    """direction at each horizon, eligible where truth moves by at least its own quantile q."""
    rows = written(fc.select("target", "horizon", (F.col("y") - F.col("y0")).alias("dy"), (F.col("yhat") - F.col("y0")).alias("dp")), "moves")
    moved = with_quantiles(rows, F.abs("dy"), {"_l": q}, ["target", "horizon"]).filter(F.abs("dy") >= F.col("_l"))
    return moved.groupBy("target", "horizon").agg(F.count("*").alias("eligible"), F.avg((F.sign("dy") == F.sign("dp")).cast("int")).alias("accuracy"))


def variation(fc: DataFrame) -> DataFrame:
    """How much forecasts move, against truth: first differences and second ones."""

    def d1(c: str) -> Column:
        return F.abs(F.col(c) - F.lag(c).over(path()))

    def d2(c: str) -> Column:
        return F.abs(F.col(c) - 2 * F.lag(c).over(path()) + F.lag(c, 2).over(path()))

    rows = fc.select("target", d1("y").alias("y1"), d1("yhat").alias("p1"), d2("y").alias("y2"), d2("yhat").alias("p2"))
    return rows.groupBy("target").agg(F.try_divide(F.sum("p1"), F.sum("y1")).alias("variation_ratio"), F.try_divide(F.sum("p2"), F.sum("y2")).alias("curvature_ratio"))


def jump_profile(fc: DataFrame, period: int = 8) -> DataFrame:
    """Mean size of forecast steps by phase of the horizon, the first step counted from the last observation."""
    before = F.coalesce(F.lag("yhat").over(path()), F.col("y0"))
    rows = fc.select("target", (F.col("horizon") % period).alias("phase"), F.abs(F.col("yhat") - before).alias("jump"))
    return rows.groupBy("target", "phase").agg(F.avg("jump").alias("mean_jump"), F.sum("jump").alias("total_variation"))


def boundary_jumps(fc: DataFrame, leads: Sequence[int], by: Sequence[str] = ("target",)) -> DataFrame:
    """Mean total variation of forecasts from the last observation on, and mean step from each of leads to the next lead."""
    rows = fc.withColumn("_j", F.abs(F.col("yhat") - F.coalesce(F.lag("yhat").over(path()), F.col("y0"))))
    one = rows.groupBy(*by, "window_id").agg(F.sum("_j").alias("_v"), *(F.max(F.when(F.col("horizon") == lead + 1, F.col("_j"))).alias(f"_j{lead}") for lead in leads))
    return one.groupBy(*by).agg(F.avg("_v").alias("mean_total_variation"), *(F.avg(f"_j{lead}").alias(f"jump_{lead}_to_{lead + 1}") for lead in leads))


def masked_loss(fc: DataFrame, by: Sequence[str], mask: Column, lag: int = 1) -> DataFrame:
    """mape, smape (of 200) and mase over masked rows, parts that can't be told counting 0."""
    y, p = F.col("y"), F.col("yhat")
    naive = F.avg(F.abs(y - F.lag("y", lag).over(path()))).over(Window.partitionBy("window_id", "target"))
    rows = fc.withColumns({"_naive": naive, "_m": mask.cast("int")})
    zero = lambda c: F.coalesce(c, F.lit(0.0)) * F.col("_m")
    return rows.groupBy(*by).agg(
        F.avg(zero(F.try_divide(F.abs(y - p), F.abs(y)))).alias("mape"), F.avg(zero(F.try_divide(200 * F.abs(y - p), F.abs(y) + F.abs(p)))).alias("smape"), F.avg(zero(F.try_divide(F.abs(y - p), F.col("_naive")))).alias("mase")
    )


def seasonal_scores(panel: DataFrame, insample: str = "insample", actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """panel (id, group, freq, arrays) with mase, smape2 and mape of each series."""
    diffs = F.transform(F.slice(insample, F.col("freq") + 1, F.size(insample)), lambda x, i: F.abs(x - F.get(insample, i)))
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))
    err = F.zip_with(actual, forecast, lambda a, b: F.abs(a - b))
    sm = F.zip_with(actual, forecast, lambda a, b: F.when(F.abs(a) + F.abs(b) == 0, 0.0).otherwise(2 * F.try_divide(F.abs(a - b), F.abs(a) + F.abs(b))))
    mp = F.zip_with(actual, forecast, lambda a, b: F.when(a == 0, 0.0).otherwise(F.try_divide(F.abs(a - b), F.abs(a))))
    return panel.withColumns({"mase": F.try_divide(mean(err), mean(diffs)), "smape2": mean(sm), "mape0": mean(mp)})


def competition_summary(scores: DataFrame, main: Sequence[str]) -> DataFrame:
    """(group, mase, smape, owa) rounded to 3: groups but main pooled as Others, and their Average by count.

    scores has group, mase, smape2 and the same of a naive forecast as mase_naive and smape_naive.
    """
    pooled = scores.withColumn("group", F.when(F.col("group").isin(list(main)), F.col("group")).otherwise("Others"))
    sums = [F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("mase", "smape2", "mase_naive", "smape_naive"))]
    groups = pooled.groupBy("group").agg(*sums).unionByName(pooled.agg(*sums).withColumn("group", F.lit("Average")))
    owa = (F.try_divide("mase", "mase_naive") + F.try_divide("smape2", "smape_naive")) / 2
    return groups.select("group", "n", F.round("mase", 3).alias("mase"), F.round("smape2", 3).alias("smape"), F.round(owa, 3).alias("owa"))


def offset_mse_share(fc: DataFrame) -> DataFrame:
    """Share of the squared error that windows' mean errors explain."""
    one = fc.groupBy("target", "window_id").agg(F.count("*").alias("h"), F.avg(error()).alias("m"), F.sum(error() * error()).alias("s"))
    return one.groupBy("target").agg(F.try_divide(F.sum(F.col("h") * F.col("m") * F.col("m")), F.sum("s")).alias("offset_share"))


def composite_loss(fc: DataFrame, trend: float, endpoint: float, decay: float = 0.0, least: float = 0.0) -> DataFrame:
    """Weighted squared error, plus squared errors of steps and of the end."""
    w = F.greatest(F.exp(-decay * (F.col("horizon") - 1)), F.lit(least))
    step = F.pow(error() - F.lag(error()).over(path()), 2)
    last = F.max("horizon").over(Window.partitionBy("window_id", "target"))
    rows = fc.select("target", w.alias("w"), (error() * error()).alias("e"), step.alias("s"), F.when(F.col("horizon") == last, error() * error()).alias("end"))
    loss = F.sum(F.col("w") * F.col("e")) / F.sum("w") + trend * F.coalesce(F.avg("s"), F.lit(0.0)) + endpoint * F.avg("end")
    return rows.groupBy("target").agg(loss.alias("loss"))


def anomaly_eval(scores: DataFrame, ratio: float, by: Sequence[str]) -> DataFrame:
    """threshold, accuracy, precision, recall and f1 of scores (part, ts, score, label), part test being judged.

    The threshold is the 100 - ratio percentile over all parts. A hit anywhere in a true segment finds all of it.
    """
    limit = quantiles(scores, "score", [1 - ratio / 100]).select(F.col("q")[0].alias("threshold"))  # one row
    order = Window.partitionBy(*by).orderBy("ts")
    test = scores.filter("part = 'test'").crossJoin(F.broadcast(limit)).withColumn("_p", (F.col("score") > F.col("threshold")).cast("int"))
    edge = F.coalesce((F.col("label") != F.lag("label").over(order)).cast("int"), F.lit(0))
    runs = test.withColumn("_e", edge).withColumn("_run", F.sum("_e").over(order))
    hit = F.max("_p").over(Window.partitionBy(*by, "_run"))
    judged = runs.withColumn("pred", F.when(F.col("label") == 1, hit).otherwise(F.col("_p")))
    tp, fp, fn = (F.count_if((F.col("label") == a) & (F.col("pred") == b)) for a, b in ((1, 1), (0, 1), (1, 0)))
    out = judged.agg(F.max("threshold").alias("threshold"), F.avg((F.col("label") == F.col("pred")).cast("int")).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy(rows: DataFrame, scores: str, label: str) -> DataFrame:
    """Share of rows whose highest score stands at the label (from 0)."""
    best = F.array_position(scores, F.array_max(scores)) - 1
    return rows.agg(F.count("*").alias("n"), F.avg((best == F.col(label)).cast("int")).alias("accuracy"))
