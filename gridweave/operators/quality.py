"""Quality reports, column selection and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators.order import quantiles


def quality(long: DataFrame, tol: float = 1e-9, warn_missing: float = 0.2, warn_zero: float = 0.8, warn_constant: float = 0.8) -> DataFrame:
    """For each point_code: rows, missing rate, zero and constant ratio, min, max, mean, warnings.

    The constant ratio is the share of the most frequent value. Counting values first keeps a column of one value
    from meeting in one task. A column without values has ratios of 1.
    """
    values = long.groupBy("point_code", "value").agg(F.count("*").alias("n"))
    v, n, some = F.col("value"), F.col("n"), F.col("value").isNotNull()
    out = values.groupBy("point_code").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(some, n)), F.lit(0)).alias("non_null"), F.sum(F.when(some & (F.abs(v) <= tol), n)).alias("_zero"), F.max(F.when(some, n)).alias("_most"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.try_divide(F.sum(v * n), F.sum(F.when(some, n))).alias("mean"),
    )
    out = out.withColumns(
        {
            "missing_rate": 1 - F.col("non_null") / F.col("rows"),
            "zero_ratio": F.when(F.col("non_null") == 0, 1.0).otherwise(F.coalesce(F.try_divide("_zero", "non_null"), F.lit(0.0))),
            "constant_ratio": F.when(F.col("non_null") == 0, 1.0).otherwise(F.try_divide("_most", "non_null")),
        }
    )
    return _warned(out.drop("_zero", "_most"), warn_missing, warn_zero, warn_constant)


def _warned(df: DataFrame, missing: float, zero: float, constant: float) -> DataFrame:
    return df.withColumns({"warn_missing": F.col("missing_rate") > missing, "warn_zero": F.col("zero_ratio") > zero, "warn_constant": F.col("constant_ratio") > constant})


def expected_rows(start, end, seconds: int) -> int:
    """Grid instants of [start, end)."""
    return -int(-(end - start).total_seconds() // seconds)


def quality_on_grid(long: DataFrame, codes: DataFrame, expected: int, **limits) -> DataFrame:
    """quality with the missing rate against the rows the grid should have; codes without rows get a status."""
    out = codes.join(quality(long, **limits).withColumnRenamed("rows", "observed_rows"), "point_code", "left")
    out = out.withColumns({"observed_rows": F.coalesce("observed_rows", F.lit(0)), "non_null": F.coalesce("non_null", F.lit(0)), "zero_ratio": F.coalesce("zero_ratio", F.lit(1.0)), "constant_ratio": F.coalesce("constant_ratio", F.lit(1.0))})
    out = out.withColumns({"rows": F.lit(expected).cast("long"), "missing_rate": 1 - F.col("non_null") / expected, "status": F.when(F.col("observed_rows") == 0, "missing_source").otherwise("ok")})
    return _warned(out, 0.2, 0.8, 0.8)


def _only(report: DataFrame, codes: Sequence[str] | None) -> DataFrame:
    return report if codes is None else report.filter(F.col("point_code").isin(list(codes)))


def _reasons(pairs: Sequence[tuple[Column, str]]) -> Column:
    return F.concat_ws("|", *(F.when(c, F.lit(t)) for c, t in pairs))


def low_information(report: DataFrame, inputs: Sequence[str] | None = None, keep: Sequence[str] = (), limit: float = 0.98) -> DataFrame:
    """Inputs (all codes if none are named) that say next to nothing, and why."""
    why = _reasons([(F.col("zero_ratio") >= limit, "near_zero"), (F.col("constant_ratio") >= limit, "constant")])
    own = _only(report, inputs).filter(~F.col("point_code").isin(list(keep)))
    return own.withColumn("reasons", why).filter("reasons <> ''").select("point_code", "zero_ratio", "constant_ratio", "reasons")


def unusable_outputs(report: DataFrame, outputs: Sequence[str] | None = None, least: int = 1, limit: float = 0.98) -> DataFrame:
    why = _reasons([(F.col("non_null") < least, "too_few_non_null"), (F.col("missing_rate") >= limit, "too_many_missing"), (F.col("constant_ratio") >= limit, "constant")])
    return _only(report, outputs).withColumn("reasons", why).filter("reasons <> ''").select("point_code", "non_null", "missing_rate", "constant_ratio", "reasons")


def usable_outputs(report: DataFrame, outputs: Sequence[str] | None = None, **limits) -> DataFrame:
    bad = unusable_outputs(report, outputs, **limits)
    return _only(report, outputs).join(bad, "point_code", "left_anti").select("point_code")


def row_valid_rate(columns: Sequence[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) / len(columns)


def low_candidates(long: DataFrame, q: float = 0.08, missing: float = 0.5, zero: float = 0.8, constant: float = 0.8, approximate: bool = False) -> DataFrame:
    """Columns whose low level means something: point_code, q_low, q50, q95, low_cut."""
    shares = [q, 0.5, 0.95]
    found = long.groupBy("point_code").agg(F.percentile_approx("value", shares, 10_000).alias("q")) if approximate else quantiles(long, "value", shares, ["point_code"])
    cuts = found.withColumnRenamed("q", "_q").select("point_code", F.col("_q")[0].alias("q_low"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q95"))
    good = quality(long).filter((F.col("missing_rate") <= missing) & (F.col("zero_ratio") <= zero) & (F.col("constant_ratio") <= constant)).select("point_code")
    cut = F.col("q_low") + F.greatest(F.col("q50") - F.col("q_low"), F.lit(0.0)) * 0.08
    return cuts.join(good, "point_code").filter("q95 > q_low").withColumn("low_cut", cut)


def clean_audit(long: DataFrame) -> DataFrame:
    """Cleaning changes nothing; this says so for each column."""
    counts = long.groupBy("point_code").agg(F.count("*").alias("rows"), F.count("value").alias("non_null"))
    return counts.withColumns({"changed": F.lit(0).cast("long"), "status": F.lit("not_applied_strict_raw_window")})


def finite_audit(long: DataFrame) -> DataFrame:
    from gridweave.functions.scalar import finite

    good = finite(F.col("value"))
    return long.groupBy("point_code").agg(F.count_if(~good).alias("bad"), F.min(F.when(good, F.col("value"))).alias("min"), F.max(F.when(good, F.col("value"))).alias("max"))


def missing_by(long: DataFrame, *by: str) -> DataFrame:
    """Share of nulls."""
    return long.groupBy(*by).agg((F.count_if(F.col("value").isNull()) / F.count("*")).alias("missing_share"))


# Checks of sets and contracts


def contract_diff(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(point_code, problem): codes that one of the two hasn't."""
    missing = expected.select("point_code").join(found, "point_code", "left_anti").withColumn("problem", F.lit("missing"))
    extra = found.select("point_code").join(expected, "point_code", "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """What must be disjoint and isn't."""
    return a.select("point_code").intersect(b.select("point_code"))


def assert_disjoint(a: DataFrame, b: DataFrame) -> None:
    if rows := overlap(a, b).limit(10).collect():
        raise ValueError(f"in both: {[r[0] for r in rows]}")


def validate_contract(scaler: DataFrame, targets: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(check, ok): scaler (pos, feature, scale) and targets (pos, feature) against counts of features and targets."""
    s = scaler.agg(F.count("*").alias("n"), F.count_if((F.col("scale") > 0) & ~F.isnan("scale") & (F.col("scale") < float("inf"))).alias("good"), F.count_distinct("feature").alias("names"))
    placed = targets.join(scaler.select("feature", F.col("pos").alias("at")), "feature", "left")
    t = placed.agg(F.count("*").alias("m"), F.count("at").alias("found"), F.corr("pos", "at").alias("order"))
    checks = {
        "feature_count": F.col("n") == counts["features"], "target_count": F.col("m") == counts["targets"], "positive_finite_scale": F.col("good") == F.col("n"), "unique_features": F.col("names") == F.col("n"),
        "targets_in_scaler": F.col("found") == F.col("m"), "window": F.lit(counts["pred_len"] > 0 and counts["seq_len"] >= counts["label_len"]),
    }
    return s.crossJoin(t).select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks.items()))).alias("c")).select("c.*")


def validate_history(history: DataFrame, rows: int, seconds: int) -> DataFrame:
    """(window_id, status) for histories (window_id, origin_ts, ts): ok, wrong_rows, irregular_step or wrong_end."""
    from pyspark.sql import Window

    step = F.unix_seconds("ts") - F.lag(F.unix_seconds("ts")).over(Window.partitionBy("window_id").orderBy("ts"))
    one = history.withColumn("_step", step).groupBy("window_id").agg(F.count("*").alias("n"), F.min("_step").alias("low"), F.max("_step").alias("high"), F.max("ts").alias("last"), F.max("origin_ts").alias("origin"))
    status = F.when(F.col("n") != rows, "wrong_rows").when((F.col("low") != seconds) | (F.col("high") != seconds), "irregular_step").when(F.col("last") != F.col("origin"), "wrong_end").otherwise("ok")
    return one.select("window_id", status.alias("status"))


def validate_columns(spark: SparkSession, columns: Sequence[str], features: Sequence[str], auxiliary: Sequence[str] = (), time: str = "timestamp") -> DataFrame:
    """(column, problem) for the columns of a table of histories: unexpected, duplicate, missing or missing_auxiliary.

    Only auxiliary features may be missing; they count as null everywhere (see ensure_columns).
    """
    rows = [(c, "duplicate") for c in dict.fromkeys(columns) if list(columns).count(c) > 1]
    rows += [(c, "unexpected") for c in dict.fromkeys(columns) if c not in features and c != time]
    rows += [(c, "missing_auxiliary" if c in auxiliary else "missing") for c in (time, *features) if c not in columns]
    return spark.createDataFrame(rows, "column string, problem string")


def verify_counts(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks whose rows or windows differ from the manifest: chunk_id, valid_rows, windows of both."""
    a, b = found.alias("a"), manifest.alias("b")
    both = a.join(b, F.col("a.chunk_id") == F.col("b.chunk_id"), "full")
    pick = [F.coalesce("a.chunk_id", "b.chunk_id").alias("chunk_id")]
    for c in ("valid_rows", "windows"):
        pick += [F.coalesce(f"a.{c}", F.lit(0)).alias(c), F.coalesce(f"b.{c}", F.lit(0)).alias(f"manifest_{c}")]
    return both.select(*pick).filter("valid_rows <> manifest_valid_rows or windows <> manifest_windows")


def length_audit(samples: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Over samples of array columns: how many have dimensions of different length, and the range of lengths."""
    sizes = F.array(*(F.size(c) for c in dims))
    return samples.select(F.array_min(sizes).alias("low"), F.array_max(sizes).alias("high")).agg(
        F.count_if(F.col("low") != F.col("high")).alias("ragged"), F.min("low").alias("min_length"), F.max("high").alias("max_length"), (F.min("low") != F.max("high")).alias("lengths_differ")
    )


def guarded_status(quality: DataFrame) -> DataFrame:
    """Status of each (window_id, target) from its quality columns.

    current_missing, coverage, target_missing, output_finite, gated: unavailable, degraded_persistence,
    short_horizon_corrected or model.
    """
    degraded = (F.col("coverage") < 0.5) | (F.col("target_missing") > 0.2) | ~F.col("output_finite")
    status = F.when(F.col("current_missing"), "unavailable").when(degraded, "degraded_persistence").when(F.col("gated"), "short_horizon_corrected").otherwise("model")
    return quality.withColumn("status", status)
