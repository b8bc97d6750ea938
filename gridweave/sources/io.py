"""Reading and writing point series, registries, frames, reports and scored forecasts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.functions.scalar import clean_text, effective, finite, is_excluded
from gridweave.operators.order import counted, quantiles_of
from gridweave.sources.scratch import written


def read_points(spark: SparkSession, root: str, codes: Sequence[str] | None = None) -> DataFrame:
    """Points below root/point_code=<code>/; asking for codes reads no other folder."""
    points = spark.read.schema("timestamp timestamp, value double, point_code string").parquet(root)
    return points.filter(F.col("point_code").isin(list(codes))) if codes is not None else points


def available_codes(points: DataFrame) -> DataFrame:
    return points.select("point_code").distinct()


def time_range(df: DataFrame, start, end, ts: str = "timestamp") -> DataFrame:
    """Rows of [start, end); the bounds are literals, so the scan gets them."""
    return df.filter((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))


SPEC_COLUMNS = ("model", "io_type", "role_group", "variable_role", "point_code", "point_name", "unit", "process_stage", "target_name", "include_advice", "control_priority")


def explode_models(df: DataFrame, aliases: DataFrame, column: str = "model") -> DataFrame:
    """One row a model named in the cell, aliases (alias, model) mapped, unknown names kept."""
    names = df.withColumn("_name", F.explode(F.split(F.coalesce(column, F.lit("")), "[，、/,]")))
    names = names.withColumn("_name", clean_text(F.col("_name"))).filter("_name <> ''")
    mapped = names.join(aliases.select(F.col("alias").alias("_name"), F.col("model").alias("_model")), "_name", "left")
    return mapped.withColumn(column, F.coalesce("_model", "_name")).drop("_name", "_model")


def variable_specs(df: DataFrame, valid_models: Sequence[str]) -> DataFrame:
    """The registry: text cleaned, manual choice before suggestion, excluded rows gone, first row a key kept.

    df has SPEC_COLUMNS, manual_model, manual_role, include_manual, and row_no, which orders the rows.
    """
    text = df.select("row_no", *(clean_text(F.col(c)).alias(c) for c in (*SPEC_COLUMNS, "manual_model", "manual_role", "include_manual")))
    kept = text.filter(~is_excluded(F.col("include_manual"), F.col("include_advice")))
    chosen = kept.withColumns({"model": effective(F.col("manual_model"), F.col("model")), "variable_role": effective(F.col("manual_role"), F.col("variable_role"))})
    chosen = chosen.filter(F.col("model").isin(list(valid_models)) & (F.col("point_code") != ""))
    first = F.row_number().over(Window.partitionBy("model", "io_type", "point_code").orderBy("row_no"))
    return chosen.withColumn("_first", first).filter("_first = 1").select("row_no", *SPEC_COLUMNS)


def point_codes_for_models(specs: DataFrame, models: Sequence[str], extra: DataFrame) -> DataFrame:
    """(point_code, pos) in order of first mention: points of the models, then extra (point_code, pos)."""
    own = specs.filter(F.col("model").isin(list(models))).select("point_code", F.col("row_no").cast("long").alias("pos"), F.lit(0).alias("_part"))
    both = own.unionByName(extra.select("point_code", F.col("pos").cast("long").alias("pos"), F.lit(1).alias("_part")))
    first = both.groupBy("point_code").agg(F.min(F.struct("_part", "pos")).alias("first"))
    return first.select("point_code", (F.row_number().over(Window.orderBy("first", "point_code")) - 1).cast("long").alias("pos"))


def read_wide_csv(spark: SparkSession, path: str, time_col: str, series: Sequence[str] | None = None) -> DataFrame:
    """Time and series columns; all others are series unless named. A series that isn't there is an error."""
    df = spark.read.option("header", True).csv(path)
    series = list(series) if series is not None else [c for c in df.columns if c != time_col]
    if missing := [c for c in series if c not in df.columns]:
        raise ValueError(f"no such series: {missing}")
    return df.select(F.to_timestamp(time_col).alias(time_col), *(F.col(c).try_cast("double").alias(c) for c in series))


def custom_csv_columns(df: DataFrame, ts: str, target: str) -> DataFrame:
    """date first, target last."""
    others = [c for c in df.columns if c not in (ts, target)]
    return df.select(F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("date"), *others, target)


def write_custom_csv(df: DataFrame, path: str, ts: str, target: str) -> None:
    custom_csv_columns(df, ts, target).write.mode("overwrite").option("header", True).csv(path)


def narrowed(df: DataFrame) -> DataFrame:
    """Doubles as floats."""
    return df.select(*(F.col(n).cast("float").alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def write_frame(df: DataFrame, path: str, chunk: str = "chunk_id") -> None:
    writer = narrowed(df).write.mode("overwrite")
    (writer.partitionBy(chunk) if chunk in df.columns else writer).parquet(path)


def write_report(df: DataFrame, root: str, model: str, category: str, name: str) -> None:
    """A report is a few rows, so it is one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/{model}/{category}/{name}")


def parameter_hash(*columns: str) -> Column:
    return F.sha1(F.to_json(F.struct(*columns)))


def changed_units(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Units of sources (unit, params_hash, size, mtime) that manifest hasn't as they are."""
    keys = ["unit", "params_hash", "size", "mtime"]
    return sources.join(manifest.select(*keys), keys, "left_anti")


def dependent_chunks(changed: DataFrame, seconds: int, back: int, forward: int) -> DataFrame:
    """(chunk_id) of the chunks that know, as core or halo, an instant of a changed unit (start_time, end_time)."""
    begin, end = F.unix_seconds("start_time"), F.unix_seconds("end_time")
    ids = F.sequence(F.floor((begin - forward) / seconds).cast("long"), F.floor((end + back) / seconds).cast("long"))
    return changed.select(F.explode(ids).alias("chunk_id")).distinct()


def rebuild_chunks(points: DataFrame, changed: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, seconds: int, back: int, forward: int, ts: str = "ts") -> DataFrame:
    """Rewrites those chunks of the table in path that changed units (start_time, end_time) bear on; their chunk_ids.

    build makes the table's rows of points in chunks (chunk_id, is_core), as halo_chunks gives them. The times of a
    changed unit are those before and after its change together. Only points within reach of a dependent chunk are
    read, only those chunks' folders are overwritten, and a chunk that has no row any more loses its folder. A run that
    failed half way can be repeated. The result equals a table written whole.
    """
    spark = points.sparkSession
    chunks = written(dependent_chunks(changed, seconds, back, forward), "dependent")
    bounds = chunks.agg(F.min("chunk_id"), F.max("chunk_id")).first()
    if bounds[0] is None:
        return chunks
    at = F.unix_seconds(ts)
    near = points.filter((F.col(ts) >= F.timestamp_seconds(F.lit(bounds[0] * seconds - back))) & (F.col(ts) < F.timestamp_seconds(F.lit((bounds[1] + 1) * seconds + forward))))
    spread = near.withColumn("chunk_id", F.explode(F.sequence(F.floor((at - forward) / seconds).cast("long"), F.floor((at + back) / seconds).cast("long"))))
    frames = spread.join(chunks, "chunk_id").withColumn("is_core", F.floor(at / seconds) == F.col("chunk_id"))
    rows = written(narrowed(build(frames)), "rebuilt")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_id").parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in chunks.join(rows.select("chunk_id").distinct(), "chunk_id", "left_anti").toLocalIterator():  # chunks without rows
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"chunk_id={r['chunk_id']}"), True)
    return chunks


def time_bounds(points: DataFrame, ts: str = "ts") -> DataFrame:
    return points.agg(F.min(ts).alias("start"), F.max(ts).alias("end"))


def point_coverage(points: DataFrame, codes: DataFrame) -> DataFrame:
    """For each of codes (point_code): rows, finite rows, valid rate, first and last finite time, status."""
    good = finite(F.col("value"))
    found = points.groupBy("point_code").agg(
        F.count("*").alias("raw_rows"), F.count_if(good).alias("finite_rows"), F.min(F.when(good, F.col("ts"))).alias("first_ts"), F.max(F.when(good, F.col("ts"))).alias("last_ts")
    )
    out = codes.join(found, "point_code", "left").withColumn("status", F.when(F.col("raw_rows").isNull(), "missing_source").otherwise("ok"))
    out = out.withColumns({"raw_rows": F.coalesce("raw_rows", F.lit(0)), "finite_rows": F.coalesce("finite_rows", F.lit(0))})
    return out.withColumn("valid_rate", F.coalesce(F.try_divide("finite_rows", "raw_rows"), F.lit(0.0)))


def variable_inventory(specs: DataFrame, points: DataFrame) -> DataFrame:
    """Inputs, outputs and points without data, a model."""
    there = available_codes(points).withColumn("has_silver", F.lit(True))
    rows = specs.join(there, "point_code", "left").withColumn("has_silver", F.coalesce("has_silver", F.lit(False)))
    return rows.groupBy("model").agg(F.count_if(F.col("io_type") == "input").alias("inputs"), F.count_if(F.col("io_type") == "output").alias("outputs"), F.count_if(~F.col("has_silver")).alias("missing"))


def arrays_to_forecasts(df: DataFrame, step_seconds: int) -> DataFrame:
    """(window_id, target, cutoff, y[], yhat[]) as one row a horizon: ..., horizon, ts, y, yhat."""
    rows = df.select("window_id", "target", "cutoff", F.posexplode(F.arrays_zip("y", "yhat")).alias("_h", "_v"))
    horizon = F.col("_h") + 1
    return rows.select("window_id", "target", "cutoff", horizon.alias("horizon"), F.timestamp_micros(F.unix_micros("cutoff") + horizon.cast("long") * (step_seconds * 1_000_000)).alias("ts"), F.col("_v.y").alias("y"), F.col("_v.yhat").alias("yhat"))


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def source_cache_audit(raw: DataFrame, cached: DataFrame, since) -> DataFrame:
    """For each point: last time and finite rows of the source, negative share and median of the cache."""
    good = finite(F.col("value"))
    a = raw.filter(F.col("ts") >= F.lit(since).cast("timestamp")).groupBy("point_code").agg(F.max("ts").alias("source_last"), F.count_if(good).alias("source_finite"))
    b = cached.filter(F.col("value").isNotNull())
    counts = counted(b, {"value": "value"}, ["point_code"])
    shares = counts.groupBy("point_code").agg((F.sum(F.when(F.col("_v") < 0, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("negative_share"))
    median = quantiles_of(counts, {"value": [0.5]}, ["point_code"]).select("point_code", F.col("value")[0].alias("median"))
    return a.join(shares.join(median, "point_code"), "point_code", "full")


def scored(df: DataFrame, columns: Sequence[str] = ("final", "raw")) -> DataFrame:
    """Values that are not finite become null before they are written."""
    return df.withColumns({c: F.when(finite(F.col(c)), F.col(c)) for c in columns})


def write_scores(df: DataFrame, path: str) -> None:
    scored(df).write.mode("overwrite").parquet(path)


def ordered(df: DataFrame, keys: Sequence[str] = ("unique_id", "ds", "cutoff", "horizon")) -> DataFrame:
    return df.orderBy(*keys)
