"""Queries: sources, expressions, joins, quality, intervals, windows, splits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.functions import scalar
from gridweave.operators import grid, intervals, quality, scale, splits, windows
from gridweave.plans import fixtures as fx
from gridweave.plans.fixtures import CHUNK, CODES, GRID, LENGTH, PRED, SEQ, query
from gridweave.sources import io

MODELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]
_IN = ", ".join(f"'{m}'" for m in MODELS)


# Sources


@query("point_code n:i", "SELECT point_code, count(*) AS n FROM points WHERE point_code IN ('click', 'view') GROUP BY 1")
def s01_read_points(spark: SparkSession, d: str) -> DataFrame:
    root = fx.folder(spark, "points")
    fx.points(spark, d).withColumnRenamed("ts", "timestamp").write.partitionBy("point_code").parquet(root)
    return io.read_points(spark, root, ["click", "view"]).groupBy("point_code").agg(F.count("*").alias("n"))


@query("point_code n:i", "SELECT point_code, count(*) AS n FROM points WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1")
def s02_time_range(spark, d):
    return io.time_range(fx.points(spark, d), "2024-01-05", "2024-01-20", "ts").groupBy("point_code").agg(F.count("*").alias("n"))


@query("row_no:i model io_type variable_role point_code unit", f"""SELECT row_no, chosen AS model, io_type, role AS variable_role, point_code, unit
    FROM specs WHERE chosen IN ({_IN})""")
def s03_variable_specs(spark, d):
    return io.variable_specs(fx.registry(spark, d), MODELS)


@query("row_no:i model", """SELECT row_no, CASE name WHEN 'AUTO' THEN 'AUTOMOBILE' ELSE name END AS model FROM (
    SELECT row_no, trim(unnest(string_split_regex(model || '、AUTO/ ' || unit || ',', '[，、/,]'))) AS name FROM registry) WHERE name <> ''""")
def s04_explode_models(spark, d):
    cells = fx.registry(spark, d).select("row_no", F.concat("model", F.lit("、AUTO/ "), "unit", F.lit(",")).alias("model"))
    return io.explode_models(cells, spark.createDataFrame([("AUTO", "AUTOMOBILE")], "alias string, model string"))


@query("point_code pos:i", f"""SELECT point_code, row_number() OVER (ORDER BY part, pos, point_code) - 1 AS pos
    FROM (SELECT point_code, min(part) AS part, arg_min(pos, part * 100000000 + pos) AS pos FROM (
    SELECT point_code, row_no AS pos, 0 AS part FROM specs WHERE chosen IN ('BUILDING') UNION ALL SELECT 'P' || n_nationkey, n_nationkey, 1
    FROM nation) GROUP BY 1)""")
def s05_point_codes(spark, d):
    extra = fx.table(spark, d, "nation").select(F.concat(F.lit("P"), "n_nationkey").alias("point_code"), F.col("n_nationkey").alias("pos"))
    return io.point_codes_for_models(io.variable_specs(fx.registry(spark, d), MODELS), ["BUILDING"], extra)


@query("ts:t click:f view:f", "SELECT ts, click, view FROM wide")
def s06_wide_csv(spark, d):
    path = fx.folder(spark, "csv")
    fx.wide(spark, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).write.option("header", True).csv(path)
    return io.read_wide_csv(spark, path, "ts", ["click", "view"])


@query("date click:f view:f signup:f", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, click, view, signup FROM wide")
def s07_custom_csv(spark, d):
    return io.custom_csv_columns(fx.wide(spark, d).select("ts", "signup", "click", "view"), "ts", "signup")


@query("chunk_id:i rows:i", f"SELECT CAST(floor(epoch(ts) / {CHUNK}) AS BIGINT) AS chunk_id, count(*) AS rows FROM wide GROUP BY 1")
def s08_write_frame(spark, d):
    path = fx.folder(spark, "frames")
    io.write_frame(grid.core(grid.halo_chunks(fx.frame(spark, d), CHUNK, 0, 0)), path)
    return spark.read.parquet(path).groupBy("chunk_id").agg(F.count("*").alias("rows"))


@query("point_code rows:i", "SELECT point_code, count(*) AS rows FROM long GROUP BY 1")
def s09_report(spark, d):
    root = fx.folder(spark, "reports")
    io.write_report(grid.resample_report(fx.long(spark, d)).select("point_code", "rows"), root, "m1", "quality", "rows")
    return spark.read.option("header", True).csv(f"{root}/m1/quality/rows")


@query("unit params_hash", """SELECT unit, sha1('{"unit":"' || unit || '","n":' || n || '}') AS params_hash
    FROM (SELECT point_code AS unit, count(*) AS n FROM points GROUP BY 1) WHERE n % 2 = 1""")
def s10_changed_units(spark, d):
    units = fx.points(spark, d).groupBy(F.col("point_code").alias("unit")).agg(F.count("*").alias("n")).withColumns({"params_hash": io.parameter_hash("unit", "n"), "size": F.col("n"), "mtime": F.lit(0)})
    return io.changed_units(units, units.filter("n % 2 = 0"))


_DAY = 86_400
_CHANGED = "point_code = 'error' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'"


def _spreads(chunks: DataFrame) -> DataFrame:
    """For each point of a chunk's core the rise over the two points before it, and the next value."""
    w = Window.partitionBy("chunk_id", "point_code").orderBy("ts", "value")
    recent = F.max("value").over(w.rowsBetween(-2, 0)) - F.min("value").over(w.rowsBetween(-2, 0))
    return chunks.withColumns({"spread": recent, "after": F.lead("value").over(w)}).filter("is_core").select("chunk_id", "point_code", "ts", "value", "spread", "after")


@query("chunk_id:i rows:i spread:g after:g rewritten", f"""WITH p AS (SELECT *, CAST(floor(epoch(ts) / {_DAY}) AS BIGINT) AS c FROM points),
    k AS (SELECT DISTINCT c AS chunk_id FROM p), f AS (SELECT k.chunk_id, p.*, p.c = k.chunk_id AS core FROM p
    JOIN k ON epoch(ts) >= k.chunk_id * {_DAY} - {_DAY} AND epoch(ts) < (k.chunk_id + 1) * {_DAY} + {_DAY}),
    s AS (SELECT *, max(value) OVER w - min(value) OVER w AS spread, lead(value) OVER (PARTITION BY chunk_id, point_code ORDER BY ts, value) AS after
    FROM f WINDOW w AS (PARTITION BY chunk_id, point_code ORDER BY ts, value ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT chunk_id, count(*) AS rows, avg(spread) AS spread, avg(after) AS after, chunk_id BETWEEN (SELECT min(c) - 1 FROM p
    WHERE {_CHANGED}) AND (SELECT max(c) + 1 FROM p WHERE {_CHANGED}) AS rewritten FROM s WHERE core GROUP BY 1""")
def s10_rebuild(spark, d):
    """A table of chunks, made from points of which one day of one code was other than it is now, and then mended.

    Chunks are marked with the run that wrote them; the result must equal a table made whole.
    """
    p = fx.points(spark, d)
    stale = p.withColumn("value", F.when(F.expr(_CHANGED), F.col("value") * 2 + 1).otherwise(F.col("value")))
    path = fx.folder(spark, "chunks")
    io.write_frame(_spreads(grid.halo_chunks(stale, _DAY, _DAY, _DAY)).withColumn("run", F.lit(1)), path)
    changed = p.filter(_CHANGED).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time")).filter("start_time is not null")
    io.rebuild_chunks(p, changed, lambda chunks: _spreads(chunks).withColumn("run", F.lit(2)), path, _DAY, _DAY, _DAY)
    table = spark.read.parquet(path).withColumn("chunk_id", F.col("chunk_id").cast("long"))
    return table.groupBy("chunk_id").agg(F.count("*").alias("rows"), F.avg("spread").alias("spread"), F.avg("after").alias("after"), (F.max("run") == 2).alias("rewritten"))


@query("start:t end:t", 'SELECT min(ts) AS start, max(ts) AS "end" FROM points')
def s11_time_bounds(spark, d):
    return io.time_bounds(fx.points(spark, d))


fx.ORACLES["s11_time_bounds"] = fx.ORACLES["s11_time_bounds"].replace("epoch_us(end) AS end", 'epoch_us("end") AS "end"')


@query("point_code raw_rows:i finite_rows:i valid_rate:f first_ts:t last_ts:t status", """SELECT c.point_code, coalesce(n, 0) AS raw_rows,
    coalesce(g, 0) AS finite_rows, coalesce(g / n, 0) AS valid_rate, a AS first_ts, b AS last_ts,
    CASE WHEN n IS NULL THEN 'missing_source' ELSE 'ok' END AS status FROM (SELECT DISTINCT 'U' || c_custkey AS point_code FROM customer) c LEFT JOIN
    (SELECT point_code, count(*) AS n, count(*) FILTER (isfinite(value)) AS g, min(ts) FILTER (isfinite(value)) AS a, max(ts) FILTER (isfinite(value))
    AS b FROM user_points GROUP BY 1) p USING (point_code)""")
def s12_point_coverage(spark, d):
    codes = fx.table(spark, d, "customer").select(F.concat(F.lit("U"), "c_custkey").alias("point_code")).distinct()
    return io.point_coverage(fx.user_points(spark, d), codes)


@query("model inputs:i outputs:i missing:i", f"""SELECT chosen AS model, count(*) FILTER (io_type = 'input') AS inputs, count(*) FILTER (io_type =
    'output') AS outputs, count(*) FILTER (s.p IS NULL) AS missing
    FROM specs LEFT JOIN (SELECT DISTINCT 'P' || s_nationkey AS p FROM supplier) s ON s.p = point_code WHERE chosen IN ({_IN}) GROUP BY 1""")
def s13_inventory(spark, d):
    there = fx.table(spark, d, "supplier").select(F.concat(F.lit("P"), "s_nationkey").alias("point_code"))
    return io.variable_inventory(io.variable_specs(fx.registry(spark, d), MODELS), there)


@query("window_id:i target horizon:i ts:t y:f yhat:f", "SELECT window_id, target, horizon, ts, y, yhat FROM fc")
def s14_arrays_to_forecasts(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("horizon", "y", "yhat")))
    arrays = fx.fc(spark, d).groupBy("window_id", "target", F.col("origin_ts").alias("cutoff")).agg(rows.alias("r"))
    arrays = arrays.select("window_id", "target", "cutoff", F.transform("r", lambda x: x["y"]).alias("y"), F.transform("r", lambda x: x["yhat"]).alias("yhat"))
    return io.arrays_to_forecasts(arrays, GRID)


@query("feature n:i mean:f scale:f", """SELECT point_code AS feature, count(value) AS n, avg(value) AS mean, CASE WHEN count(value) <= 1 THEN 1 ELSE
    sqrt(greatest(var_pop(value), 1e-12)) END AS scale FROM full_long GROUP BY 1""")
def s15_scaler_file(spark, d):
    path = fx.folder(spark, "scaler")
    io.save_scaler(scale.fit_scaler(fx.full_long(spark, d).withColumnRenamed("point_code", "feature")), path)
    return io.load_scaler(spark, path)


@query("point_code source_last:t source_finite:i negative_share:f median:f", """SELECT * FROM (SELECT point_code, max(ts) AS source_last, count(*)
    FILTER (isfinite(value)) AS source_finite FROM points WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
    FULL JOIN (SELECT point_code, avg(CAST(value < 0 AS INT)) AS negative_share, quantile_cont(value, 0.5) AS median FROM long WHERE value IS NOT NULL
    GROUP BY 1) USING (point_code)""")
def s16_source_cache_audit(spark, d):
    return io.source_cache_audit(fx.points(spark, d), fx.long(spark, d), "2024-01-10")


@query("window_id:i target horizon:i final:f raw:f", "SELECT window_id, target, horizon, CASE WHEN y0 > 0 THEN yhat END AS final, yhat AS raw FROM fc")
def s17_write_scores(spark, d):
    path = fx.folder(spark, "scores")
    io.write_scores(fx.fc(spark, d).select("window_id", "target", "horizon", F.when(F.col("y0") > 0, F.col("yhat")).otherwise(float("nan")).alias("final"), F.col("yhat").alias("raw")), path)
    return spark.read.parquet(path)


# Expressions


@query("event_id:i value:f", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND isfinite(value)")
def f01_finite(spark, d):
    e = fx.table(spark, d, "events")
    return e.filter(scalar.finite(F.col("value"))).select("event_id", "value")


@query("event_id:i value:f", "SELECT event_id, CASE WHEN value BETWEEN 5 AND 80 THEN value END AS value FROM events")
def f02_bound(spark, d):
    return fx.table(spark, d, "events").select("event_id", scalar.bound(F.col("value"), 5, 80).alias("value"))


@query("row_no:i low:f high:f", """SELECT row_no, CASE WHEN point_code LIKE '%P1%' THEN 1 WHEN upper(point_name) LIKE '%0001%' THEN 2 WHEN unit = '%'
    THEN 0 END AS low,
    CASE WHEN point_code LIKE '%P1%' THEN 10 WHEN upper(point_name) LIKE '%0001%' THEN 20 WHEN unit = '%' THEN 100 END AS high FROM registry""")
def f03_ranges(spark, d):
    ranges = spark.createDataFrame([("p1", 0, 1.0, 10.0), ("0001", 1, 2.0, 20.0)], "token string, pos int, low double, high double")
    return scalar.range_for_specs(fx.registry(spark, d).select("row_no", "point_code", "point_name", "target_name", "unit"), ranges)


@query("row_no:i excluded model", """SELECT row_no, CASE WHEN include_manual IS NOT NULL THEN include_manual = 'false' ELSE include_advice <> '' END
    AS excluded, coalesce(manual_model, model) AS model FROM registry""")
def f04_inclusion(spark, d):
    r = fx.registry(spark, d)
    return r.select("row_no", scalar.is_excluded(F.col("include_manual"), F.col("include_advice")).alias("excluded"), scalar.effective(F.col("manual_model"), F.col("model")).alias("model"))


@query("row_no:i input output", "SELECT row_no, io_type = 'input' AS input, io_type = 'output' AS output FROM registry")
def f05_roles(spark, d):
    t = F.concat(F.lit(" "), F.upper("io_type"))
    return fx.registry(spark, d).select("row_no", scalar.is_input(t).alias("input"), scalar.is_output(t).alias("output"))


@query("ts:t click:f absent:f", "SELECT ts, click, CAST(NULL AS DOUBLE) AS absent FROM wide")
def f06_ensure_columns(spark, d):
    return scalar.ensure_columns(fx.wide(spark, d), ["click", "absent"])


@query("ts:t click:f view:f", "SELECT ts, click, view FROM wide")
def f07_drop_columns(spark, d):
    return scalar.drop_columns(fx.wide(spark, d), ["error", "purchase", "signup"])


@query("ts:t click:f signup:f", "SELECT ts, click, signup FROM wide")
def f08_series_whitelist(spark, d):
    return fx.wide(spark, d).select("ts", *scalar.filter_input_series(CODES, ["signup"], ["click"]))


_SUM3 = "CASE WHEN click IS NULL AND error IS NULL AND view IS NULL THEN NULL ELSE coalesce(click, 0) + coalesce(error, 0) + coalesce(view, 0) END"


@query("ts:t mean3:f sum3:f share:f ratio:f", f"""SELECT ts, s / nullif(CAST(click IS NOT NULL AS INT) + CAST(error IS NOT NULL AS INT) + CAST(view IS
    NOT NULL AS INT), 0) AS mean3, s AS sum3, click / nullif(s, 0) AS share,
    click / (click + view + 1e-5) AS ratio FROM (SELECT *, {_SUM3} AS s FROM wide)""")
def f09_f13_derived(spark, d):
    config = [{"name": "mean3", "kind": "mean", "sources": ["click", "error", "view"]}, {"name": "sum3", "kind": "sum", "sources": ["click", "error", "view"]}, {"name": "share", "kind": "share", "sources": ["click", "error", "view"]},
              {"name": "ratio", "kind": "ratio", "sources": ["click", "view"]}, {"name": "gone", "kind": "ratio", "sources": ["click", "absent"]}]
    return scalar.add_derived(fx.wide(spark, d), config)[0]


@query("ts:t month:f day:f weekday:f hour:f minute:f second:f", """SELECT ts, month(ts) / 12 AS month, day(ts) / 31 AS day, (isodow(ts) - 1) / 6 AS
    weekday, hour(ts) / 23 AS hour, minute(ts) / 59 AS minute, second(ts) / 59 AS second FROM wide""")
def f14_time_marks(spark, d):
    return fx.wide(spark, d).select("ts", *(c.alias(k) for k, c in scalar.time_marks("ts").items()))


@query("event_id:i minute:f hour:f weekday:f day:f yearday:f", """SELECT event_id, minute(ts) / 59 - 0.5 AS minute, hour(ts) / 23 - 0.5 AS hour,
    (isodow(ts) - 1) / 6 - 0.5 AS weekday, (day(ts) - 1) / 30 - 0.5 AS day,
    (dayofyear(ts) - 1) / 365 - 0.5 AS yearday FROM events""")
def f15_time_features(spark, d):
    e = fx.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", *(c.alias(k) for k, c in scalar.time_features("ts", "min").items()))


@query("event_id:i month:i day:i weekday:i hour:i minute:i", """SELECT event_id, month(ts) AS month, day(ts) AS day, isodow(ts) - 1 AS weekday,
    hour(ts) AS hour, minute(ts) // 15 AS minute FROM events""")
def f16_integer_stamps(spark, d):
    e = fx.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", *(c.alias(k) for k, c in scalar.integer_stamps("ts", True).items()))


_SCALER = """SELECT point_code, avg(value) AS mean, CASE WHEN count(value) <= 1 THEN 1 ELSE sqrt(greatest(var_pop(value), 1e-12)) END AS scale
    FROM full_long GROUP BY 1"""


@query("feature ts:t z:f back:f", f"""SELECT point_code AS feature, ts, coalesce((value - mean) / scale, 0) AS z, coalesce((value - mean) / scale, 0)
    * scale + mean AS back FROM full_long JOIN ({_SCALER}) USING (point_code)""")
def f17_standardize(spark, d):
    x = fx.full_long(spark, d).withColumnRenamed("point_code", "feature")
    return scale.apply_scaler(x, scale.fit_scaler(x)).withColumn("back", scalar.destandardize(F.col("z"), F.col("mean"), F.col("scale")))


@query("feature ts:t value:f", f"""SELECT point_code AS feature, ts, CASE WHEN point_code IN ('error', 'view') THEN mean ELSE value END AS value
    FROM full_long JOIN ({_SCALER}) USING (point_code)""")
def f18_missing_policy(spark, d):
    x = fx.full_long(spark, d).withColumnRenamed("point_code", "feature")
    return scale.apply_missing_policy(x, scale.fit_scaler(x), ["error", "view"])


@query("ts:t click:f error:f", "SELECT ts, coalesce(click, 0) AS click, coalesce(error, 0) AS error FROM wide")
def f19_fill_zero(spark, d):
    return scalar.fill_zero(fx.wide(spark, d), CODES)


@query("row_no:i name label", """SELECT row_no, replace(replace(point_name, '#', '#'), ' ', '_') AS name, strftime(TIMESTAMP '2024-01-01' +
    to_seconds(row_no), '%Y%m%dT%H%M%S') AS label FROM registry""")
def f35_text(spark, d):
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("row_no"))
    return fx.registry(spark, d).select("row_no", scalar.safe_name(F.col("point_name")).alias("name"), scalar.time_label(at).alias("label"))


@query("point_code rows:i non_null:i changed:i status", """SELECT point_code, count(*) AS rows, count(value) AS non_null, 0 AS changed,
    'not_applied_strict_raw_window' AS status FROM full_long GROUP BY 1""")
def f36_clean_audit(spark, d):
    return quality.clean_audit(fx.full_long(spark, d))


@query("point_code ts:t masked value:f", None)
def f28_mask_random(spark, d):
    return scalar.mask_random(fx.long(spark, d), "value", 0.25, 7, "point_code", "ts")


@query("point_code ts:t value:f", f"""SELECT point_code, ts, coalesce(value, av + (bv - av) * ((epoch_us(ts) - a_t) / nullif(b_t - a_t, 0)), av, bv)
    AS value FROM (
    SELECT *, last_value(value IGNORE NULLS) OVER b AS av, last_value(CASE WHEN value IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER b AS a_t,
    first_value(value IGNORE NULLS) OVER a AS bv, first_value(CASE WHEN value IS NOT NULL THEN epoch_us(ts) END IGNORE NULLS) OVER a AS b_t
    FROM full_long
    WINDOW b AS (PARTITION BY point_code, floor(epoch(ts) / {CHUNK})
    ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY point_code, floor(epoch(ts) / {CHUNK})
    ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def f29_interpolate(spark, d):
    x = fx.full_long(spark, d).withColumn("sample", F.floor(F.unix_seconds("ts") / CHUNK))
    return x.withColumn("value", windows.interpolate_linear(x, "value", ["point_code", "sample"]))


@query("point_code block:i value:f", f"""SELECT point_code, c * 100000 + (rn - 1) // 10 AS block, avg(value) AS value
    FROM (SELECT *, CAST(floor(epoch(ts) / {CHUNK}) AS BIGINT) AS c, row_number() OVER (PARTITION BY point_code, floor(epoch(ts) / {CHUNK})
    ORDER BY ts) AS rn FROM long) GROUP BY 1, 2""")
def f30_block_mean(spark, d):
    x = fx.long(spark, d).withColumn("c", F.floor(F.unix_seconds("ts") / CHUNK))
    return windows.block_mean(x, "value", 10, ["point_code", "c"]).withColumn("block", F.col("c") * 100_000 + F.col("block"))


@query("id:i kept:i total:f", 'SELECT id, len(v) AS kept, list_sum(v) AS total FROM (SELECT id, "values"[1:len("values"):3] AS v FROM samples)')
def f30_subsample(spark, d):
    s = fx.samples(spark, d).withColumn("v", scalar.subsample(F.col("values"), 32, 3))
    return s.select("id", F.size("v").alias("kept"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("id:i total:f kept:i", 'SELECT id, list_sum("values") AS total, len("values") AS kept FROM samples')
def f31_pad(spark, d):
    s = fx.samples(spark, d).withColumns({"p": scalar.pad_sequence(F.col("values"), 80), "m": scalar.pad_mask(F.col("values"), 80)})
    return s.select("id", F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(F.filter("m", lambda x: x)).alias("kept"))


@query("id:i center:f scale:f first:f", """SELECT id, list_avg("values") AS center, sqrt(list_var_pop("values") + 1e-5) AS scale, ("values"[1] -
    list_avg("values")) / sqrt(list_var_pop("values") + 1e-5) AS first FROM samples""")
def f32_instance_norm(spark, d):
    s = fx.samples(spark, d).withColumn("s", scalar.instance_norm(F.col("values")))
    return s.select("id", "s.center", "s.scale", F.get("s.values", F.lit(0)).alias("first"))


@query("point_code ts:t scaled:f", """SELECT point_code, ts, (least(greatest(value, a), b) - a) / nullif(b - a, 0) AS scaled FROM long
    JOIN (SELECT point_code, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM long GROUP BY 1) USING (point_code)""")
def f33_robust_rescale(spark, d):
    return scale.robust_rescale(fx.long(spark, d), "value", ["point_code"])


@query("window_id:i target horizon:i weight:f", "SELECT window_id, target, horizon, greatest(exp(-0.5 * (horizon - 1)), 0.3) AS weight FROM fc")
def f34_time_weight(spark, d):
    return fx.fc(spark, d).withColumn("weight", scalar.time_weight(F.col("horizon") - 1, 0.5, 0.3))


# Grid and joins


@query("point_code ts:t value:f raw_count:i", """SELECT point_code, make_timestamp(b) AS ts, CASE WHEN count(*) = 3 THEN avg(value) END AS value,
    count(*) AS raw_count FROM (
    SELECT *, epoch_us(ts) + ((-epoch_us(ts)) % 3600000000 + 3600000000) % 3600000000 AS b FROM points WHERE isfinite(value)) GROUP BY point_code, b""")
def a01_resample(spark, d):
    return grid.resample(fx.points(spark, d), 3600, 3)


@query("point_code ts:t value:f", """SELECT point_code, make_timestamp(b) AS ts, avg(value) AS value
    FROM (SELECT *, epoch_us(ts) + ((-epoch_us(ts)) % 86400000000 + 86400000000) % 86400000000 AS b FROM user_points WHERE isfinite(value))
    GROUP BY point_code, b""")
def a02_resample_many(spark, d):
    return grid.resample(fx.user_points(spark, d), 86_400)


@query("point_code rows:i non_null:i missing_rate:f first_ts:t last_ts:t", """SELECT point_code, count(*) AS rows, count(value) AS non_null, 1 -
    count(value) / count(*) AS missing_rate, min(ts) AS first_ts, max(ts) AS last_ts FROM long GROUP BY 1""")
def a03_resample_report(spark, d):
    return grid.resample_report(fx.long(spark, d))


@query("ts:t click:f error:f purchase:f signup:f view:f", "SELECT * FROM wide")
def j01_to_wide(spark, d):
    return fx.wide(spark, d)


@query("ts:t click:f view:f", """SELECT make_timestamp(b) AS ts, avg(CASE WHEN point_code = 'click' THEN value END) AS click, avg(CASE WHEN
    point_code = 'view' THEN value END) AS view FROM (
    SELECT *, epoch_us(ts) + ((-epoch_us(ts)) % 3600000000 + 3600000000) % 3600000000 AS b FROM points
    WHERE isfinite(value) AND point_code IN ('click', 'view')) GROUP BY b""")
def j02_audit_wide(spark, d):
    return grid.audit_wide(fx.points(spark, d), 3600, ["click", "view"])


_RUNS = """SELECT min(ts) AS start_time, max(ts) AS end_time, count(*) AS rows
    FROM (SELECT ts, sum(CASE WHEN gap IS NULL OR gap > {gap} THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS run FROM (
    SELECT ts, epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)) AS gap FROM {src} WHERE {cond})) GROUP BY run"""
_HIGH = _RUNS.format(gap=GRID, src="wide", cond="click > 60")


@query("ts:t inside", f"SELECT ts, EXISTS (SELECT 1 FROM ({_HIGH}) i WHERE w.ts BETWEEN i.start_time AND i.end_time) AS inside FROM wide w")
def j03_interval_mask(spark, d):
    w = fx.wide(spark, d)
    runs = intervals.intervals(w.withColumn("f", F.col("click") > 60), "f", GRID, 0, "high", chunk=CHUNK)
    return intervals.interval_mask(w, runs, "inside")


@query("chunk_id:i problem", f"""SELECT coalesce(a.c, b.c) AS chunk_id, CASE WHEN a.c IS NULL THEN 'unknown' WHEN b.c IS NULL AND a.n > 0 THEN
    'missing' WHEN a.n <> b.n THEN 'outdated' END AS problem FROM
    (SELECT CAST(floor(epoch(input_start_time) / {CHUNK}) AS BIGINT) AS c, count(*) AS n FROM win GROUP BY 1) a FULL
    JOIN (SELECT c + CASE WHEN c % 5 = 0 THEN 1000 ELSE 0 END AS c, n + CASE WHEN c % 3 = 0 THEN 1 ELSE 0 END AS n FROM
    (SELECT CAST(floor(epoch(input_start_time) / {CHUNK}) AS BIGINT) AS c, count(*) AS n FROM win GROUP BY 1)) b ON a.c = b.c
    WHERE a.c IS NULL OR b.c IS NULL OR a.n <> b.n""")
def j06_validate_splits(spark, d):
    m = fx.windows(spark, d).groupBy("chunk_id").agg(F.count("*").alias("windows"))
    s = m.select(F.when(F.col("chunk_id") % 5 == 0, F.col("chunk_id") + 1000).otherwise(F.col("chunk_id")).alias("chunk_id"), (F.col("windows") + (F.col("chunk_id") % 3 == 0).cast("int")).alias("windows"))
    return splits.validate_splits(m, s)


@query("chunk_id:i part n:i", f"""SELECT c AS chunk_id, CASE WHEN i <= k // 2 THEN 'calibration' ELSE 'replication' END AS part, n
    FROM (SELECT c, n, row_number() OVER (ORDER BY c) AS i, count(*) OVER () AS k FROM
    (SELECT CAST(floor(epoch(input_start_time) / {CHUNK}) AS BIGINT) AS c, count(*) AS n FROM win GROUP BY 1)) WHERE i <= k // 2 OR i > k // 2 + 1""")
def j07_select_chunks(spark, d):
    w = fx.windows(spark, d)
    return splits.select_chunks(w, w).groupBy("chunk_id", "part").agg(F.count("*").alias("n"))


@query("id:i other:i", """SELECT a.event_id AS id, b.event_id AS other FROM events a
    JOIN events b ON a.event_type = b.event_type AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 600 SECOND""")
def j11_prefix(spark, d):
    e = fx.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    o = e.select(F.col("event_id").alias("id"), F.col("ts").alias("origin_ts"), "event_type")
    return windows.prefix_of(o, e.select(F.col("event_id").alias("other"), "ts", "event_type"), 600, by=["event_type"])


# Quality

_QUALITY = """SELECT point_code, sum(n) AS rows, coalesce(sum(n) FILTER (value IS NOT NULL), 0) AS non_null, 1 - coalesce(sum(n) FILTER (value IS NOT
    NULL), 0) / sum(n) AS missing_rate,
    coalesce(sum(n) FILTER (abs(value) <= 1e-9) / sum(n) FILTER (value IS NOT NULL), 0) AS zero_ratio, max(n) FILTER (value IS NOT NULL) / sum(n)
    FILTER (value IS NOT NULL) AS constant_ratio, min(value) AS min, max(value) AS max,
    sum(value * n) / sum(n) FILTER (value IS NOT NULL) AS mean FROM (SELECT point_code, value, count(*) AS n FROM {src} GROUP BY 1, 2) GROUP BY 1"""


@query("point_code rows:i non_null:i missing_rate:f zero_ratio:f constant_ratio:f min:f max:f mean:f warn_missing", f"""SELECT *, missing_rate > 0.2
    AS warn_missing FROM ({_QUALITY.format(src='full_long')})""")
def a04_quality(spark, d):
    return quality.quality(fx.full_long(spark, d))


@query("point_code observed_rows:i missing_rate:f status", """SELECT c.point_code, coalesce(n, 0) AS observed_rows, 1 - coalesce(n, 0) / 360 AS
    missing_rate, CASE WHEN n IS NULL THEN 'missing_source' ELSE 'ok' END AS status FROM
    (SELECT DISTINCT point_code FROM points UNION ALL SELECT 'absent') c LEFT JOIN (SELECT point_code, count(*) AS n FROM long
    GROUP BY 1) USING (point_code)""")
def a05_quality_on_grid(spark, d):
    codes = fx.points(spark, d).select("point_code").distinct().unionByName(spark.createDataFrame([("absent",)], "point_code string"))
    return quality.quality_on_grid(fx.long(spark, d), codes, quality.expected_rows(datetime(2024, 1, 1), datetime(2024, 1, 31), GRID))


_USERS = "(SELECT point_code, CASE WHEN value < 60 THEN 0 ELSE round(value / 50) END AS value FROM user_points)"


def _coarse(spark, d):
    return fx.user_points(spark, d).withColumn("value", F.when(F.col("value") < 60, 0.0).otherwise(F.round(F.col("value") / 50)))


@query("point_code reasons", f"""SELECT point_code, concat_ws('|', CASE WHEN zero_ratio >= 0.75 THEN 'near_zero' END, CASE WHEN constant_ratio >= 0.75
    THEN 'constant' END) AS reasons FROM ({_QUALITY.format(src=_USERS)})
    WHERE (zero_ratio >= 0.75 OR constant_ratio >= 0.75) AND point_code <> 'U7'""")
def a06_low_information(spark, d):
    return quality.low_information(quality.quality(_coarse(spark, d)), None, ["U7"], 0.75)


@query("point_code reasons", f"""SELECT point_code, concat_ws('|', CASE WHEN non_null < 60 THEN 'too_few_non_null' END, CASE WHEN missing_rate >= 0.8
    THEN 'too_many_missing' END, CASE WHEN constant_ratio >= 0.8 THEN 'constant' END) AS reasons
    FROM ({_QUALITY.format(src=_USERS)}) WHERE non_null < 60 OR missing_rate >= 0.8 OR constant_ratio >= 0.8""")
def a07_unusable_outputs(spark, d):
    return quality.unusable_outputs(quality.quality(_coarse(spark, d)), None, 60, 0.8)


@query("point_code", f"SELECT point_code FROM ({_QUALITY.format(src=_USERS)}) WHERE NOT (non_null < 60 OR missing_rate >= 0.8 OR constant_ratio >= 0.8)")
def a07_usable_outputs(spark, d):
    return quality.usable_outputs(quality.quality(_coarse(spark, d)), None, least=60, limit=0.8)


@query("ts:t rate:f", f"SELECT ts, ({' + '.join(f'CAST({c} IS NOT NULL AS INT)' for c in CODES)}) / 5 AS rate FROM wide")
def a08_row_valid_rate(spark, d):
    return fx.wide(spark, d).withColumn("rate", quality.row_valid_rate(CODES))


_CUTS = f"""SELECT point_code, q AS q_low, m AS q50, h AS q95, q + greatest(m - q, 0) * 0.08 AS low_cut
    FROM (SELECT point_code, quantile_cont(value, 0.08) AS q, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.95) AS h FROM full_long
    GROUP BY 1)
    JOIN (SELECT point_code FROM ({_QUALITY.format(src='full_long')})
    WHERE missing_rate <= 0.5 AND zero_ratio <= 0.8 AND constant_ratio <= 0.8) USING (point_code) WHERE h > q"""


@query("point_code q_low:f q50:f q95:f low_cut:f", _CUTS)
def a09_low_candidates(spark, d):
    return quality.low_candidates(fx.full_long(spark, d))


@query("feature n:i mean:f scale:f", f"""SELECT point_code AS feature, count(value) AS n, avg(value) AS mean, CASE WHEN count(value) <= 1 THEN 1 ELSE
    sqrt(greatest(var_pop(value), 1e-12)) END AS scale FROM full_long JOIN frame f USING (ts)
    WHERE f.valid_for_training AND floor(epoch(ts) / {CHUNK}) < 3945 GROUP BY 1""")
def a10_fit_scaler(spark, d):
    train = fx.frame(spark, d).filter(F.col("valid_for_training") & (F.floor(F.unix_seconds("ts") / CHUNK) < 3945))
    return scale.fit_scaler(train.unpivot(["ts"], CODES, "feature", "value"))


@query("feature scale:f", f"SELECT point_code AS feature, scale FROM ({_SCALER}) WHERE scale > 25 OR point_code = 'click'")
def a11_near_constant(spark, d):
    return scale.drop_near_constant(scale.fit_scaler(fx.full_long(spark, d).withColumnRenamed("point_code", "feature")), ["click"], 25.0)


@query("point_code ts:t z:f m:f", """SELECT point_code, ts, coalesce((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 0) AS z,
    (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-9) AS m FROM user_points WINDOW w AS (PARTITION BY point_code)""")
def a12_normalize(spark, d):
    p = fx.user_points(spark, d)
    return p.withColumns({"z": scale.normalize(p, "standard", "value", ["point_code"]), "m": scale.normalize(p, "minmax", "value", ["point_code"])})


_CHUNK_ID = f"CAST(floor(epoch({{0}}) / {CHUNK}) AS BIGINT)"
_MANIFEST = f"""SELECT f.chunk_id, core_rows, valid_rows, coalesce(n, 0) AS windows, core_start, core_end
    FROM (SELECT {_CHUNK_ID.format('ts')} AS chunk_id, count(*) AS core_rows, count(*) FILTER (valid_for_training) AS valid_rows, min(ts) AS
    core_start,
    max(ts) AS core_end FROM frame GROUP BY 1) f LEFT JOIN (SELECT {_CHUNK_ID.format('input_start_time')} AS chunk_id, count(*) AS n FROM win
    GROUP BY 1) w ON w.chunk_id = f.chunk_id"""


def _manifest(spark, d):
    return splits.manifest(fx.chunked(spark, d), fx.windows(spark, d))


@query("chunk_id:i core_rows:i valid_rows:i windows:i core_start:t core_end:t", _MANIFEST)
def a13_manifest(spark, d):
    return _manifest(spark, d)


_SPLIT = f"""SELECT *, CASE WHEN cum <= total * 0.7 THEN 'train' WHEN cum - windows >= total * (0.7 + 0.15) THEN 'test' ELSE 'val' END AS split
    FROM (SELECT *, sum(windows) OVER (ORDER BY core_start) AS cum, sum(windows) OVER () AS total FROM ({_MANIFEST}) WHERE windows > 0)"""


@query("split chunks:i windows:i first_core:t last_core:t", f"""SELECT split, count(*) AS chunks, sum(windows) AS windows, min(core_start) AS
    first_core, max(core_end) AS last_core FROM ({_SPLIT}) GROUP BY 1""")
def a14_split_summary(spark, d):
    return splits.split_summary(splits.split_chunks(_manifest(spark, d)))


@query("chunk_id:i windows:i split", _SPLIT)
def d01_split_chunks(spark, d):
    return splits.split_chunks(_manifest(spark, d))


@query("chunk_id:i split", f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY core_start) AS i
    FROM ({_SPLIT})), b AS (SELECT chunk_id, i, CASE WHEN i > k - 1 AND i <= k + 1 THEN 'purge' ELSE split END AS split FROM
    (SELECT *, max(i) FILTER (split = 'train') OVER () AS k FROM a))
    SELECT chunk_id, CASE WHEN i > k - 1 AND i <= k + 1 THEN 'purge' ELSE split END AS split
    FROM (SELECT *, max(i) FILTER (split = 'val') OVER () AS k FROM b)""")
def d02_purge(spark, d):
    return splits.purge(splits.split_chunks(_manifest(spark, d)), 1)


@query("split n:i", """SELECT split, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM wide) w
    JOIN (VALUES ('train'), ('val'), ('test')) s(split) ON CASE split WHEN 'train' THEN p < CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) WHEN 'test'
    THEN p >= n - CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) - 6 ELSE p >= CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) - 6 AND p < n -
    CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) END GROUP BY 1""")
def d03_ratio_split(spark, d):
    w = windows.numbered(fx.wide(spark, d).select("ts"), ["ts"], "pos")
    return splits.in_ranges(w, splits.ratio_split(w.count(), SEQ), "pos").groupBy("split").agg(F.count("*").alias("n"))


@query("split n:i", """SELECT split, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS p FROM events) w
    JOIN (VALUES ('train', 0, 3600), ('val', 3594, 4800), ('test', 4794, 6000)) s(split, a, b) ON p >= a AND p < b GROUP BY 1""")
def d04_fixed_split(spark, d):
    e = windows.numbered(fx.table(spark, d, "events"), ["ts", "event_id"], "pos")
    return splits.in_ranges(e, splits.fixed_split(10, SEQ), "pos").groupBy("split").agg(F.count("*").alias("n"))


@query("point_code segment:i n:i", """SELECT point_code, segment, count(*) AS n FROM (SELECT *, sum(CASE WHEN g > 86400 THEN 1 ELSE 0 END) OVER
    (PARTITION BY point_code ORDER BY ts) AS segment FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY point_code ORDER BY ts)) AS g
    FROM user_points)) GROUP BY 1, 2""")
def w12_segments(spark, d):
    return intervals.segments(fx.user_points(spark, d), 86_400, ["point_code"]).groupBy("point_code", "segment").agg(F.count("*").alias("n"))


@query("split n:i", """SELECT CASE WHEN segment < 5 THEN 'train' WHEN rn > n - n * 2 // 10 THEN 'test' WHEN rn > n - n * 2 // 10 - n // 10 THEN 'val'
    ELSE 'train' END AS split, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY segment
    ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY segment) AS n FROM (SELECT *, (day(ts) - 1) // 5 AS segment FROM events)) GROUP BY 1""")
def d05_segment_split(spark, d):
    e = fx.table(spark, d, "events").withColumns({"segment": F.floor((F.dayofmonth("ts") - 1) / 5)})
    return splits.segment_split(e, 0.1, 0.2, 10).groupBy("split").agg(F.count("*").alias("n"))


@query("split n:i", """SELECT CASE WHEN p < n - n // 5 THEN 'train' ELSE 'val' END AS split, count(*) AS n
    FROM (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS p, count(*) OVER () AS n FROM events) GROUP BY 1""")
def d06_tail_split(spark, d):
    e = windows.numbered(fx.table(spark, d, "events"), ["ts", "event_id"], "pos")
    return splits.in_ranges(e, splits.tail_split(e.count()), "pos").groupBy("split").agg(F.count("*").alias("n"))


@query("part windows:i", """SELECT CASE WHEN i <= floor(n * 0.4) THEN 'calibration' ELSE 'evaluation' END AS part, count(*) AS windows
    FROM (SELECT row_number() OVER (ORDER BY window_id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT window_id FROM fc)) GROUP BY 1""")
def d07_calibration_split(spark, d):
    return splits.calibration_split(fx.fc(spark, d), "window_id").groupBy("part").agg(F.count_distinct("window_id").alias("windows"))


@query("chunk_id:i offset:i used:i", f"""SELECT chunk_id, cum - n AS "offset", greatest(least(n, 100 - (cum - n)), 0) AS used
    FROM (SELECT chunk_id, n, sum(n) OVER (ORDER BY chunk_id) AS cum FROM (SELECT {_CHUNK_ID.format('input_start_time')} AS chunk_id, count(*) AS n
    FROM win GROUP BY 1)) WHERE cum - n < 100""")
def d08_limit_windows(spark, d):
    return windows.limit_windows(fx.windows(spark, d).groupBy("chunk_id").agg(F.count("*").alias("windows")), 100)


fx.ORACLES["d08_limit_windows"] = fx.ORACLES["d08_limit_windows"].replace("CAST(offset AS BIGINT) AS offset", 'CAST("offset" AS BIGINT) AS "offset"')


@query("chunk_id:i n:i", f"SELECT {_CHUNK_ID.format('input_start_time')} AS chunk_id, count(*) AS n FROM win GROUP BY 1")
def d09_shuffle_by_chunk(spark, d):
    return windows.shuffle_by_chunk(fx.windows(spark, d), 3, 1, "input_start_time").groupBy("chunk_id").agg(F.count("*").alias("n"))


@query("split n:i mean:f std:f p10:f median:f p90:f", """SELECT CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS split,
    count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.9) AS p90 FROM points GROUP BY 1""")
def a15_distribution(spark, d):
    return scale.distribution(fx.points(spark, d).withColumn("split", F.when(F.col("ts") < F.lit("2024-01-20").cast("timestamp"), "train").otherwise("test")), "value", "split")


@query("point_code part missing_share:f", """SELECT point_code, CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN 'test' ELSE 'train' END AS part,
    avg(CAST(value IS NULL AS INT)) AS missing_share FROM full_long GROUP BY 1, 2""")
def a16_missing_by(spark, d):
    part = F.when(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"), "test").otherwise("train")
    return quality.missing_by(fx.full_long(spark, d).withColumn("part", part), "point_code", "part")


@query("ts:t fraction:f", f"""SELECT ts, sum({' + '.join(f'CAST({c} IS NULL AS INT)' for c in CODES)}) OVER (ORDER BY ts ROWS BETWEEN {SEQ - 1}
    PRECEDING AND CURRENT ROW) / {5 * SEQ} AS fraction FROM wide""")
def a17_window_missing(spark, d):
    x = grid.halo_chunks(fx.wide(spark, d), CHUNK, SEQ * GRID * 3, 0)
    return grid.core(x.withColumn("fraction", windows.window_missing_fraction((1 - quality.row_valid_rate(CODES)) * 5, SEQ, 5, ["chunk_id"])))


@query("instants:i hours:f", f"""SELECT count(DISTINCT f.ts) AS instants, count(DISTINCT f.ts) * {GRID} / 3600 AS hours FROM wide f
    JOIN win w ON f.ts BETWEEN w.target_start_time AND w.target_end_time""")
def a18_coverage(spark, d):
    return intervals.coverage(fx.windows(spark, d), "target_start_time", "target_end_time", GRID)


@query("rows:i pearson:f spearman:f status", """SELECT count(*) AS rows, corr(l_quantity, l_extendedprice) AS pearson, corr(rx, ry) AS spearman, 'ok'
    AS status FROM (SELECT *, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rx,
    rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS ry FROM lineitem)""")
def a19_response(spark, d):
    return scale.response_diagnostics(fx.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("bin:i median:g", """WITH e AS (SELECT unnest(quantile_cont(l_quantity, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS e FROM lineitem)
    SELECT (SELECT count(*) FROM (SELECT DISTINCT e FROM e) WHERE e < l_quantity) AS bin, quantile_cont(l_extendedprice, 0.5) AS median FROM lineitem
    GROUP BY 1""")
def a20_binned_medians(spark, d):
    return scale.binned_medians(fx.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 8)


@query("a b corr:f", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM wide" for i, a in enumerate(CODES) for b in CODES[i + 1 :]))
def a21_correlations(spark, d):
    return scale.correlations(fx.wide(spark, d), CODES)


@query("slope:g intercept:g rmse:g", """SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS
    intercept, sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity)) /
    count(*)) AS rmse FROM lineitem""")
def a22_linear_fit(spark, d):
    return scale.linear_fit(fx.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("lag:i corr:f", f"""SELECT k AS lag, corr(a.click, b.view) AS corr FROM (SELECT *, {_CHUNK_ID.format('ts')} AS c, row_number() OVER (PARTITION
    BY {_CHUNK_ID.format('ts')} ORDER BY ts) AS rn FROM wide) a CROSS JOIN range(-2, 3) t(k)
    JOIN (SELECT *, {_CHUNK_ID.format('ts')} AS c, row_number() OVER (PARTITION BY {_CHUNK_ID.format('ts')} ORDER BY ts) AS rn
    FROM wide) b ON b.c = a.c AND b.rn = a.rn + k GROUP BY 1""")
def a23_lag_correlation(spark, d):
    return scale.lag_correlation(fx.wide(spark, d).withColumn("c", F.floor(F.unix_seconds("ts") / CHUNK)), "click", "view", 2, ["c"], "ts")


@query("point_code low_cut:f high_cut:f", """SELECT point_code, quantile_cont(value, 1.0 / 3) AS low_cut, quantile_cont(value, 2.0 / 3) AS high_cut
    FROM long GROUP BY 1""")
def a25_tertiles(spark, d):
    return scale.tertile_cuts(fx.long(spark, d), "value", "point_code")


@query("bin:i first_ts:t valid:f", """SELECT (rn - 1) * 20 // n AS bin, min(ts) AS first_ts, avg(CAST(valid_for_training AS INT)) AS valid
    FROM (SELECT *, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM frame) GROUP BY 1""")
def a26_timeline(spark, d):
    f = windows.numbered(fx.frame(spark, d).select("ts", "valid_for_training"), ["ts"], "pos")
    n = f.count()
    return f.withColumn("bin", F.floor(F.col("pos") * 20 / F.lit(n))).groupBy("bin").agg(F.min("ts").alias("first_ts"), F.avg(F.col("valid_for_training").cast("int")).alias("valid"))


@query("point_code constant_ratio:f", f"""SELECT point_code, constant_ratio FROM ({_QUALITY.format(src=_USERS)})
    ORDER BY constant_ratio DESC, point_code LIMIT 12""")
def a27_report_top(spark, d):
    return windows.top(quality.quality(_coarse(spark, d)), 12, F.desc("constant_ratio"), F.col("point_code"))


@query("point_code bin:i density:f", """SELECT point_code, least(CAST(floor(value / 10) AS INT), 19) AS bin, count(*) / (sum(count(*)) OVER
    (PARTITION BY point_code) * 10) AS density FROM points WHERE value BETWEEN 0 AND 200 GROUP BY 1, 2""")
def a28_histogram(spark, d):
    return scale.histogram(fx.points(spark, d), "value", 0, 200, 20, "point_code")


@query("point_code bad:i min:f max:f", """SELECT point_code, count(*) FILTER (value IS NULL) AS bad, min(value) AS min, max(value) AS max
    FROM full_long GROUP BY 1""")
def m33_finite_audit(spark, d):
    return quality.finite_audit(fx.full_long(spark, d))


# Intervals and masks


@query("start_time:t end_time:t rows:i duration_seconds:f reason", f"""SELECT *, epoch(end_time) - epoch(start_time) AS duration_seconds, 'high' AS
    reason FROM ({_HIGH}) WHERE epoch(end_time) - epoch(start_time) >= {GRID}""")
def w01_intervals(spark, d):
    return intervals.intervals(fx.wide(spark, d).withColumn("f", F.col("click") > 60), "f", GRID, GRID, "high", chunk=CHUNK)


@query("ts:t low", f"""SELECT ts, EXISTS (SELECT 1 FROM ({_RUNS.format(gap=GRID * 1.5, src='wide', cond='signup < 45')}) i
    WHERE w.ts BETWEEN start_time AND end_time AND epoch(end_time) - epoch(start_time) >= {2 * GRID}) AS low FROM wide w""")
def w02_persistent(spark, d):
    return intervals.persistent(fx.wide(spark, d).withColumn("f", F.col("signup") < 45), "f", 2 * GRID, GRID, "low", CHUNK)


@query("ts:t smooth:f", """SELECT ts, CASE WHEN count(click) OVER w >= 2 THEN avg(click) OVER w END AS smooth FROM wide
    WINDOW w AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)""")
def w03_rolling_mean(spark, d):
    x = grid.halo_chunks(fx.wide(spark, d), CHUNK, 12 * GRID, 12 * GRID)
    return grid.core(x.withColumn("smooth", intervals.rolling_mean_centered(F.col("click"), 6, ["chunk_id"])))


@query("ts:t wide:i near:i", f"""SELECT ts, max(CAST(coalesce(click > 90, false) AS INT)) OVER (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
    AS wide, max(CAST(coalesce(click > 90, false) AS INT)) OVER (ORDER BY ts RANGE BETWEEN INTERVAL {GRID} SECOND PRECEDING AND INTERVAL {GRID} SECOND
    FOLLOWING) AS near FROM wide""")
def w04_expand_mask(spark, d):
    x = grid.halo_chunks(fx.wide(spark, d), CHUNK, 12 * GRID, 12 * GRID).withColumn("f", F.coalesce(F.col("click") > 90, F.lit(False)).cast("int"))
    return grid.core(x.withColumns({"wide": intervals.expand_mask(F.col("f"), 2, ["chunk_id"]), "near": intervals.expand_mask_seconds(F.col("f"), GRID, ["chunk_id"])}))


_LOW = f"SELECT ts, avg(CAST(coalesce(value, 'Infinity') <= low_cut AS INT)) AS share FROM full_long JOIN ({_CUTS}) USING (point_code) GROUP BY 1"
_SMOOTH = f"""SELECT ts, CASE WHEN count(share) OVER w >= 1 THEN avg(share) OVER w END AS smooth FROM ({_LOW})
    WINDOW w AS (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"""
_COMMON = _RUNS.format(gap=2 * GRID, src=f"({_SMOOTH})", cond=f"smooth >= 0.2 - 1e-9 AND (SELECT count(*) FROM ({_CUTS})) >= 5")


@query("start_time:t end_time:t rows:i", f"SELECT * FROM ({_COMMON}) WHERE epoch(end_time) - epoch(start_time) >= {GRID}")
def w05_common_low(spark, d):
    return intervals.common_low(fx.full_long(spark, d), 4, 0.2 - 1e-9, 2 * GRID, GRID, CHUNK, GRID)


@query("start_time:t end_time:t rows:i reason", f"""SELECT start_time, end_time, rows, 'collective_missing' AS reason
    FROM ({_RUNS.format(gap=GRID * 1.5, src='frame', cond='NOT valid_for_training')}) UNION ALL
    SELECT start_time, end_time, rows, 'shutdown:signup' FROM ({_RUNS.format(gap=GRID * 1.5, src='frame', cond='signup < 30')})
    WHERE epoch(end_time) - epoch(start_time) >= {GRID}""")
def w06_excluded(spark, d):
    return intervals.excluded_intervals(fx.wide(spark, d), CODES, {"signup": 30.0}, 0.0, GRID, GRID, CHUNK)


_SHUT = _RUNS.format(gap=GRID * 1.5, src="wide", cond="signup < 30")


@query("ts:t valid_for_training", f"""SELECT ts, valid_for_training AND bad = 0 AS valid_for_training
    FROM (SELECT *, max(b) OVER (ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS bad FROM (SELECT *, CAST(EXISTS (SELECT 1 FROM ({_SHUT}) i
    WHERE f.ts BETWEEN start_time AND end_time AND epoch(end_time) - epoch(start_time) >= {GRID}) AS INT) AS b FROM frame f))""")
def w07_training_mask(spark, d):
    return intervals.training_mask(fx.wide(spark, d), CODES, ["click"], (), {"signup": 30.0}, GRID, GRID, 1, CHUNK)


@query("chunk_id:i input_start_time:t input_end_time:t target_start_time:t target_end_time:t", f"""SELECT {_CHUNK_ID.format('input_start_time')} AS
    chunk_id, input_start_time, input_end_time, target_start_time, target_end_time FROM win""")
def w08_window_index(spark, d):
    return fx.windows(spark, d)


@query("origin:t feature n:i sum_x:f sum_y:f", f"""SELECT w.input_start_time AS origin, point_code AS feature, count(*) AS n, sum(value) FILTER (f.ts
    <= w.input_end_time) AS sum_x, sum(value) FILTER (epoch(f.ts) > epoch(w.input_end_time) - {2 * GRID}) AS sum_y
    FROM win w JOIN full_long f ON f.ts BETWEEN w.input_start_time AND w.target_end_time WHERE point_code IN ('click', 'view') GROUP BY 1, 2""")
def w09_materialize(spark, d):
    m = windows.materialize(fx.windows(spark, d), fx.frame(spark, d), ["click", "view"], SEQ, 2, PRED, GRID)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return m.select("origin", "feature", (F.size("seq_x") + F.size("seq_y") - 2).alias("n"), total("seq_x").alias("sum_x"), total("seq_y").alias("sum_y"))


@query("point_code start_pos:i total:f", """SELECT point_code, rn - 1 AS start_pos, s AS total
    FROM (SELECT *, row_number() OVER (PARTITION BY point_code ORDER BY ts) AS rn, count(*) OVER w AS n, sum(value) OVER w AS s FROM user_points
    WINDOW w AS (PARTITION BY point_code ORDER BY ts ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5 AND (rn - 1) % 5 = 0""")
def w10_strided_windows(spark, d):
    s = windows.strided_windows(fx.user_points(spark, d), 5, 5, ["value"], ["point_code"])
    return s.withColumn("total", F.aggregate("value_window", F.lit(0.0), lambda a, x: a + x))


@query("id:i patches:i last:f", 'SELECT id, (len("values") + 4 - 8) // 4 + 1 AS patches, "values"[len("values")] AS last FROM samples')
def w11_patches(spark, d):
    s = fx.samples(spark, d).withColumn("p", scalar.patches(F.col("values"), 8, 4, 4))
    return s.select("id", F.size("p").alias("patches"), F.element_at(F.element_at("p", -1), -1).alias("last"))


@query("chunk_id:i rows:i core:i", f"""SELECT c AS chunk_id, count(*) AS rows, count(*) FILTER (floor(epoch(ts) / {CHUNK}) = c) AS core
    FROM (SELECT DISTINCT {_CHUNK_ID.format('ts')} + k AS c FROM wide CROSS JOIN range(-1, 2) t(k))
    JOIN wide ON epoch(ts) >= c * {CHUNK} - 14400 AND epoch(ts) < (c + 1) * {CHUNK} + 21600 GROUP BY 1""")
def w13_halo_chunks(spark, d):
    return grid.halo_chunks(fx.wide(spark, d), CHUNK, 14_400, 21_599).groupBy("chunk_id").agg(F.count("*").alias("rows"), F.count_if("is_core").alias("core"))


fx.ORACLES["w13_halo_chunks"] = fx.ORACLES["w13_halo_chunks"].replace("c * 432000 - 14400 AND epoch(ts) < (c + 1) * 432000 + 21600", "c * 432000 - 14400 AND epoch(ts) < (c + 1) * 432000 + 14400 + 7199")


@query("ts:t spread:f delta:f", """SELECT ts, CASE WHEN count(click) OVER w = 5 THEN max(click) OVER w - min(click) OVER w END AS spread, click -
    lag(click, 5) OVER (ORDER BY ts) AS delta FROM wide WINDOW w AS (ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def w14_w15_trailing(spark, d):
    x = grid.halo_chunks(fx.wide(spark, d), CHUNK, 20 * GRID, 0)
    return grid.core(x.withColumns({"spread": windows.trailing_range(F.col("click"), 5, ["chunk_id"]), "delta": windows.history_delta("click", 5, ["chunk_id"])}))




@query("point_code ts:t trend:f remainder:f", """SELECT point_code, ts, (t3 + t5) / 2 AS trend, value - (t3 + t5) / 2 AS remainder
    FROM (SELECT *, (s3 + greatest(1 - p, 0) * f + greatest(p + 1 - (n - 1), 0) * l) / 3 AS t3, (s5 + greatest(2 - p, 0) * f + greatest(p + 2 - (n -
    1), 0) * l) / 5 AS t5 FROM (
    SELECT *, row_number() OVER o - 1 AS p, count(*) OVER a AS n, first_value(value) OVER a AS f, last_value(value) OVER a AS l, sum(value) OVER
    (PARTITION BY point_code ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s3,
    sum(value) OVER (PARTITION BY point_code ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s5 FROM user_points
    WINDOW o AS (PARTITION BY point_code ORDER BY ts), a AS (PARTITION BY point_code
    ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))""")
def w16_w17_decompose(spark, d):
    return windows.decompose(fx.user_points(spark, d), "value", [3, 5], ["point_code"])


@query("id:i first:f observed:i", 'SELECT id, CAST(0 AS DOUBLE) AS first, len("values") AS observed FROM samples')
def w22_insample(spark, d):
    s = fx.samples(spark, d).withColumn("w", windows.insample_window(F.col("values"), 80))
    return s.select("id", F.get("w.values", F.lit(0)).alias("first"), F.aggregate("w.mask", F.lit(0), lambda a, x: a + x).alias("observed"))


# Selections and checks


@query("point_code value:f", "SELECT point_code, arg_max(value, ts) AS value FROM points GROUP BY 1")
def k02_dedupe(spark, d):
    return grid.dedupe(fx.points(spark, d), ["point_code"], "ts")


@query("event_id:i", """SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events)
    WHERE p IN (SELECT i * (SELECT count(*) - 1 FROM events) // 49 FROM range(50) t(i))""")
def k03_linspace(spark, d):
    e = fx.table(spark, d, "events").select("event_id")
    return windows.linspace_sample(e, 50, ["event_id"], e.count())


@query("point_code ts:t", """SELECT point_code, ts FROM (SELECT *, row_number() OVER (PARTITION BY point_code ORDER BY ts) - 1 AS p FROM points)
    WHERE p % 18 = 0""")
def k04_stride(spark, d):
    return windows.stride_sample(fx.points(spark, d), 18, ["point_code"], "ts")


@query("chunk_id:i start:i end:i", f"""WITH RECURSIVE w AS (SELECT {_CHUNK_ID.format('input_start_time')} AS chunk_id, CAST(epoch(input_start_time) AS
    BIGINT) AS s, CAST(epoch(target_end_time) AS BIGINT) AS e FROM win),
    after AS (SELECT w.*, (SELECT min(v.s) FROM w v WHERE v.chunk_id = w.chunk_id AND v.s > w.e) AS next_s FROM w),
    g AS (SELECT * FROM after a WHERE s = (SELECT min(s) FROM w WHERE w.chunk_id = a.chunk_id) UNION ALL SELECT a.* FROM g
    JOIN after a ON a.chunk_id = g.chunk_id AND a.s = g.next_s),
    k AS (SELECT chunk_id, s, e, row_number() OVER (PARTITION BY chunk_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY chunk_id) AS n FROM g)
    SELECT chunk_id, s AS start, e AS "end" FROM k WHERE n <= 3 OR i IN (0, (n - 1) // 2, n - 1)""")
def k05_greedy(spark, d):
    w = fx.windows(spark, d).select("chunk_id", F.unix_seconds("input_start_time").alias("start"), F.unix_seconds("target_end_time").alias("end"))
    return windows.greedy_nonoverlap(w, 3)


fx.ORACLES["k05_greedy"] = fx.ORACLES["k05_greedy"].replace("CAST(end AS BIGINT) AS end", 'CAST("end" AS BIGINT) AS "end"')


@query("point_code ts:t value:f", """SELECT point_code, arg_min(ts, struct_pack(d := round(abs(value - q), 9), t := ts)) AS ts, arg_min(value,
    struct_pack(d := round(abs(value - q), 9), t := ts)) AS value FROM long JOIN (SELECT point_code, quantile_cont(value, 0.5) AS q FROM long
    GROUP BY 1) USING (point_code) GROUP BY 1""")
def k06_representative(spark, d):
    return windows.representative(fx.long(spark, d), "value", 0.5, ["point_code"], "ts")


@query("target window_id:i mae:f", """SELECT target, arg_max(window_id, struct_pack(m := mae, w := -window_id)) AS window_id, max(mae) AS mae
    FROM (SELECT target, window_id, round(avg(abs(y - yhat)), 6) AS mae FROM fc GROUP BY 1, 2) GROUP BY 1""")
def k07_worst(spark, d):
    one = fx.fc(spark, d).groupBy("target", "window_id").agg(F.round(F.avg(F.abs(F.col("y") - F.col("yhat"))), 6).alias("mae"))
    return windows.worst_case(one, "mae", ["target"], "window_id")


@query("vec_id:i kind", None)
def k09_limit_samples(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id")
    share = windows.limit_samples(e, 0.3, 5, "vec_id").withColumn("kind", F.lit("share"))
    return share.unionByName(windows.limit_samples(e, 40, 5, "vec_id").withColumn("kind", F.lit("count")))


@query("start_time:t end_time:t rows:i reason", f"SELECT DISTINCT start_time, end_time, rows, 'a' AS reason FROM ({_HIGH})")
def u01_union_reports(spark, d):
    runs = intervals.intervals(fx.wide(spark, d).withColumn("f", F.col("click") > 60), "f", GRID, 0, "a", chunk=CHUNK)
    return intervals.union_reports([runs, runs.drop("duration_seconds").withColumn("duration_seconds", (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6)])


@query("point_code problem", """SELECT point_code, 'missing' AS problem FROM (SELECT 'P' || n_nationkey AS point_code FROM nation EXCEPT
    SELECT 'P' || 2 * c_nationkey FROM customer) UNION ALL SELECT point_code, 'unexpected' FROM (SELECT DISTINCT 'P' || 2 * c_nationkey AS point_code
    FROM customer EXCEPT SELECT 'P' || n_nationkey FROM nation)""")
def u02_contract_diff(spark, d):
    want = fx.table(spark, d, "nation").select(F.concat(F.lit("P"), "n_nationkey").alias("point_code"))
    have = fx.table(spark, d, "customer").select(F.concat(F.lit("P"), 2 * F.col("c_nationkey")).alias("point_code")).distinct()
    return quality.contract_diff(want, have)


@query("point_code", "SELECT 'P' || 2 * c_nationkey AS point_code FROM customer INTERSECT SELECT 'P' || s_nationkey FROM supplier")
def u03_overlap(spark, d):
    a = fx.table(spark, d, "customer").select(F.concat(F.lit("P"), 2 * F.col("c_nationkey")).alias("point_code"))
    return quality.overlap(a, fx.table(spark, d, "supplier").select(F.concat(F.lit("P"), "s_nationkey").alias("point_code")))


@query("check ok", "SELECT * FROM (VALUES ('feature_count', true), ('target_count', true), ('positive_finite_scale', true), ('unique_features', true), ('targets_in_scaler', true), ('window', true)) t(\"check\", ok)")
def v01_contract(spark, d):
    s = scale.fit_scaler(fx.full_long(spark, d).withColumnRenamed("point_code", "feature")).withColumn("pos", F.array_position(F.array(*(F.lit(c) for c in CODES)), F.col("feature")))
    return quality.validate_contract(s, s.filter("feature in ('click', 'view')").select("pos", "feature"), {"features": 5, "targets": 2, "seq_len": SEQ, "label_len": 2, "pred_len": PRED})


fx.ORACLES["v01_contract"] = fx.ORACLES["v01_contract"].replace("SELECT check AS check", 'SELECT "check" AS "check"')


@query("status n:i", f"""SELECT status, count(*) AS n FROM (SELECT a.ts, CASE WHEN count(b.ts) <> {SEQ} THEN 'wrong_rows' WHEN max(b.ts) <> a.ts THEN
    'wrong_end' ELSE 'ok' END AS status FROM wide a JOIN wide b ON b.ts <= a.ts AND epoch(b.ts) > epoch(a.ts) - {SEQ * GRID} GROUP BY a.ts) GROUP BY 1""")
def v02_history(spark, d):
    w = fx.wide(spark, d).select("ts")
    h = windows.prefix_of(w.select(F.col("ts").alias("origin_ts"), F.unix_seconds("ts").alias("window_id")), w, SEQ * GRID)
    return quality.validate_history(h, SEQ, GRID).groupBy("status").agg(F.count("*").alias("n"))


@query("column problem", """SELECT code AS column, 'unexpected' AS problem FROM (SELECT DISTINCT event_type AS code FROM events)
    WHERE code NOT IN ('click', 'view') UNION ALL SELECT 'refund', 'missing_auxiliary' UNION ALL SELECT 'visit', 'missing' UNION ALL
    SELECT 'view', 'duplicate'""")
def v02_columns(spark, d):
    """The columns that a table of histories would have, one twice, against two features that it has and two that it hasn't."""
    codes = [r[0] for r in fx.points(spark, d).select("point_code").distinct().collect()]  # column names
    return quality.validate_columns(spark, ["timestamp", *codes, "view"], ["click", "view", "refund", "visit"], ["refund"])


fx.ORACLES["v02_columns"] = fx.ORACLES["v02_columns"].replace("SELECT code AS column", 'SELECT code AS "column"').replace("SELECT column AS column", 'SELECT "column" AS "column"')


@query("bad:i", "SELECT 0 AS bad")
def v03_windows(spark, d):
    return windows.validate_windows(fx.windows(spark, d), SEQ, PRED, GRID).agg(F.count("*").alias("bad"))


@query("ts:t target status", f"""WITH h AS (SELECT a.ts, a.point_code AS target, max(a.value) AS value, count(b.ts) AS n, count(b.value) AS m,
    max(b.value) - min(b.value) AS move FROM full_long a JOIN full_long b ON b.point_code = a.point_code AND b.ts <= a.ts AND epoch(b.ts) >
    epoch(a.ts) - {12 * GRID} GROUP BY 1, 2)
    SELECT h.ts, target, CASE WHEN value IS NULL THEN 'unavailable' WHEN c < 0.5 OR 1 - m / n > 0.2 OR value > 200 THEN 'degraded_persistence' WHEN
    move < 60 THEN 'short_horizon_corrected' ELSE 'model' END AS status FROM h JOIN (SELECT ts, sum(m) / sum(n) AS c FROM h GROUP BY 1) USING (ts)""")
def v04_status(spark, d):
    """Statuses by what each instant's last twelve rows have; forecasts of more than 200 count as not finite."""
    x = fx.full_long(spark, d)
    back = windows.prefix_of(x.select("point_code", F.col("ts").alias("origin_ts")), x.select("point_code", "ts", "value"), 12 * GRID, by=["point_code"])
    h = back.groupBy(F.col("origin_ts").alias("ts"), F.col("point_code").alias("target")).agg(F.count("*").alias("n"), F.count("value").alias("m"), (F.max("value") - F.min("value")).alias("move"), F.max_by("value", "ts").alias("value"))
    h = h.join(h.groupBy("ts").agg((F.sum("m") / F.sum("n")).alias("coverage")), "ts")
    told = h.withColumns({"current_missing": F.col("value").isNull(), "target_missing": 1 - F.col("m") / F.col("n"), "output_finite": ~F.coalesce(F.col("value") > 200, F.lit(False)), "gated": F.coalesce(F.col("move") < 60, F.lit(False))})
    return quality.guarded_status(told)


@query("chunk_id:i valid_rows:i manifest_valid_rows:i", f"""SELECT chunk_id, valid_rows, valid_rows + 1 AS manifest_valid_rows FROM ({_MANIFEST})
    WHERE chunk_id % 2 = 0""")
def v05_verify(spark, d):
    m = _manifest(spark, d).select("chunk_id", "valid_rows", "windows")
    return quality.verify_counts(m, m.withColumn("valid_rows", F.col("valid_rows") + (F.col("chunk_id") % 2 == 0).cast("int")))


@query("ragged:i min_length:i max_length:i lengths_differ", """SELECT count(*) FILTER (id % 3 = 0) AS ragged, min(len("values") - CAST(id % 3 = 0 AS
    INT)) AS min_length, max(len("values")) AS max_length, true AS lengths_differ FROM samples""")
def v06_lengths(spark, d):
    s = fx.samples(spark, d).withColumn("other", F.slice("values", F.lit(1), F.size("values") - (F.col("id") % 3 == 0).cast("int")))
    return quality.length_audit(s, ["values", "other"])


@query("event_id:i", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 20")
def k01_k08_first_rows(spark, d):
    return windows.top(fx.table(spark, d, "events"), 20, F.col("ts"), F.col("event_id"))


assert LENGTH == SEQ + PRED
