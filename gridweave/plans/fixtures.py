"""Sensor-style views of the given tables, in Spark and as DuckDB SQL, and the registry of queries.

A query has a spec that names its columns and how they are compared: ``name`` as is, ``name:i`` a whole number,
``name:f`` a double to eight places, ``name:g`` one to three, ``name:t`` a time in microseconds, ``name:d`` a date as text. The same spec is put
around the SQL, so both sides have the same names and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators.forecast import forecasts
from gridweave.operators.grid import halo_chunks, resample, to_wide
from gridweave.operators.windows import window_index
from gridweave.sources.scratch import folder  # noqa: F401  queries find it here

CODES = ["click", "error", "purchase", "signup", "view"]
GRID, SEQ, PRED, CHUNK = 7200, 6, 4, 432_000
LENGTH = SEQ + PRED

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _cast(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        c = F.col(name)
        out.append({"": c, "i": c.cast("long"), "f": F.round(c.cast("double"), 8) + 0.0, "g": F.round(c.cast("double"), 3) + 0.0, "t": F.unix_micros(c) if kind == "t" else c, "d": F.date_format(c, "yyyy-MM-dd") if kind == "d" else c}[kind].alias(name))
    return df.select(*out)


def _cast_sql(spec: str) -> str:
    kinds = {"": "{0}", "i": "CAST({0} AS BIGINT)", "f": "round(CAST({0} AS DOUBLE), 8) + 0.0", "g": "round(CAST({0} AS DOUBLE), 3) + 0.0", "t": "epoch_us({0})", "d": "strftime({0}, '%Y-%m-%d')"}
    parts = [item.partition(":") for item in spec.split()]
    return ", ".join(f"{kinds[k].format(n)} AS {n}" for n, _, k in parts)


def query(spec: str, sql: str | None = None):
    """Registers the function below under its name; sql may use the views of BASE."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: _cast(f(spark, sf_dir), spec)
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {BASE}, answer AS ({sql}) SELECT {_cast_sql(spec)} FROM answer"
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("point_code"), F.col("ts").cast("timestamp").alias("ts"), "value")


def user_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("U"), "user_id").alias("point_code"), F.col("ts").cast("timestamp").alias("ts"), "value")


def long(spark: SparkSession, sf_dir: str, seconds: int = GRID) -> DataFrame:
    """Grid means to six places, so that both engines go on from the same doubles."""
    return resample(points(spark, sf_dir), seconds).withColumn("value", F.round("value", 6))


def wide(spark: SparkSession, sf_dir: str, seconds: int = GRID) -> DataFrame:
    return to_wide(long(spark, sf_dir, seconds), CODES)


def complete() -> Column:
    out = F.lit(True)
    for c in CODES:
        out = out & F.col(c).isNotNull()
    return out


def frame(spark: SparkSession, sf_dir: str, seconds: int = GRID) -> DataFrame:
    return wide(spark, sf_dir, seconds).withColumn("valid_for_training", complete())


def chunked(spark: SparkSession, sf_dir: str, back: int = 0, forward: int = (LENGTH - 1) * GRID) -> DataFrame:
    return halo_chunks(frame(spark, sf_dir), CHUNK, back, forward)


def full_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, point_code, value) of the wide frame, nulls kept."""
    return wide(spark, sf_dir).unpivot(["ts"], CODES, "point_code", "value")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_index(chunked(spark, sf_dir), SEQ, PRED, 1, GRID)


def fc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts by the mean of the last three values."""
    model = F.round((F.col("value") + F.col("lag1") + F.col("lag2")) / 3, 6)
    return forecasts(frame(spark, sf_dir), windows(spark, sf_dir), CODES, PRED, GRID, model)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of variables out of the customers."""
    k = F.col("c_custkey")
    none = F.lit("")
    return table(spark, sf_dir, "customer").select(
        k.cast("long").alias("row_no"), F.col("c_mktsegment").alias("model"), F.when(k % 3 == 0, "output").otherwise("input").alias("io_type"), none.alias("role_group"), F.lit(" role ").alias("variable_role"),
        F.concat(F.lit("P"), "c_nationkey").alias("point_code"), F.col("c_name").alias("point_name"), F.when(k % 5 == 0, "%").otherwise("C").alias("unit"), none.alias("process_stage"), none.alias("target_name"),
        F.when(k % 13 == 0, "暂不纳入").otherwise("").alias("include_advice"), none.alias("control_priority"), F.when(k % 7 == 0, "BUILDING").alias("manual_model"), F.when(k % 4 == 0, "chosen").alias("manual_role"), F.when(k % 11 == 0, "false").alias("include_manual"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with a class, out of the embeddings: id, label, values."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("values"))


_ALL = " AND ".join(f"{c} IS NOT NULL" for c in CODES)
_D = GRID * 1_000_000
BASE = f"""
points AS (SELECT event_type AS point_code, CAST(ts AS TIMESTAMP) AS ts, value FROM events),
user_points AS (SELECT 'U' || user_id AS point_code, CAST(ts AS TIMESTAMP) AS ts, value FROM events),
long AS (SELECT point_code, make_timestamp(b) AS ts, round(avg(value), 6) AS value, count(*) AS raw_count
  FROM (SELECT *, epoch_us(ts) + ((-epoch_us(ts)) % {_D} + {_D}) % {_D} AS b FROM points WHERE value IS NOT NULL AND isfinite(value))
    GROUP BY point_code, b),
wide AS (SELECT ts, {', '.join(f"max(CASE WHEN point_code = '{c}' THEN value END) AS {c}" for c in CODES)} FROM long GROUP BY ts),
frame AS (SELECT *, ({_ALL}) AS valid_for_training FROM wide),
full_long AS ({' UNION ALL '.join(f"SELECT ts, '{c}' AS point_code, {c} AS value FROM wide" for c in CODES)}),
win AS MATERIALIZED (SELECT * FROM (SELECT ts AS input_start_time, lead(ts, {SEQ - 1}) OVER o AS input_end_time, lead(ts, {SEQ}) OVER o AS
    target_start_time, lead(ts, {LENGTH - 1}) OVER o AS target_end_time,
  sum(CAST(valid_for_training AS INT)) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING) AS nv, row_number() OVER o - 1 AS pos
    FROM frame WINDOW o AS (ORDER BY ts))
  WHERE nv = {LENGTH} AND epoch(target_end_time) - epoch(input_start_time) = {(LENGTH - 1) * GRID}),
fc AS MATERIALIZED (SELECT CAST(epoch(w.input_end_time) AS BIGINT) AS window_id, w.input_end_time AS origin_ts, a.point_code AS target, CAST(h.h AS
    BIGINT) AS horizon, b.ts, b.value AS y,
  round((a.value + l1.value + l2.value) / 3, 6) AS yhat, a.value AS y0
  FROM win w JOIN full_long a ON a.ts = w.input_end_time CROSS JOIN range(1, {PRED + 1}) AS h(h)
  JOIN full_long b ON b.point_code = a.point_code AND b.ts = w.input_end_time + to_seconds(h.h * {GRID})
  JOIN full_long l1 ON l1.point_code = a.point_code AND l1.ts = w.input_end_time - to_seconds({GRID})
  JOIN full_long l2 ON l2.point_code = a.point_code AND l2.ts = w.input_end_time - to_seconds({2 * GRID})),
registry AS (SELECT c_custkey AS row_no, c_mktsegment AS model, CASE WHEN c_custkey % 3 = 0 THEN 'output' ELSE 'input' END AS io_type, 'P' ||
    c_nationkey AS point_code, c_name AS point_name,
  CASE WHEN c_custkey % 5 = 0 THEN '%' ELSE 'C' END AS unit, CASE WHEN c_custkey % 13 = 0 THEN '暂不纳入' ELSE '' END AS include_advice, CASE WHEN
    c_custkey % 7 = 0 THEN 'BUILDING' END AS manual_model,
  CASE WHEN c_custkey % 4 = 0 THEN 'chosen' END AS manual_role, CASE WHEN c_custkey % 11 = 0 THEN 'false' END AS include_manual FROM customer),
specs AS (SELECT * FROM (SELECT *, coalesce(manual_model, model) AS chosen, coalesce(manual_role, 'role') AS role, row_number() OVER (PARTITION BY
    coalesce(manual_model, model), io_type, point_code ORDER BY row_no) AS rn
  FROM registry WHERE CASE WHEN include_manual IS NOT NULL THEN include_manual <> 'false' ELSE include_advice = '' END) WHERE rn = 1),
samples AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS "values" FROM embeddings)"""
