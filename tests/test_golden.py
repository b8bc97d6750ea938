"""Golden values of small cases, and rules that hold whatever the data."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridweave.functions import scalar
from gridweave.operators import calibrate, forecast, grid, intervals, jobs, quality, scale, spectrum, windows
from gridweave.streaming.grid import resample_stream

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def points(spark, rows, code="P"):
    return spark.createDataFrame([(code, at(s), float(v)) for s, v in rows], "point_code string, ts timestamp, value double")


def test_resample_completeness(spark):
    """Nineteen seconds: the first ten are a bucket, the other nine none."""
    p = points(spark, [(s, s) for s in range(1, 20)])
    got = grid.resample(p, 10, 10).orderBy("ts").collect()
    assert [(r.ts, r.value, r.raw_count) for r in got] == [(at(10), 5.5, 10), (at(20), None, 9)]
    twice = points(spark, [(s, s) for s in range(1, 10)] + [(9, 9)])
    assert [r.value for r in grid.resample(twice, 10, 10).collect()] == [pytest.approx(5.4)]
    assert [r.value for r in grid.resample(twice, 10, 10, distinct_seconds=True).collect()] == [None]
    assert grid.resample(points(spark, [(1, float("nan")), (2, float("inf"))]), 10).count() == 0


def test_bucket_before_1970(spark):
    df = spark.createDataFrame([(datetime(1969, 12, 31, 23, 59, 55),)], "ts timestamp")
    assert df.select(grid.bucket_end(F.col("ts"), 10)).first()[0] == datetime(1970, 1, 1)


def test_quality_on_grid(spark):
    long = points(spark, [(10, 1), (30, 3)], "X")
    codes = spark.createDataFrame([("X",), ("Y",)], "point_code string")
    n = quality.expected_rows(at(10), at(40), 10)
    got = {r.point_code: r for r in quality.quality_on_grid(long, codes, n).collect()}
    assert (n, got["X"].observed_rows, got["X"].missing_rate) == (3, 2, pytest.approx(1 / 3))
    assert got["Y"].status == "missing_source" and got["Y"].missing_rate == 1


def wide(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(at(10 * i), *(None if c[i] is None else float(c[i]) for c in columns.values())) for i in range(n)]
    return spark.createDataFrame(rows, "ts timestamp, " + ", ".join(f"{c} double" for c in columns))


def test_training_mask(spark):
    w = wide(spark, X=[1, None, 3], Y=[2, 2.5, 3])
    assert [r.valid_for_training for r in intervals.training_mask(w, ["X", "Y"], ["Y"]).orderBy("ts").collect()] == [True, False, True]
    w = wide(spark, required=[1, 2, 3], sparse=[None] * 3, target=[1, 2, 3])
    assert [r.valid_for_training for r in intervals.training_mask(w, ["required", "sparse", "target"], ["target"], ["sparse"]).orderBy("ts").collect()] == [True] * 3
    with pytest.raises(ValueError):
        intervals.training_mask(w, ["required"], ["target"], ["target"])


def test_derived_features_ignore_the_future(spark):
    config = [{"name": "m", "kind": "mean", "sources": ["A", "B"]}, {"name": "gone", "kind": "ratio", "sources": ["A", "Z"]}]
    df, notes = scalar.add_derived(wide(spark, A=[1000, 1000, 9000], B=[1000, None, 9000]), config)
    assert [r.m for r in df.orderBy("ts").collect()] == [1000, 1000, 9000]
    assert notes == [("gone", "not built: sources missing")]


def test_nothing_is_cleaned(spark):
    values = [10 + (i % 5) * 0.1 for i in range(200)]
    values[77] = 100.0
    long = points(spark, list(enumerate(values)))
    assert quality.clean_audit(long).first().asDict() == {"point_code": "P", "rows": 200, "non_null": 200, "changed": 0, "status": "not_applied_strict_raw_window"}


def test_decoder_input(spark):
    df = spark.createDataFrame([([1.0, 2.0, 7.0], [10.0, 30.0, 50.0])], "x array<double>, y array<double>")
    row = df.select(scalar.decoder_input(F.col("x"), 2, 3, False).alias("x"), scalar.decoder_input(F.col("y"), 2, 3, True).alias("y")).first()
    assert row.x == [2.0, 7.0, 7.0, 7.0, 7.0] and row.y == [30.0, 50.0, 40.0, 40.0, 40.0]


def fc(spark, yhat, y0, y=None):
    rows = [(1, "t", h + 1, at(10 * h), float((y or yhat)[h]), float(v), float(y0)) for h, v in enumerate(yhat)]
    return spark.createDataFrame(rows, "window_id long, target string, horizon int, ts timestamp, y double, yhat double, y0 double")


@pytest.mark.parametrize("history,gate", [([100.0] * 120, 1.0), ([90 + 10 * i / 119 for i in range(120)], 0.0), ([100.0] * 110 + [None] + [100.0] * 9, 0.0)])
def test_gated_shrink(spark, history, gate):
    h = spark.createDataFrame([(1, "t", history)], "window_id long, target string, history array<double>")
    got = forecast.gated_shrink(fc(spark, [102.0] * 60, 100), h, 1.0, 180).orderBy("horizon").collect()
    assert {r.gate for r in got} == {gate}
    assert all(r.yhat == 102 for r in got[17:])
    assert (got[0].yhat < 102) == (gate > 0)


def test_offset_correct(spark):
    usable = spark.createDataFrame([(1, "t", True)], "window_id long, target string, usable boolean")
    f = fc(spark, [2.8, 3.0, 3.4], 3.0)
    got = [r.yhat for r in forecast.offset_correct(f, usable, {"kind": "anchor", "limit": 1.0, "decay": 1e12}).orderBy("horizon").collect()]
    assert got == pytest.approx([3.0, 3.2, 3.6])
    got = [r.yhat for r in forecast.offset_correct(fc(spark, [4.0], 3.0), usable, {"kind": "anchor", "limit": 0.25, "decay": 9.0}).collect()]
    assert got == pytest.approx([3.75])
    with pytest.raises(ValueError):
        forecast.offset_correct(f, usable, {"kind": "other"})
    same = forecast.offset_correct(f, usable.withColumn("usable", F.lit(False)), {"kind": "constant", "bias": 5.0})
    assert sorted(r.yhat for r in same.collect()) == [2.8, 3.0, 3.4]


def test_confidence(spark):
    df = spark.createDataFrame([(0.6, 0.9, 0.9, 1.0), (-0.1, 0.55, 0.5, 1.0), (-0.01, 0.85, 0.9, 1.0), (0.6, 0.9, 0.9, 0.9)], "improvement double, direction double, coverage double, saved double")
    got = [(r.score, r.level) for r in calibrate.confidence(df).collect()]
    assert got[0] == (1.0, "high") and got[2][1] == "low" and got[1][0] < got[2][0] and got[3] == (0.65, "medium")


def test_scaler(spark):
    x = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("c", 5.0), ("c", 5.0), ("o", 2.0)], "feature string, value double")
    got = {r.feature: (r.mean, r.scale) for r in scale.fit_scaler(x).collect()}
    assert got["a"] == (2.0, 1.0) and got["c"] == (5.0, pytest.approx(1e-6)) and got["o"] == (2.0, 1.0)


def test_interval_gaps(spark):
    df = points(spark, [(0, 1), (10, 1), (20, 1), (40, 1), (51, 1), (500, 1)]).withColumn("f", F.lit(True))
    for chunk in (None, 15, 60, 10_000):
        got = intervals.intervals(df, "f", 20, 5, "r", chunk=chunk).orderBy("start_time").collect()
        assert [(r.start_time, r.end_time, r.rows, r.duration_seconds) for r in got] == [(at(0), at(51), 5, 51.0)]


@pytest.mark.parametrize("chunk", [60, 500, 100_000])
def test_windows_do_not_depend_on_chunks(spark, chunk):
    rows = [(at(10 * i + (5 if i > 70 else 0)), i % 23 != 0) for i in range(150)]
    frame = spark.createDataFrame(rows, "ts timestamp, valid_for_training boolean")
    whole = windows.window_index(frame.withColumn("chunk_id", F.lit(0)), 4, 2, 1, 10, core=None)
    got = windows.window_index(grid.halo_chunks(frame, chunk, 0, 50), 4, 2, 1, 10)
    times = lambda df: sorted((r.input_start_time, r.target_end_time) for r in df.collect())
    assert times(got) == times(whole) and len(times(whole)) > 50
    assert windows.validate_windows(got, 4, 2, 10).count() == 0


def test_greedy_nonoverlap(spark):
    df = spark.createDataFrame([(1, s, s + 4) for s in range(20)] + [(2, 0, 9)], "chunk_id int, start long, end long")
    got = sorted((r.chunk_id, r.start) for r in windows.greedy_nonoverlap(df, 16).collect())
    assert got == [(1, 0), (1, 5), (1, 10), (1, 15), (2, 0)]
    assert sorted(r.start for r in windows.greedy_nonoverlap(df.filter("chunk_id = 1"), 2).collect()) == [0, 15]


def test_interpolated_weights(spark):
    knots = spark.createDataFrame([("t", 2, 0.0), ("t", 4, 1.0)], "target string, horizon int, weight double")
    assert [r.weight for r in forecast.interpolate_weights(knots, 6).orderBy("horizon").collect()] == [0, 0, 0.5, 1, 1, 1]


def test_dtw(spark):
    df = spark.createDataFrame([(1, 2, [0.0, 1.0, 2.0, 2.0], [0.0, 0.0, 1.0, 2.0])], "a long, b long, x array<double>, y array<double>")
    assert jobs.dtw_pairs(df).first().distance == 0
    assert jobs.dtw_pairs(df, band=0).first().distance == 2
    assert jobs.shape_dtw_pairs(df).first().distance >= 0


def test_augmentations_are_seeded(spark):
    df = spark.createDataFrame([Row(id=i, values=[float((i * k) % 7) for k in range(30)]) for i in range(3)]).withColumn("label", F.lit(1))
    one = jobs.augment(df, list(jobs.AUGMENTATIONS), 3, 2).orderBy("id", "round").collect()
    assert one == jobs.augment(df.repartition(2), list(jobs.AUGMENTATIONS), 3, 2).orderBy("id", "round").collect()
    assert len({tuple(r["values"]) for r in one}) == 6 and all(len(r["values"]) == 30 for r in one)
    two = df.unionByName(df.withColumns({"id": F.col("id") + 10, "label": F.lit(2)}))
    for op in ("spawner", "barycentre", "guided", "guided_shape", "discriminative", "discriminative_shape"):
        assert jobs.augment_guided(two, "label", op, 1).count() == 6


def test_adf_tells_noise_from_walks(spark):
    import random

    rng, walk, rows = random.Random(1), 0.0, []
    for i in range(300):
        walk += rng.gauss(0, 1)
        rows += [("noise", i, rng.gauss(0, 1)), ("walk", i, walk)]
    got = {r.s: r.statistic for r in jobs.adf(spark.createDataFrame(rows, "s string, i int, v double"), "s", "v", "i").collect()}
    assert got["noise"] < -8 < -3 < got["walk"]


def test_dominant_period(spark):
    from math import pi, sin

    df = spark.createDataFrame([("s", i, sin(2 * pi * i / 12) + 5) for i in range(120)], "s string, i int, v double")
    assert spectrum.dominant_periods(df, 1, "s", "v", "i").first().period == 12


def test_stream_gives_what_batch_gives(spark, tmp_path):
    p = points(spark, [(s, s) for s in range(1, 60)])
    p.repartition(1).write.parquet(f"{tmp_path}/in")
    last = points(spark, [(500, 0)])
    last.repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = resample_stream(stream, 10, "10 seconds", 10).writeStream.format("memory").queryName("resampled").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.ts, r.value, r.raw_count) for r in spark.table("resampled").collect())
    want = sorted((r.ts, r.value, r.raw_count) for r in grid.resample(p, 10, 10).collect())
    assert got == want


def test_numbered_in_ranges(spark):
    from gridweave.operators import windows

    rows = [(None if k % 50 == 0 else (k * 7919) % 1000 // 3, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(4)
    got = sorted((r.pos, r.a, r.b) for r in windows.numbered(df, ["a", "b"], "pos").collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(k, *r) for k, r in enumerate(want)]
    assert windows.numbered(df.limit(0), ["a", "b"], "pos").count() == 0
    plan = windows.linspace_sample(df, 5, ["b"], 3000)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
