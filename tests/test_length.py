"""What must hold for series and tables of any length: the same rows whatever the size of chunks and ranges."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridweave.operators import calibrate, framed, intervals, jobs, order, scale, spectrum, windows

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    rows = []
    for name, n in (("a", 300), ("b", 64), ("c", 1), (None, 20)):
        at = START
        for _ in range(n):
            at += timedelta(seconds=rng.choice([10, 10, 10, 500]))
            rows.append((name, at, rng.gauss(0, 1) if rng.random() < 0.9 else None))
    return spark.createDataFrame(rows, "s string, ts timestamp, v double").repartition(4).cache()


def loops(series):
    out = {}
    for r in series.orderBy("ts").collect():
        out.setdefault(r.s, []).append((r.ts, r.v))
    return out


@pytest.mark.parametrize("chunk", [1000, 40, 5])
def test_framed(series, chunk):
    got = framed.framed(series, ["s"], ["ts"], 2, 3, lambda w: {"around": F.collect_list(F.coalesce("v", F.lit(9.0))).over(w.rowsBetween(-2, 3)), "after": F.lead("ts", 3).over(w)}, chunk).collect()
    want = loops(series)
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        rows = want[r.s]
        assert rows[r._pos][0] == r.ts and r._n == len(rows)
        assert r.around == [9.0 if v is None else v for _, v in rows[max(r._pos - 2, 0) : r._pos + 4]]
        assert r.after == (rows[r._pos + 3][0] if r._pos + 3 < len(rows) else None)


@pytest.mark.parametrize("chunk", [1000, 40, 5])
def test_series_operators(series, chunk):
    want = loops(series)
    got = {(r.s, r.ts): r for r in intervals.segments(series, 60, ["s"], chunk=chunk).collect()}
    smooth = {(r.s, r.ts): r for r in windows.decompose(series.na.fill(1.0, ["v"]), "v", [3, 5], ["s"], chunk=chunk).collect()}
    starts = {(r.s, r.start_pos): r.v_window for r in windows.strided_windows(series.na.fill(1.0, ["v"]), 7, 4, ["v"], ["s"], chunk=chunk).collect()}
    wanted = {}
    for name, rows in want.items():
        number, v = 0, [1.0 if x is None else x for _, x in rows]
        for k, (ts, _) in enumerate(rows):
            number += k > 0 and (ts - rows[k - 1][0]).total_seconds() > 60
            assert got[name, ts].segment == number
            around = lambda h, v=v, k=k: np.mean([v[min(max(i, 0), len(v) - 1)] for i in range(k - h, k + h + 1)])
            assert smooth[name, ts].trend == pytest.approx((around(1) + around(2)) / 2)
        wanted |= {(name, k): v[k : k + 7] for k in range(0, len(v) - 6, 4)}
    assert starts == wanted
    lags = {r.lag: r.corr for r in scale.lag_correlation(series.withColumn("w", F.col("v") * F.col("v")), "v", "w", 2, ["s"], "ts", chunk).collect()}
    for k in range(-2, 3):
        pairs = [(rows[i][1], rows[i + k][1] ** 2) for rows in want.values() for i in range(len(rows)) if 0 <= i + k < len(rows) and rows[i][1] is not None and rows[i + k][1] is not None]
        assert lags[k] == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1])


def test_unit_roots_by_chunks(series):
    whole, *others = ({r.s: r.statistic for r in jobs.adf(series.na.fill(1.0, ["v"]), "s", "v", "ts", chunk).collect()} for chunk in (10_000, 40, 5))
    for other in others:
        assert other == pytest.approx(whole)
    assert whole["a"] is not None


def test_numbered_where_one_value_is_most(spark):
    rng = random.Random(3)
    rows = [(1, k, rng.random()) for k in rng.sample(range(5000), 2000)] + [(None, 5, 0.1), (0, 3, 0.2), (1, 7, 0.3), (1, 7, 0.4)]
    df = spark.createDataFrame(rows, "c int, k int, v double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    ranged = order.in_ranges(df, ["c", "k"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranged.groupBy("_range").count().agg(F.max("count")).first()[0] < 0.6 * len(rows)
    got = sorted((r.i, r.c, r.k) for r in order.numbered(df, ["c", "k"], "i").collect())
    assert [g[0] for g in got] == list(range(len(rows)))
    assert [(c, k) for _, c, k in got] == sorted(((c, k) for c, k, _ in rows), key=lambda x: (x[0] is not None, x))


def test_input_of_quantiles_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(1000).mapInPandas(pass_on, "id long")
    found = order.quantiles_of(order.counted(df, {"a": "id", "b": F.col("id") % 7}), {"a": [0.5], "b": [0.0, 1.0]}).first()
    assert (found.a, found.b, seen.value) == ([499.5], [0.0, 6.0], 1000)


@pytest.mark.parametrize(("n", "chunk"), [(1, 8), (7, 64), (60, 16), (61, 32), (97, 64), (128, 16), (1009, 128)])
def test_spectrum(spark, n, chunk):
    rng = np.random.default_rng(n)
    rows = [(s, k, float(v)) for s in ("x", "y") for k, v in enumerate(rng.normal(size=n))] + [("short", 0, 2.0), ("short", 1, None), ("short", 2, float("nan"))]
    got = spectrum.spectrum(spark.createDataFrame(rows, "s string, k long, v double").repartition(3), "s", "v", "k", chunk).collect()
    for s in ("x", "y"):
        mine = {r.frequency: complex(r.re, r.im) for r in got if r.s == s}
        want = np.fft.fft([v for name, _, v in rows if name == s])
        assert sorted(mine) == list(range(n))
        assert np.allclose([mine[f] for f in range(n)], want)
    assert all(r.re == pytest.approx(2.0) for r in got if r.s == "short")


def test_spectrum_of_a_million(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("s").alias("s"), "id", (F.sin(F.col("id") * 0.37) + F.cos(F.col("id") * 0.01) * 2 + F.pmod(F.xxhash64("id"), F.lit(100)) / 300).alias("v"))
    got = spectrum.dominant_periods(df, 4, "s", "v", "id", 1 << 12).orderBy("rank").collect()
    size = np.abs(np.fft.rfft(df.orderBy("id").toPandas()["v"].to_numpy()))
    size[0] = 0
    best = np.argsort(-size, kind="stable")[:4]
    assert [r.period for r in got] == [n // int(f) for f in best]
    assert [r.amplitude for r in got] == pytest.approx(size[best])


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 304)) + 1e6 * rng.normal(size=304) + rng.normal(size=(500, 1))
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 7] = 3.0
    x[:, 8] = np.nan
    x[:490, 9] = np.nan
    names = [f"c{k}" for k in range(304)]
    frame = pd.DataFrame(x, columns=names)
    got = scale.correlations(spark.createDataFrame(frame).repartition(7), names).toPandas()
    assert len(got) == 304 * 303 // 2
    want = frame.corr().to_numpy()
    at = {n: k for k, n in enumerate(names)}
    a, b = got["a"].map(at).to_numpy(), got["b"].map(at).to_numpy()
    assert (a < b).all()
    both = ~(np.isin(a, [7, 8]) | np.isin(b, [7, 8]))
    assert np.allclose(got["corr"].to_numpy(float)[both], want[a, b][both], equal_nan=True)
    assert got["corr"][~both].isna().all()
    assert scale.correlations(spark.createDataFrame([], "p double, q double"), ["p", "q"]).count() == 0


def test_long_intervals_are_two_rows(spark):
    rng = random.Random(4)
    at = lambda s: START + timedelta(seconds=s)
    spans = [(at(s), at(s + rng.choice([0, 5, 40, 100_000]))) for s in rng.sample(range(1_000_000), 60)] + [(at(50), at(20))]
    rows = [(at(rng.randrange(1_200_000)), k) for k in range(500)] + [(b, k) for k, (a, b) in enumerate(spans)] + [(a, k) for k, (a, b) in enumerate(spans)] + [(None, 1), (at(7), 1), (at(7), 2)]
    df = spark.createDataFrame(rows, "ts timestamp, k int").repartition(3)
    got = intervals.interval_mask(df, spark.createDataFrame(spans, "start_time timestamp, end_time timestamp"), "inside").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.inside == (r.ts is not None and any(a <= r.ts <= b for a, b in spans))
    none = intervals.interval_mask(df, spark.createDataFrame([], "start_time timestamp, end_time timestamp"), "inside")
    assert not any(r.inside for r in none.collect())


@pytest.mark.parametrize("by", [None, "chunk_id"])
def test_greedy_on_one_timeline(spark, by):
    rng = random.Random(8)
    rows = [(c, s, s + rng.choice([0, 1, 3, 9, 60])) for c in range(3) for s in [*rng.sample(range(400), 150), 7, 7, 7]]
    got = sorted((r.chunk_id if by else 0, r.start, r.end) for r in windows.greedy_nonoverlap(spark.createDataFrame(rows, "chunk_id long, start long, end long"), 9, by=by).collect())
    want = []
    for c in range(3) if by else [None]:
        kept, last = [], -1
        for _, s, e in sorted(((0, s, e) for k, s, e in rows if c is None or k == c)):
            if s > last:
                kept.append((s, e))
                last = e
        want += [(c or 0, *kept[i * (len(kept) - 1) // 8]) for i in range(9)] if len(kept) > 9 else [(c or 0, *w) for w in kept]
    assert got == sorted(want)


def test_bootstrap_of_many_draws(spark):
    """10,000 draws over 1,000 days against draws of whole days with replacement."""
    rng = np.random.default_rng(5)
    e, p = rng.gamma(2.0, 1.0, 1000), rng.gamma(3.0, 1.0, 1000)
    df = spark.createDataFrame([("t", k, float(a), float(b)) for k, (a, b) in enumerate(zip(e, p, strict=True))], "target string, day int, e double, p double").repartition(3)
    got = calibrate.block_bootstrap(df, "day", 10_000, 11, lambda: 1 - F.sum("e") / F.sum("p"), ["target"])
    row = got.first()
    picks = rng.integers(0, 1000, (10_000, 1000))
    draws = 1 - e[picks].sum(1) / p[picks].sum(1)
    assert (row.low, row.high) == pytest.approx(tuple(np.quantile(draws, [0.025, 0.975])), abs=0.1 * draws.std())
    assert row.draws == 10_000
    assert calibrate.block_bootstrap(df.repartition(1), "day", 10_000, 11, lambda: 1 - F.sum("e") / F.sum("p"), ["target"]).first()[1:3] == pytest.approx(row[1:3])
