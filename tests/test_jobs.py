"""Numeric jobs and what SQL does not say, against plain loops."""

import math
import random
import struct
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from gridweave.functions import scalar
from gridweave.operators import calibrate, forecast, jobs, quality, windows
from gridweave.plans import catalog

SF = "/root/testdata/sf0.001"


def paths(n, length=20, seed=1):
    rng = random.Random(seed)
    return [(k, k % 3, [rng.gauss(0, 1) + (k % 3) * math.sin(i / 3) for i in range(length)]) for k in range(n)]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(paths(43), "id long, label int, values array<double>").repartition(4).cache()


def loop_dtw(x, y, cost, band=None, slope="symmetric", weight=1.0, shifts=1):
    n, m = len(x), len(y)
    width = max(n, m) if band is None else max(band, abs(n - m) if slope == "symmetric" else 0)
    total = {(0, 0): cost(x[0], y[0])}
    moves = [(1, 1), (1, 0), (1, 2)] if slope == "asymmetric" else [(1, 1), *((k, 0) for k in range(1, shifts + 1)), *((0, k) for k in range(1, shifts + 1))]
    for i in range(n):
        for j in range(m):
            if (i, j) != (0, 0) and abs(i - j) <= width:
                ways = [total[i - a, j - b] * (1 if a == b else weight) for a, b in moves if (i - a, j - b) in total]
                if ways:
                    total[i, j] = min(ways) + cost(x[i], y[j])
    return total.get((n - 1, m - 1), math.inf)


def test_warp_is_what_loops_make():
    rng = random.Random(3)
    apart = lambda a, b: abs(a - b)
    for n, m in ((1, 1), (5, 5), (9, 6), (6, 10), (30, 28)):
        for band in (None, 2, 5):
            for slope, weight, shifts in (("symmetric", 1.0, 1), ("asymmetric", 1.0, 1), ("symmetric", 1.7, 1), ("symmetric", 1.2, 3)):
                x, y = ([[rng.gauss(0, 1) for _ in range(k)] for _ in range(4)] for k in (n, m))
                got, _ = jobs.warp_all(jobs.costs(np.array(x), np.array(y)), band, slope, weight, shifts)
                assert got == pytest.approx([loop_dtw(a, b, apart, band, slope, weight, shifts) for a, b in zip(x, y, strict=True)])


def test_warping_off_the_diagonal_is_priced_by_the_move():
    """A path that stays beside the diagonal pays for getting there, not at each step."""
    x, y = np.array([[0.0, 0, 1, 2, 3, 4, 5]]), np.array([[0.0, 1, 2, 3, 4, 5, 5]])
    cost = jobs.costs(x, y) + 1
    assert jobs.warp_all(cost, None, "symmetric", 2.0)[0][0] == loop_dtw(x[0], y[0], lambda a, b: abs(a - b) + 1, None, "symmetric", 2.0)
    assert jobs.warp_all(cost, None, "symmetric", 1.0)[0][0] == 8.0


def test_dtw_of_queries_against_their_class(samples):
    want = {}
    rows = {k: (label, v) for k, label, v in paths(43)}
    for a in (0, 20, 40):
        for b, (label, v) in rows.items():
            if b != a and label == rows[a][0]:
                want[a, b] = loop_dtw(rows[a][1], v, lambda p, q: abs(p - q), 4)
    pairs = jobs.pairs(samples, "label", queries=F.col("id") % 20 == 0)
    got = jobs.dtw_pairs(pairs, 4, path=True).collect()
    assert {(r.a, r.b): r.distance for r in got} == pytest.approx(want)
    for r in got:
        steps = [(s.i, s.j) for s in r.path]
        assert steps[0] == (0, 0) and steps[-1] == (19, 19)
        assert all(0 <= c - a <= 1 and 0 <= d - b <= 1 and (a, b) != (c, d) for (a, b), (c, d) in zip(steps, steps[1:], strict=False))
        assert sum(abs(rows[r.a][1][i] - rows[r.b][1][j]) for i, j in steps) == pytest.approx(r.distance)
    assert jobs.pairs(samples, "label").count() == sum(1 for a in rows for b in rows if a < b and rows[a][0] == rows[b][0])


def test_pairs_are_dealt_in_parts(samples, monkeypatch):
    whole = {(r.a, r.b) for r in jobs.pairs(samples, "label").collect()}
    monkeypatch.setattr(jobs, "CLASS_ROWS", 3)
    parted = jobs.pairs(samples, "label").collect()
    assert len(parted) == len(whole) and {(r.a, r.b) for r in parted} == whole


@pytest.mark.parametrize("band", [None, 0, 2, 4])
def test_dtw_by_blocks(spark, band, monkeypatch):
    """Blocks have the pairs, distances and lengths of paths that pairs have, for paths of several lengths, with ties, and none."""
    rows = [(k, label, [float(round(x)) for x in v][: (20, 13, 20, 1, 0)[k % 5]]) for k, label, v in paths(43)] + [(50, None, [1.0])]
    df = spark.createDataFrame(rows, "id long, label int, values array<double>").repartition(4)
    monkeypatch.setattr(jobs, "BLOCK", (2, 3))
    for queries in (None, F.col("id") % 4 == 0):
        want = jobs.dtw_pairs(jobs.pairs(df, "label", queries=queries), band, path=True).select("a", "b", "distance", F.size("path").alias("steps")).collect()
        got = jobs.dtw_within(df, "label", queries=queries, band=band).collect()
        assert len(want) > 100 and sorted(got) == sorted(want)


def test_blocks_have_tasks_of_their_own(spark, monkeypatch):
    """Small blocks are much work: adaptive execution put those of 43 rows into one task."""
    df = spark.createDataFrame(paths(43), "id long, label int, values array<double>").repartition(4)
    monkeypatch.setattr(jobs, "BLOCK", (10, 10))
    pairs = jobs.dtw_within(df, "label", band=4, counted=False)
    assert pairs.columns == ["a", "b", "distance"]
    assert pairs.groupBy(F.spark_partition_id()).count().count() > 6


def test_strips_of_long_paths_are_narrow(monkeypatch):
    """Paths are warped in strips whose diagonals have bounded room, in whatever strips with the same results."""
    rng = np.random.default_rng(5)
    x, y = [rng.normal(size=30) for _ in range(3)], [rng.normal(size=30 + k % 2) for k in range(20)]
    left, right = (pd.DataFrame({a: [[at + k] for k in range(len(v))], b: v}) for a, b, v, at in (("a", "x", x, 5), ("b", "y", y, 0)))
    whole = [jobs._warped(left, right, None, once, shape, not shape) for once in (False, True) for shape in (False, True)]
    monkeypatch.setattr(jobs, "ROOM", 3000)
    assert max(len(part) for _, part, _, _ in jobs._strips(x, y, None, False, jobs.STRIP)) < 12
    parted = [jobs._warped(left, right, None, once, shape, not shape) for once in (False, True) for shape in (False, True)]
    for one, other in zip(whole, parted, strict=True):
        assert sorted(one.itertuples(index=False)) == sorted(other.itertuples(index=False)) and len(one) in (57, 39)


@pytest.mark.parametrize("shape", [False, True])
def test_equal_paths_are_warped_once(spark, shape, monkeypatch):
    """Copies have all their pairs, also with each other and where they are more than go as one, but are warped once a class."""
    rows = [(k, label, v) for k, (_, label, v) in enumerate(paths(6) * 7)] + [(100, 0, paths(1)[0][2]), (101, 1, paths(1)[0][2])]
    df = spark.createDataFrame(rows, "id long, label int, values array<double>").repartition(4)
    monkeypatch.setattr(jobs, "COPIES", 3)
    for queries in (None, F.col("id") % 4 == 0):
        pairs = jobs.pairs(df, "label", queries=queries)
        want = jobs.dtw_pairs(pairs, 4, shape=shape).select("a", "b", "distance").collect()
        got = jobs.dtw_within(df, "label", queries=queries, band=4, shape=shape, counted=False).collect()
        assert len(want) > 100 and sorted(got) == sorted(want)
    warped, warper = [], jobs._warper
    monkeypatch.setattr(jobs, "_warper", lambda *a: lambda x, run=warper(*a): warped.append(len(a[1])) or run(x))
    found = jobs._warped(pd.DataFrame({"a": [[0, 6, 12]], "x": [np.arange(9.0)]}), pd.DataFrame({"b": [[0, 6], [1], [12, 3]], "y": [np.arange(9.0), np.ones(9), np.zeros(9)]}), 4, False, shape, not shape)
    assert warped == [3] and len(found) == 12


@pytest.mark.parametrize("name", ["p02_dtw", "p03_shape_dtw"])
def test_warping_reads_no_row_a_pair(spark, name):
    """Paths reach Python by blocks: a row a pair took some 500 microseconds of a core."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "MapInPandas" not in plan.replace("FlatMapCoGroupsInPandas", "")


def test_shape_dtw(samples):
    rows = {k: v for k, _, v in paths(43)}

    def stretches(v, width=5):
        padded = [v[0]] * (width // 2) + v + [v[-1]] * (width - 1 - width // 2)
        return [padded[i : i + width] for i in range(len(v))]

    got = jobs.shape_dtw_pairs(jobs.pairs(samples, "label", queries=F.col("id") == 20), 3).collect()
    assert len(got) > 5
    for r in got:
        assert r.distance == pytest.approx(loop_dtw(stretches(rows[r.a]), stretches(rows[r.b]), math.dist, 3))


@pytest.mark.parametrize("band", [None, 0, 3])
def test_shape_dtw_by_blocks(spark, band, monkeypatch):
    """As by pairs, for paths of several lengths; stretches of 130 points are wider than those of 20."""
    rows = [(k, label, v[: (20, 13, 20, 1, 7)[k % 5]]) for k, label, v in paths(43)]
    df = spark.createDataFrame([*rows, *[(100 + k, 1, v) for k, _, v in paths(3, 130, 2)]], "id long, label int, values array<double>").repartition(4)
    monkeypatch.setattr(jobs, "BLOCK", (2, 3))
    want = jobs.shape_dtw_pairs(jobs.pairs(df, "label"), band).collect()
    got = jobs.dtw_within(df, "label", band=band, shape=True).select("a", "b", "distance").collect()
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_norms_go_with_the_length(spark):
    """A path of 5,000 points: a mean made anew at each point of each point's deviation never ended."""
    values = [math.sin(k) * 3 + k / 1000 for k in range(5000)]
    df = spark.createDataFrame([(values,), ([],), (None,)], "v array<double>")
    for last in (False, True):
        got, empty, none = (r.s for r in df.select(scalar.instance_norm(F.col("v"), last).alias("s")).collect())
        center = values[-1] if last else np.mean(values)
        assert (got["center"], got["scale"]) == pytest.approx((center, math.sqrt(np.var(values) + 1e-5)))
        assert got["values"] == pytest.approx([(x - center) / math.sqrt(np.var(values) + 1e-5) for x in values])
        assert (empty["scale"], empty["values"]) == (None, []) and (none["center"], none["values"]) == (None, None)
    ahead = df.limit(1).select(scalar.extended_input(F.col("v"), F.col("v"), 2, False).alias("x")).first().x
    assert ahead == pytest.approx(values[-2:] + [np.mean(values)] * 5000)


def test_causality_where_times_are_equal(spark, tmp_path):
    """Every row is an origin of its own, also where many rows have one time, and one after a long pause; no history has a whole stretch of time."""
    rng = random.Random(3)
    rows = [(k, datetime(2024, 1, 1) + timedelta(days=k // 7 * 4), 1, "ab"[k % 2], float(rng.randrange(50)) if k % 9 else None, "") for k in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.kind: (r.origins, r.differing) for r in catalog.QUERIES["m29_causality"](spark, str(tmp_path)).collect()}
    after = 0
    for code in "ab":
        own = [r[4] for r in rows if r[3] == code]
        after += sum(1 for v, w in zip(own, own[1:], strict=False) if v is not None and w is not None and w > v)
    assert got == {"trailing": (200, 0), "looks_ahead": (200, after)}


def test_last_rows_of_each_origin(spark):
    """Of each origin the last rows up to it, with ties of time by order, nulls, origins before any row and of no series."""
    rng = random.Random(4)
    at = lambda k: datetime(2024, 1, 1) + timedelta(minutes=k)
    points = [(code, at(rng.randrange(40)), rng.randrange(5) or None, n) for n, code in enumerate("aaabbcc" * 30)]
    origins = [(code, w, at(w * 5 - 8)) for code in "abz" for w in range(12)]
    series = spark.createDataFrame(points, "code string, ts timestamp, value int, n long").repartition(5)
    asked = spark.createDataFrame(origins, "code string, w int, origin_ts timestamp")
    got = defaultdict(list)
    for r in windows.last_of(asked, series, 7, ["code"], ["n"]).collect():
        got[r.code, r.w].append(r.n)
    want = {}
    for code, w, end in origins:
        own = sorted((t, n) for c, t, _, n in points if c == code and t <= end)
        if own:
            want[code, w] = sorted(n for _, n in own[-7:])
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 15


def test_gate_looks_up_places(spark):
    """The join was by time alone, and each window took all points of five days; now it is by target and place."""
    plan = catalog.QUERIES["f26_gated_shrink"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join" in line and "_place" in line and "target" in line for line in plan.splitlines())


def test_prefix_meets_its_own_series_only(spark):
    points = spark.createDataFrame([("ab"[k % 2], datetime(2024, 1, 1) + timedelta(seconds=7 * k), k) for k in range(90)] + [(None, datetime(2024, 1, 1), 90)], "code string, ts timestamp, n long")
    joined = windows.prefix_of(points.select("code", F.col("ts").alias("origin_ts"), F.col("n").alias("o")), points, 60, by=["code"])
    want = {(o, n) for o in range(90) for n in range(o % 2, o + 1, 2) if 7 * (o - n) < 60}
    assert {(r.o, r.n) for r in joined.collect()} == want
    plan = catalog.QUERIES["j11_prefix"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "event_type" in plan[plan.index("Join") : plan.index("\n", plan.index("Join"))]


def test_dtw_metric(spark):
    rng = random.Random(5)
    rows = [(w, t, h, rng.gauss(0, 3), rng.gauss(0, 3)) for w in range(6) for t in "ab" for h in range(1, 8)]
    fc = spark.createDataFrame(rows, "window_id long, target string, horizon long, y double, yhat double")
    want = defaultdict(list)
    for w in range(6):
        for t in "ab":
            own = sorted(r[2:] for r in rows if r[:2] == (w, t))
            want[t].append(loop_dtw([r[1] for r in own], [r[2] for r in own], lambda a, b: abs(a - b), 3, "symmetric", 1.5))
    got = {r.target: r.dtw for r in jobs.dtw_metric(fc, 3, 1.5).collect()}
    assert got == pytest.approx({t: sum(v) / len(v) for t, v in want.items()})


def test_each_augmentation(samples):
    rows = {k: np.array(v) for k, _, v in paths(43)}
    for op in jobs.AUGMENTATIONS:
        got = jobs.augment(samples, [op], 7, 2).collect()
        again = {(r.id, r.round): r.values for r in jobs.augment(samples.repartition(2), [op], 7, 2).collect()}
        assert len(got) == 2 * len(rows) and {r.tag for r in got} == {op}
        for r in got:
            x, y = rows[r.id], np.array(r["values"])
            assert len(y) == len(x) and list(again[r.id, r.round]) == y.tolist()
            if op == "jitter":
                assert 0 < np.abs(y - x).max() < 0.03 * 6
            elif op == "scaling":
                assert np.ptp(y / x) < 1e-9
            elif op == "rotation":
                assert np.allclose(y, x) or np.allclose(y, -x)
            elif "permutation" in op:
                assert sorted(y) == sorted(x)
            elif op == "magnitude_warp":
                assert np.isfinite(y).all() and np.abs(y / x - 1).max() < 2
            else:
                assert x.min() - 1e-9 <= y.min() and y.max() <= x.max() + 1e-9
        assert len({tuple(r["values"]) for r in got}) > len(rows)
    chain = jobs.augment(samples, ["scaling", "rotation"], 7).first()
    rng = np.random.default_rng([7, chain.id, 0])
    assert chain["values"] == pytest.approx(rows[chain.id] * rng.normal(1, 0.1) * rng.choice([-1.0, 1.0]))


def loop_path(x, y, cost, band):
    """(distance, steps) by a full table; of equal ways the diagonal, then a step in x, then one in y."""
    width, total, came = max(band, abs(len(x) - len(y))), {(0, 0): cost(x[0], y[0])}, {}
    for i in range(len(x)):
        for j in range(len(y)):
            ways = [(i - a, j - b) for a, b in ((1, 1), (1, 0), (0, 1)) if (i - a, j - b) in total]
            if (i or j) and abs(i - j) <= width and ways:
                came[i, j] = min(ways, key=lambda w: total[w])
                total[i, j] = total[came[i, j]] + cost(x[i], y[j])
    at = (len(x) - 1, len(y) - 1)
    steps = [at]
    while at in came:
        at = came[at]
        steps.append(at)
    return total[len(x) - 1, len(y) - 1], steps[::-1]


def stretched(values, n):
    return np.interp(np.arange(n), np.linspace(0, n - 1, len(values)), values)


def loop_guided(op, x, same, others, rng):
    """(values, moved) by the published methods, one pair and one cell at a time."""
    apart, band, n = lambda a, b: abs(a - b), math.ceil(len(x) / 10), len(x)
    if op.endswith("shape"):
        see = lambda v: [[v[0]] * (2 - i) + v[max(i - 2, 0) : i + 3] + [v[-1]] * (i + 3 - len(v)) if i < 2 else v[i - 2 : i + 3] + [v[-1]] * (i + 3 - len(v)) for i in range(len(v))]
        apart = math.dist
    else:
        see = lambda v: v
    if op == "spawner":
        cut, mean = int(rng.integers(1, n - 1)), []
        for a, b in ((x[:cut], same[0][:cut]), (x[cut:], same[0][cut:])):
            mean += [(a[i] + b[j]) / 2 for i, j in loop_path(a, b, apart, band)[1]]
        return stretched(mean, n) + rng.normal(0, 0.05, n), 0
    if op == "barycentre":
        far = [[loop_path(p, q, apart, band)[0] if p is not q else 0.0 for q in same] for p in same]
        c = min(range(len(same)), key=lambda k: (sum(far[k]), k))
        nearest = min(d for k, d in enumerate(far[c]) if k != c)
        sums, weights = [0.0] * n, [0.0] * n
        for k, p in enumerate(same):
            steps = [(i, i) for i in range(n)] if k == c or nearest == 0 else loop_path(same[c], p, apart, band)[1]
            w = 1.0 if k == c or nearest == 0 else math.exp(math.log(0.5) * far[c][k] / nearest)
            for i, j in steps:
                sums[i] += w * (same[c] if k == c or nearest == 0 else p)[j]
                weights[i] += w
        return np.array(sums) / np.array(weights), 0
    guide = same[0]
    if op.startswith("discriminative"):
        gain = lambda k: sum(loop_path(see(same[k]), see(q), apart, band)[0] for q in others) / len(others) - (sum(loop_path(see(same[k]), see(q), apart, band)[0] for i, q in enumerate(same) if i != k) / (len(same) - 1) if len(same) > 1 else 0)
        guide = same[max(range(len(same)), key=lambda k: (gain(k), -k))]
    steps = [j for _, j in loop_path(see(guide), see(x), apart, band)[1]]
    return stretched([x[j] for j in steps], n), float(np.abs(np.arange(n) - stretched(steps, n)).sum())


@pytest.mark.parametrize("op", jobs.GUIDED)
def test_guided_augmentation_is_the_published_one(spark, samples, op):
    seed = 3
    discriminative = op.startswith("discriminative")
    picks = jobs.picked(samples, "label", seed, 3 if discriminative else 6 if op == "barycentre" else 1, 3 if discriminative else 0, own=op == "barycentre").collect()
    want, moved = {}, {}
    for r in picks:
        want[r.id], moved[r.id] = loop_guided(op, list(r["values"]), [list(p) for p in r.same], [list(p) for p in r.others] if discriminative else [], np.random.default_rng([seed, r.id]))
    if discriminative:
        for k, v in want.items():
            width = math.ceil((0.9 + 0.1 * moved[k] / max(moved.values())) * len(v))
            at = int(np.random.default_rng([seed, k, 1]).integers(0, len(v) - width + 1))
            want[k] = np.interp(np.linspace(0, width - 1, len(v)), np.arange(width), v[at : at + width])
    got = {r.id: r["values"] for r in jobs.augment_guided(samples, "label", op, seed).collect()}
    assert sorted(got) == sorted(want)
    for k in got:
        assert got[k] == pytest.approx(want[k].tolist())


def test_picks(spark, samples):
    """Of the own label without itself, of other labels, the same on a rerun, and not the same for all rows."""
    rows = {tuple(v): (k, label) for k, label, v in paths(43)}
    got = jobs.picked(samples, "label", 5, 3, 3).collect()
    again = {r.id: (r.same, r.others) for r in jobs.picked(samples.repartition(2), "label", 5, 3, 3).collect()}
    for r in got:
        assert len({tuple(p) for p in r.same}) == 3 == len({tuple(p) for p in r.others})
        assert all(rows[tuple(p)][1] == r.label and rows[tuple(p)][0] != r.id for p in r.same) and all(rows[tuple(p)][1] != r.label for p in r.others)
        assert again[r.id] == (r.same, r.others)
    assert len({tuple(map(tuple, r.same)) for r in got if r.label == 0}) > 5
    alone = spark.createDataFrame([(1, 0, [1.0, 2.0, 4.0]), (2, None, [1.0, 2.0])], "id long, label int, values array<double>")
    assert sorted(r["values"] for r in jobs.augment_guided(alone, "label", "guided", 3).collect()) == [[1.0, 2.0], [1.0, 2.0, 4.0]]


def test_ridge(spark):
    rng = random.Random(4)
    rows = [(t, rng.gauss(0, 2), rng.gauss(1, 3), rng.gauss(0, 1), rng.gauss(0, 1)) for t in "ab" for _ in range(60)]
    fc = spark.createDataFrame(rows, "target string, u double, v double, y double, yhat double")
    got = {(r.target, r.ridge): (r.intercept, r.u, r.v) for r in calibrate.fit_ridge(fc, ["u", "v"], (0.01, 1.0)).collect()}
    for t in "ab":
        x = np.array([(1, u, v) for s, u, v, _, _ in rows if s == t])
        r = np.array([y - p for s, _, _, y, p in rows if s == t])
        for lam in (0.01, 1.0):
            # Least squares on rows and on penalty rows says the same as the normal equations.
            more = math.sqrt(lam * len(x)) * np.array([(0, 1, 0), (0, 0, 1)])
            want = np.linalg.lstsq(np.vstack([x, more]), np.concatenate([r, [0, 0]]), rcond=None)[0]
            assert got[t, lam] == pytest.approx(tuple(want))


def test_bootstrap(spark):
    rng = random.Random(6)
    blocks = [(t, d, rng.uniform(1, 5), rng.uniform(1, 5)) for t in "ab" for d in range(9)]
    df = spark.createDataFrame(blocks, "target string, day long, e double, p double")
    got = {r.target: r for r in calibrate.block_bootstrap(df, "day", 300, 11, lambda: 1 - F.sum("e") / F.sum("p"), ["target"]).collect()}
    hashed = df.select("target", "day", F.xxhash64(F.lit(11), "day", "target").alias("h")).collect()
    block = {(r.target, r.day): np.array([r.h]).view("u8") for r in hashed}
    for t in "ab":
        values = []
        for draw in range(300):
            times = []
            for b in (b for b in blocks if b[0] == t):
                u, k = float(calibrate.unit(block[t, b[1]], np.array([draw]))[0]), 0
                while u >= math.exp(-1) / math.factorial(k):
                    u -= math.exp(-1) / math.factorial(k)
                    k += 1
                times.append((k, b))
            values.append(1 - sum(k * b[2] for k, b in times) / sum(k * b[3] for k, b in times))
        assert got[t].draws == 300
        assert (got[t].low, got[t].high) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))


def loop_bias(rows, step, seconds, alpha, least, limit):
    """rows of (target, horizon, origin second, residual) with the correction of each."""
    out = {}
    groups = defaultdict(list)
    for t, h, at, e in rows:
        groups[t, h].append((at, e))
    for (t, h), own in groups.items():
        own.sort()
        run = []
        for k, (at, _) in enumerate(own):
            if k and at - own[k - 1][0] > step * seconds:
                run = []
            known = [e for s, e in run if s + h * seconds <= at]
            ema = known[0] if known else 0.0
            for e in known[1:]:
                ema += alpha * (e - ema)
            out[t, h, at] = max(-limit, min(limit, ema)) if len(known) >= least else 0.0
            run.append(own[k])
    return out


@pytest.mark.parametrize("block", [256, 3])
def test_rolling_bias(spark, monkeypatch, block):
    monkeypatch.setattr(forecast, "BLOCK", block)
    rng = random.Random(2)
    rows, at = [], 1_700_000_000
    for k in range(60):
        at += 10 if k % 23 else 500
        rows += [(t, h, at, rng.gauss(1, 2)) for t in "ab" for h in (1, 2, 4)]
    df = spark.createDataFrame([(t, h, s, e, 0.0) for t, h, s, e in rows], "target string, horizon long, s long, y double, yhat double").withColumn("origin_ts", F.timestamp_seconds("s"))
    got = {(r.target, r.horizon, r.s): r.correction for r in forecast.rolling_bias(df, 3, 10, 0.3, 6, 2.5).collect()}
    assert got == pytest.approx(loop_bias(rows, 3, 10, 0.3, 6, 2.5))
    assert sum(v != 0 for v in got.values()) > 100


def test_shuffle_by_chunk(spark):
    rows = [(c, w) for c in range(7) for w in range(20)]
    df = spark.createDataFrame(rows, "chunk_id long, window_id long").repartition(5)
    one, again, other = ([(r.chunk_id, r.window_id) for r in windows.shuffle_by_chunk(df, 3, epoch, "window_id").collect()] for epoch in (0, 0, 1))
    assert one == again and one != other and sorted(one) == sorted(other) == rows
    for order in (one, other):
        chunks = [c for k, (c, _) in enumerate(order) if not k or order[k - 1][0] != c]
        assert len(chunks) == 7 and chunks != sorted(chunks)
        assert any([w for c, w in order if c == k] != list(range(20)) for k in range(7))


def test_limit_samples(spark):
    def spark_hash(seed, key):
        first = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
        out = xxhash.xxh64(struct.pack("<q", key), seed=first).intdigest()
        return out - (1 << 64) if out >> 63 else out

    df = spark.range(500)
    order = sorted(range(500), key=lambda k: spark_hash(5, k))
    assert sorted(r.id for r in windows.limit_samples(df, 40, 5, "id").collect()) == sorted(order[:40])
    share = {k for k in range(500) if (spark_hash(5, k) % (1 << 30)) / (1 << 30) < 0.3}
    assert {r.id for r in windows.limit_samples(df, 0.3, 5, "id").collect()} == share


def test_mask_random(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(400)], "id long, v double")
    for r in scalar.mask_random(df, "v", 0.25, 5, "id").collect():
        first = xxhash.xxh64(struct.pack("<i", 5), seed=42).intdigest()
        out = xxhash.xxh64(struct.pack("<q", r.id), seed=first).intdigest()
        masked = (out % (1 << 30)) / (1 << 30) <= 0.25
        assert (r.masked, r.v) == (masked, 0.0 if masked else float(r.id))


def test_greedy_nonoverlap(spark):
    rng = random.Random(8)
    rows = [(c, s, s + rng.randrange(3, 9)) for c in range(5) for s in sorted(rng.sample(range(200), 60))]
    got = defaultdict(list)
    for r in windows.greedy_nonoverlap(spark.createDataFrame(rows, "chunk_id long, start long, end long"), 6).collect():
        got[r.chunk_id].append((r.start, r.end))
    for c in range(5):
        kept, last = [], -1
        for _, s, e in sorted(r for r in rows if r[0] == c):
            if s > last:
                kept.append((s, e))
                last = e
        n = len(kept)
        want = kept if n <= 6 else [kept[i * (n - 1) // 5] for i in range(6)]
        assert sorted(got[c]) == want


def test_adf_and_periods_of_the_tables(spark):
    from gridweave.plans import fixtures as fx

    series = defaultdict(list)
    for r in fx.user_points(spark, SF).orderBy("ts").collect():
        series[r.point_code].append(r.value)
    got = {r.point_code: r.statistic for r in catalog.QUERIES["a24_adf"](spark, SF).collect()}
    for code, v in series.items():
        x = np.array(v)
        d, level, before = np.diff(x)[1:], x[1:-1], np.diff(x)[:-1]
        m = np.column_stack([np.ones(len(d)), level, before])
        beta, *_ = np.linalg.lstsq(m, d, rcond=None)
        var = ((d - m @ beta) ** 2).sum() / (len(d) - 3) * np.linalg.inv(m.T @ m)[1, 1]
        assert got[code] == pytest.approx(beta[1] / math.sqrt(var), abs=6e-4)
    grid = defaultdict(list)
    for r in fx.long(spark, SF).orderBy("ts").collect():
        grid[r.point_code].append(r.value or 0.0)
    found = defaultdict(list)
    for r in catalog.QUERIES["w20_periods"](spark, SF).orderBy("rank").collect():
        found[r.point_code].append((r.period, r.amplitude))
    for code, v in grid.items():
        n = len(v)
        size = {f: abs(sum(x * complex(math.cos(2 * math.pi * f * k / n), -math.sin(2 * math.pi * f * k / n)) for k, x in enumerate(v))) for f in range(1, n // 2 + 1)}
        best = sorted(size, key=lambda f: -size[f])[:3]
        assert [a for _, a in found[code]] == pytest.approx([size[f] for f in best], abs=6e-4)
        assert [p for p, _ in found[code]] == [n // f for f in best]


def test_guarded_score(spark):
    """Statuses in their order, with the gate, and histories that are not what they should be."""
    calm, moving = [100.0 + 0.01 * (k % 2) for k in range(70)], [float(k * k % 97) for k in range(70)]
    holes = [None if k % 3 == 0 and k < 69 else v for k, v in enumerate(moving)]
    rows = [(1, "a", calm), (1, "b", moving), (2, "a", [*calm[:-1], None]), (2, "b", calm), (3, "a", [None] * 69 + [5.0]), (3, "b", [None] * 40 + moving[:30]), (4, "a", holes), (4, "b", moving), (5, "a", calm), (6, "a", [*calm[:-1], 1e9])]
    history = spark.createDataFrame(rows, "window_id long, target string, history array<double>")
    valid = spark.createDataFrame([(k, "ok" if k != 5 else "irregular_step") for k in range(1, 7)], "window_id long, status string")
    means = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "target string, mean double")
    load = lambda: lambda h: np.full(3, np.inf) if h[-1] > 1e8 else h[-1] + np.arange(1.0, 4.0)
    got = {(r.window_id, r.target, r.horizon): r for r in jobs.guarded_score(history, load, 3, means, 10, 2.0, 30, valid).collect()}
    assert len(got) == 3 * len(rows)
    status = {k[:2]: r.status for k, r in got.items()}
    assert status == {
        (1, "a"): "short_horizon_corrected", (1, "b"): "model", (2, "a"): "unavailable", (2, "b"): "short_horizon_corrected", (3, "a"): "degraded_persistence", (3, "b"): "degraded_persistence",
        (4, "a"): "degraded_persistence", (4, "b"): "model", (5, "a"): "irregular_step", (6, "a"): "degraded_persistence",
    }
    assert all(got[1, "b", h].yhat == moving[-1] + h for h in (1, 2, 3))
    gate = 1 - 0.01 / 2.0
    for h in (1, 2, 3):
        pull = gate * 0.5 * (1 + math.cos(math.pi * h / 3)) if h < 3 else 0
        assert got[1, "a", h].yhat == pytest.approx(calm[-1] + h - pull * h)
        assert got[2, "a", h].yhat is None and got[5, "a", h].yhat is None and got[3, "b", h].raw is None
        assert got[3, "a", h].yhat == 5.0 and got[6, "a", h].yhat == 1e9 and got[6, "a", h].raw is None


def test_validate_columns(spark):
    rows = quality.validate_columns(spark, ["timestamp", "a", "a", "z"], ["a", "b", "c"], ["c"]).collect()
    assert sorted(map(tuple, rows)) == [("a", "duplicate"), ("b", "missing"), ("c", "missing_auxiliary"), ("z", "unexpected")]
    assert quality.validate_columns(spark, ["timestamp", "a"], ["a"]).count() == 0


def test_quantiles(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.choice([rng.gauss(0, 1), 3.0, rng.randrange(5)]))) for g in "abc" for _ in range(rng.randrange(1, 400))] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = [0.0, 0.08, 1 / 3, 0.5, 0.95, 1.0]
    from gridweave.operators.order import quantiles

    got = {r.g: r.q for r in quantiles(df, "v", qs, ["g"]).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], qs))
    assert "d" not in got
    assert quantiles(df, "v", qs).first().q == pytest.approx(np.quantile([v for _, v in rows if v is not None], qs))
