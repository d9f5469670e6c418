"""Operators against plain Python on small inputs, with their odd cases."""

import itertools
import json
import math
import random
import time
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridquarry.functions import physics
from gridquarry.operators import grids, joins, moments, rollouts, scores, series, spectra
from gridquarry.operators import topology as top

DAY = date(2024, 1, 1)


def values(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


# moments


def test_constant_features_have_std_one_and_change_floor(spark):
    rows = [("flat", c, DAY + timedelta(d), 5.0) for c in (1, 2) for d in range(4)] + [("space", c, DAY + timedelta(d), float(c)) for c in (1, 2) for d in range(4)]
    got = {r["feature"]: r for r in moments.train_statistics(spark.createDataFrame(rows, "feature string, cell int, day date, value double"), ["feature"], ["feature", "cell"], "day", "value").collect()}
    assert got["flat"]["std"] == 1.0 and got["flat"]["diff_std"] == 1.0
    assert got["space"]["std"] == 0.5 and got["space"]["diff_std"] == 0.05 * 0.5


def test_constant_groups_of_many_partitions_have_std_one(spark):
    df = spark.range(0, 40_000, 1, 7).select((F.col("id") % 50 + 1).cast("int").alias("k"), ((F.col("id") % 50 + 1) / 10).alias("v"))
    assert {r["std"] for r in moments.moments(df, ["k"], "v").collect()} == {1.0}
    assert {r["std"] for r in df.groupBy("k").agg(moments.std_pop("k").alias("std")).collect()} == {0.0}
    odd = spark.createDataFrame([("n", None), ("m", float("nan")), ("m", 1.0), ("t", 1.0), ("t", 3.0), ("t", None)], "k string, v double").groupBy("k").agg(moments.std_pop("v").alias("std"))
    got = {r["k"]: r["std"] for r in odd.collect()}
    assert got["n"] is None and math.isnan(got["m"]) and got["t"] == 1.0


def test_a_missing_or_unused_day_breaks_the_chain(spark):
    rows = [(DAY + timedelta(d), float(v), u) for d, v, u in [(0, 1, True), (1, 3, True), (3, 9, True), (4, 10, False), (5, 20, True), (6, 26, True)]]
    df = spark.createDataFrame(rows, "day date, value double, used boolean").withColumn("k", F.lit(1))
    assert [r["change"] for r in moments.with_change(df, ["k"], "day", "value", F.col("used")).orderBy("day").collect()] == [None, 2.0, None, None, None, 6.0]


def test_fixed_point_rounds_half_to_even_and_clips(spark):
    df = spark.createDataFrame([(0.00025,), (0.00075,), (17.0,), (-17.0,), (None,)], "v double")
    q = df.select(moments.quantized(F.col("v"), F.lit(0.0), F.lit(1.0)).alias("q"))
    assert [r["q"] for r in q.collect()] == [0, 2, 32000, -32000, None]
    assert q.agg(moments.at_clip(F.col("q"))).first()[0] == 2


# scores


@given(st.lists(st.floats(-100, 100), min_size=1, max_size=8), st.floats(-100, 100))
@settings(max_examples=5, deadline=None)
def test_fair_crps_is_the_pair_sum(spark, xs, y):
    m = len(xs)
    pairs = sum(abs(a - b) for a, b in itertools.product(xs, xs)) / (2 * m * (m - 1)) if m > 1 else 0.0
    want = sum(abs(x - y) for x in xs) / m - pairs
    got = scores.fair_crps(spark.createDataFrame([(1, float(x), float(y)) for x in xs], "key int, x double, y double"), ["key"]).first()
    assert got["crps"] == pytest.approx(want, abs=1e-9) and got["members"] == m


def test_members_on_the_truth_score_zero(spark):
    df = spark.createDataFrame([(k, 2.0, 2.0) for k in (1, 2) for _ in range(4)], "key int, x double, y double")
    assert {r["crps"] for r in scores.fair_crps(df, ["key"]).collect()} == {0.0}


def test_correlation_of_changes_needs_both_to_vary(spark):
    rows = [("still", 1.0, 2.0, 1.0, 1.0), ("still", 2.0, 5.0, 2.0, 1.0), ("same", 2.0, 3.0, 1.0, 1.0), ("same", 4.0, 7.0, 2.0, 2.0), ("none", 1.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "f string, truth double, pred double, x0 double, w double")
    got = {r["f"]: r["corr_change"] for r in scores.scored(scores.weighted_sums(df, ["f"]), ["f"]).collect()}
    assert got["still"] is None and got["none"] is None and got["same"] == pytest.approx(1.0)


def test_gaussian_crps_by_quadrature(spark):
    x = np.linspace(-12, 12, 200_001)
    cdf = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])
    want = np.trapezoid(np.square(cdf - (x >= 0.7)), x)
    got = spark.range(1).select(scores.gaussian_crps(F.lit(0.0), F.lit(1.0), F.lit(0.7)).alias("c")).first()[0]
    assert got == pytest.approx(want, abs=1e-4)


def test_uniform_offset_moves_each_total(spark):
    rows = [(s, k, 1.0 * k, 1.0 * k + 0.5, 0.0) for s in range(3) for k in range(1, 5)]
    got = scores.conservation(spark.createDataFrame(rows, "start int, lead int, truth double, pred double, initial double"), [], "start", "lead", "truth", "pred", "initial").orderBy("lead").collect()
    assert [r["error_mean"] for r in got] == [0.5] * 4 and [r["error_std"] for r in got] == [0.0] * 4 and {r["positive"] for r in got} == {1.0}
    assert [r["model_step"] for r in got] == [1.5, 1.0, 1.0, 1.0]


def test_rank_correlation_shares_ranks_of_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0)], "k string, a double, b double")
    got = {r["k"]: r["rank_corr"] for r in scores.spearman(df, ["k"], "a", "b").collect()}
    assert got["a"] == pytest.approx(np.corrcoef([1.5, 1.5, 3], [1, 2, 3])[0, 1]) and got["b"] is None


# series


def test_runs_spans_and_fill(spark):
    days = [0, 1, 2, 5, 7, 8]
    df = spark.createDataFrame([(1, DAY + timedelta(d), float(d * d)) for d in days], "k int, day date, value double")
    runs = series.runs(df.withColumn("d", F.unix_date("day")), ["k"], "d", F.lit(True))
    assert sorted(r["length"] for r in runs.collect()) == [1, 2, 3]
    assert series.spans(df, ["k"], "day").first()["spans"] == "2024-01-01..2024-01-03, 2024-01-06, 2024-01-08..2024-01-09"
    got = {(r["day"] - DAY).days: (r["value"], r["real"]) for r in series.filled(df, ["k"], "day", "value").collect()}
    assert len(got) == 9 and got[3][0] == pytest.approx(4 + 21 / 3) and not got[3][1] and got[6][0] == pytest.approx(37) and got[5] == (25.0, True)


def test_departure_needs_a_whole_run_and_nan_is_inside(spark):
    curve = {"a": [1.0, 1.2, 1.0, 1.2, 1.3, 1.4, 1.0], "b": [1.0, 1.0, 1.0, 1.0, 1.0, 1.2, 1.2], "c": [1.2, float("nan"), 1.2, 1.2, 1.2, 1.0, 1.0], "d": [0.9, 1.1, 0.9, 1.1, 1.0, 1.0, 1.0]}
    df = spark.createDataFrame([(k, i + 1, v) for k, c in curve.items() for i, v in enumerate(c)], "k string, lead int, r double")
    assert {r["k"]: r["departs"] for r in series.departure(df, ["k"], "lead", F.col("r"), 0.9, 1.1).collect()} == {"a": 4, "b": None, "c": 3, "d": None}


def test_collapse_of_parked_and_healthy_histories(spark):
    histories = {"parked": [1.1095] * 30, "healthy": [1.1 * 0.95**k for k in range(30)], "short": [1.1] * 9}
    df = spark.createDataFrame([(k, i, v) for k, h in histories.items() for i, v in enumerate(h)], "run string, step int, loss double")
    assert {r["run"]: r["epoch"] for r in series.collapsed(df, ["run"], "step", "loss", F.lit(1.106)).collect()} == {"parked": 10, "healthy": None, "short": None}


def test_plateau_decays_again_and_stops(spark):
    losses = [1.0, 0.5] + [0.5] * 9
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(losses)], "run int, step int, loss double")
    r = series.plateau(df, ["run"], "step", "loss", 0.01, 3, 8).first()
    assert (r["decays"], r["stopped"], r["best"]) == (2, 10, 0.5)


def test_fills_propagate_down(spark):
    df = spark.createDataFrame([(1, k, float(k), k in (2, 3, 5)) for k in range(1, 7)], "c int, k int, v double, lost boolean")
    got = df.select("k", series.from_above(F.col("v"), F.col("lost"), ["c"], "k").alias("x")).orderBy("k").collect()
    assert [r["x"] for r in got] == [1, 1, 1, 4, 4, 6]


def test_projected_columns_keep_their_totals(spark):
    rng, rows = random.Random(1), []
    for c in range(20):
        for k in range(6):
            rows.append((c, k, rng.uniform(-5, 20), rng.choice([0.0, rng.uniform(1, 10)]), rng.uniform(0.1, 2)))
    got = series.projected_thickness(spark.createDataFrame(rows, "c int, k int, dp double, prev double, cv double"), ["c"], "k", "dp", "prev", "cv", 1e-3).collect()
    for c in range(20):
        assert all(r["projected"] >= -1e-12 for r in got if r["c"] == c)
        assert sum(r["projected"] for r in got if r["c"] == c) == pytest.approx(sum(r["prev"] for r in got if r["c"] == c))


def test_windows_without_a_change(spark):
    days = [date(2017, 5, 28) + timedelta(k) for k in range(8)]
    df = spark.createDataFrame([(k, d, d + timedelta(2)) for k, d in enumerate(days)], "k int, a date, b date")
    got = series.kept_windows(df, F.col("a"), F.col("b"), [date(2017, 6, 1), date(2017, 6, 2)])
    assert sorted(r["k"] for r in got.collect()) == [0, 1, 5, 6, 7]


# joins


def test_as_of_takes_the_latest_not_after(spark):
    left = spark.createDataFrame([(1, t, f"l{t}") for t in (0, 5, 10, 15)] + [(2, 3, "other")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 5, 50), (1, 9, 90), (1, 20, 200)], "k int, t int, v int")
    assert values(joins.as_of(left, right, ["k"], "t", "v", "got"), "k", "t", "name", "got") == [(1, 0, "l0", None), (1, 10, "l10", 90), (1, 15, "l15", 90), (1, 5, "l5", 50), (2, 3, "other", None)]


def test_radius_join_is_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(-5, 5, (40, 2)), rng.uniform(-5, 5, (30, 2))
    want = {(i, j) for i in range(40) for j in range(30) if np.hypot(*(a[i] - b[j])) <= 1.5}
    frame = lambda p, n: spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)], f"{n} int, x double, y double")
    got = joins.within_radius(frame(a, "a"), frame(b, "b"), 1.5).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_nearest_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(v,) for v in (-3.0, 5.0, 17.5, 99.0)], "z double")
    assert [r["i"] for r in joins.nearest_on_axis(df, "z", [0, 10, 25], "i").collect()] == [0, 0, 1, 2]


def test_greedy_matches_are_plain(spark):
    rng, rows, want = random.Random(31), [], []
    for g in range(25):
        truth, model = ([rng.randrange(30) for _ in range(rng.randrange(14))] for _ in range(2))
        rows += [(f"g{g}", d, True) for d in truth] + [(f"g{g}", d, False) for d in model]
        left = sorted(model)
        for t in sorted(truth):
            near = min(left, key=lambda m: (abs(m - t), m), default=None)  # noqa: B023
            hit = near if near is not None and abs(near - t) <= 4 else None
            if hit is not None:
                left.remove(hit)
            want.append((f"g{g}", t, hit))
        want += [(f"g{g}", None, m) for m in left]
    got = joins.greedy_matches(spark.createDataFrame(rows, "k string, d long, true boolean"), ["k"], "d", "true", 4).collect()
    order = lambda r: tuple((x is None, x) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_greedy_matches_use_each_event_once(spark):
    rows = [("a", 10, True), ("a", 12, True), ("a", 11, False), ("a", 40, False), ("b", 5, False)]
    got = values(joins.greedy_matches(spark.createDataFrame(rows, "k string, d long, true boolean"), ["k"], "d", "true", 3), "k", "truth", "model")
    assert got == sorted([("a", 10, 11), ("a", 12, None), ("a", None, 40), ("b", None, 5)], key=str)


# grids


def image(spark, a):
    return spark.createDataFrame([(1, int(y), int(x), None if np.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(a)], "f int, y long, x long, v double")


def grid_of(rows, shape, name):
    out = np.full(shape, np.nan)
    for r in rows:
        if r[name] is not None:
            out[r["y"], r["x"]] = r[name]
    return out


def test_smoothing_against_loops(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(9, 11))
    a[rng.random(a.shape) < 0.2] = np.nan
    k = grids.kernel(1.1)
    want = np.full(a.shape, np.nan)
    for y, x in np.ndindex(a.shape):
        near = [(k[dy] * k[dx], a[y + dy, x + dx]) for dy in k for dx in k if 0 <= y + dy < 9 and 0 <= x + dx < 11 and not np.isnan(a[y + dy, x + dx])]
        den = sum(w for w, _ in near)
        if not np.isnan(a[y, x]) and den >= 0.5:
            want[y, x] = sum(w * v for w, v in near) / den
    np.testing.assert_allclose(grid_of(grids.smoothed(image(spark, a), ["f"], "v", 1.1).collect(), a.shape, "v"), want)


def test_distance_is_exact(spark):
    rng = np.random.default_rng(1)
    for share in (0.0, 0.03, 0.5):
        m = rng.random((12, 9)) < share
        df = spark.createDataFrame([(1, int(y), int(x), bool(v)) for (y, x), v in np.ndenumerate(m)], "f int, y long, x long, m boolean")
        got = grid_of(grids.distance_to(df, ["f"], "m").collect(), m.shape, "distance")
        if not m.any():
            assert np.isnan(got).all()
        else:
            y, x = np.nonzero(m)
            want = np.sqrt(((np.indices(m.shape)[:, :, :, None] - np.stack([y, x])[:, None, None]) ** 2).sum(0)).min(-1)
            np.testing.assert_allclose(got, want)


def test_fronts_three_cells_apart(spark):
    rows = [(1, y, x, 10 <= x < 20, 13 <= x < 23, 2.0) for y in range(12) for x in range(30)]
    df = spark.createDataFrame(rows, "f int, y long, x long, p boolean, t boolean, km double")
    df = grids.front_edges(df.withColumns({"region": F.lit(True), "s": F.col("p").cast("double")}), ["f"], "s", "region", 0.5).withColumnRenamed("edge", "a")
    df = grids.front_edges(df.withColumn("s", F.col("t").cast("double")), ["f"], "s", "region", 0.5).withColumnRenamed("edge", "b")
    r = grids.front_distance(df, ["f"], "a", "b", "km").first()
    assert r["status"] == "ok" and r["hausdorff_km"] == 6.0
    empty = grids.front_distance(df.withColumn("b", F.lit(False)), ["f"], "a", "b", "km").first()
    assert empty["status"] == "true_empty" and empty["mean_km"] is None


def test_an_empty_front_adds_no_loss(spark):
    y, x = np.mgrid[:6, :8]
    km, tau = 3.0, 0.05

    def loss(pred, truth):
        rows = [(1, int(a), int(b), float(pred[a, b]), float(truth[a, b]), True, km) for a, b in np.ndindex(6, 8)]
        return grids.front_loss(spark.createDataFrame(rows, "f int, y long, x long, p double, t double, r boolean, km double"), ["f"], "p", "t", "r", "km", 0.75, tau).first()["loss"]

    still, fast = np.zeros((6, 8)), np.where(x < 4, 1.5, 0.0)
    assert loss(still, still) == 0.0
    edge = (x == 3) | (x < 4) & ((x == 0) | (y == 0) | (y == 5))
    away = np.array([[min(math.hypot(a - c, b - d) for c, d in zip(*np.nonzero(edge), strict=True)) for b in range(8)] for a in range(6)]) * km
    p = 1 / (1 + np.exp(-(still - 0.75) / tau))
    assert loss(still, fast) == pytest.approx(((p - (fast > 0.75)) ** 2 * away**2).mean())  # only the true front's distance counts


def test_nan_speed_is_slow_and_outside_too(spark):
    a = np.ones((4, 4))
    a[1, 1] = np.nan
    df = image(spark, np.ones((4, 4))).withColumn("region", F.lit(True)).withColumn("v", F.when((F.col("y") == 1) & (F.col("x") == 1), float("nan")).otherwise(F.col("v")))
    got = {(r["y"], r["x"]) for r in grids.front_edges(df, ["f"], "v", "region", 0.5).where("edge").collect()}
    assert (1, 1) not in got and (2, 2) not in got and len(got) == 14


def test_bilinear_is_exact_for_linear_fields_and_wraps(spark):
    grid = spark.createDataFrame([(i, j, 2.0 * i) for i in range(5) for j in range(8)], "i long, j long, v double")
    points = spark.createDataFrame([(1, 45.0, 10.0), (2, 67.5, -5.0), (3, 400.0, 3.0), (4, 90.0, 359.0), (5, 180.0, 0.0)], "k int, lat double, lon double")
    assert {r["k"]: r["got"] for r in grids.bilinear(points, grid, 45.0, outside="null").collect()} == {1: 2.0, 2: 3.0, 3: None, 4: 4.0, 5: 8.0}
    with pytest.raises(Exception, match="outside the grid"):
        grids.bilinear(points, grid, 45.0).collect()
    assert [r["got"] for r in grids.bilinear(points.where("k = 1").union(points.where("k = 1")), grid, 45.0).collect()] == [2.0, 2.0]  # points may repeat
    holes = grid.withColumn("v", F.when((F.col("i") != 2) | (F.col("j") != 0), F.col("v")))
    assert [r["got"] for r in grids.bilinear(points.where("k IN (1, 4)"), holes, 45.0).orderBy("k").collect()] == [2.0, None]


# spectra


def test_bands_sum_to_the_tapered_variance():
    x = np.random.default_rng(2).normal(size=(3, 16, 12))
    w = spectra.hann((16, 12))
    p = spectra.cross_power(x, x, w)
    bands = spectra.banded(p, spectra.wavelength_bands((16, 12), 8.0), 4)
    np.testing.assert_allclose(bands.sum(1), np.square(spectra.tapered(x, w)).sum((1, 2)) / np.square(w).sum() - p[:, 0, 0])
    k = np.hypot(*np.meshgrid(np.fft.fftfreq(16, 8.0), np.fft.fftfreq(12, 8.0), indexing="ij"))
    found = spectra.wavelength_bands((16, 12), 8.0)
    for (y, x_), f in np.ndenumerate(k):
        assert found[y, x_] == (next(i for i, (lo, hi) in enumerate(spectra.BANDS.values()) if lo <= 1 / f < hi) if f else -1)


def test_adjusted_excess_is_zero_for_a_perfect_forecast(spark):
    v = np.random.default_rng(3).normal(size=64).tolist()
    df = spark.createDataFrame([(1, v, v), (2, v, v[::-1])], "id long, p array<double>, t array<double>")
    got = {r["id"]: r["excess"] for r in spectra.adjusted_excess(df, "id long", (8, 8), "p", "t", 1.0).collect()}
    assert abs(got[1]) < 1e-6 and got[2] > -1e-9


def test_folded_share_is_of_the_coarse_power(spark):
    """A wave too short for the coarse grid is all folded; a long one hardly is."""
    y, x = np.mgrid[:48, :48]
    mask = np.ones((48, 48), bool)
    mask[:10, :10] = False
    waves = {1: np.cos(2 * np.pi * x / 3.2), 2: np.cos(2 * np.pi * x / 16), 3: np.zeros((48, 48))}
    df = spark.createDataFrame([(k, np.where(mask, v, np.nan).ravel().tolist()) for k, v in waves.items()], "id long, v array<double>")
    got = {r["id"]: r["share"] for r in spectra.alias_share(df, "id long", (48, 48), 2, 8.0, ("50to100km", "100to200km", "gt200km"), mask).collect()}
    assert got[1] > 0.99 and abs(got[2]) < 0.02 and (got[3] is None or math.isnan(got[3]))


def test_error_function():
    x = np.concatenate([np.linspace(-7, 7, 4001), [np.inf, -np.inf]])
    np.testing.assert_allclose(scores.erf_of(x), [math.erf(v) for v in x], rtol=0, atol=4e-15)


def test_rings_keep_parseval():
    for shape in ((8, 8), (6, 9), (7, 10)):
        x = np.random.default_rng(4).normal(size=shape)
        ring, weight = spectra.rings(shape)
        assert (weight * np.abs(np.fft.rfft2(x, norm="ortho")) ** 2).sum() == pytest.approx(np.square(x).sum())
        assert ring[0, 0] == 0


def test_noise_has_unit_variance_and_its_length():
    f = np.stack([spectra.correlated_noise((24, 24), (8.0, 8.0), 24.0, s) for s in range(150)])
    assert np.square(f).mean() == pytest.approx(1.0, abs=0.1)
    assert (f[:, :, 3:] * f[:, :, :-3]).mean() == pytest.approx(math.exp(-0.5), abs=0.1)
    assert (spectra.correlated_noise((8, 8), (8.0, 8.0), 24.0, 5) == spectra.correlated_noise((8, 8), (8.0, 8.0), 24.0, 5)).all()


# topology


def flood(mask):
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask), strict=True):
        if not out[start]:
            n += 1
            todo = [start]
            while todo:
                y, x = todo.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                    out[y, x] = n
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return out


def fields(n, shape=(7, 9), land=0.12, ties=False):
    rng = np.random.default_rng(11)
    for _ in range(n):
        f = rng.integers(0, 6, shape).astype(float) if ties else rng.normal(size=shape)
        f[rng.random(shape) < land] = np.nan
        yield f


def test_labels_are_flood_fill():
    for f in fields(40):
        mask = np.nan_to_num(f, nan=-9) > 0
        assert (top.labels(mask) == flood(mask)).all()
    spiral = np.ones((9, 9), bool)
    spiral[1, :-1] = spiral[3, 1:] = spiral[5, :-1] = spiral[7, 1:] = False
    assert top.labels(spiral).max() == 1


@pytest.mark.parametrize("ties", [False, True])
def test_alive_classes_count_components_at_every_level(ties):
    for f in fields(30, ties=ties):
        pairs = top.persistence(f)
        for level in np.unique(f[~np.isnan(f)]):
            assert sum(b >= level > d for b, d, _ in pairs) == flood(np.nan_to_num(f, nan=-np.inf) >= level).max()


def test_two_bumps_and_a_ridge():
    f = np.array([[0.0, 0, 0, 0, 0], [0, 1.0, 0.4, 0.8, 0], [0, 0, 0, 0, 0]])
    assert [(b, d) for b, d, _ in top.persistence(f)] == [(1.0, -np.inf), (0.8, 0.4)]
    assert [(k, b, d) for k, b, d, _ in top.both_signs(f, open_edge=True) if k == "max"] == [("max", 1.0, 0.0), ("max", 0.8, 0.4)]


def test_open_edge_leaves_nothing_essential():
    for f in fields(20):
        assert all(np.isfinite(d) for _, d, _ in top.persistence(f, open_edge=True))


def test_connection_level_is_the_best_bottleneck():
    rng = np.random.default_rng(5)
    for f in fields(30):
        cells = np.flatnonzero(~np.isnan(f.ravel()))
        a, b = map(int, rng.choice(cells, 2))
        want = -np.inf
        for level in np.unique(f[cells // f.shape[1], cells % f.shape[1]]):
            found = flood(np.nan_to_num(f, nan=-np.inf) >= level).ravel()
            if found[a] and found[a] == found[b]:
                want = level
        assert top.connection_level(f, a, b) == (f.ravel()[a] if a == b else want)


def test_necks_meet_the_seed_at_their_connection_level():
    for f in fields(15):
        seed = np.zeros(f.shape, bool)
        seed[:2, :4] = True
        flat = f.ravel()
        cells = np.flatnonzero(seed.ravel() & ~np.isnan(flat))
        if not cells.size:
            continue
        highest = int(cells[np.argmax(flat[cells])])
        for cell, height, saddle, depth in top.necks(f, seed):
            assert height == flat[cell] and depth >= 0
            assert saddle == top.connection_level(f, cell, highest)


def moving(days, gap, back=None):
    """A block joined to the seed block until ``gap``, and again from ``back``."""
    out = []
    for d in range(days):
        f = np.full((6, 12), -1.0)
        f[1:4, 0:4] = 1.0
        f[1:4, 6:9] = 0.8
        if d < gap or back is not None and d >= back:
            f[2, 4:6] = 0.7
        out.append(f)
    return out


def test_detachment_fates():
    seed = np.zeros((6, 12), bool)
    seed[1:4, 0:2] = True
    rule = top.Rule(level=0.5, least_depth=0.1, days=2, window=5)
    (only,) = top.detachments(moving(6, 2), seed, rule)
    assert (only["day"], only["fate"], only["outcome"], only["pixels"], only["final"]) == (2, "record_end", "censored", 9, False)
    (late,) = top.detachments(moving(12, 2), seed, rule)
    assert late["outcome"] == "separated" and late["final"]
    (back,) = top.detachments(moving(12, 2, 5), seed, rule)
    assert (back["fate"], back["fate_day"], back["outcome"]) == ("reattached", 5, "reattached")
    gone = moving(8, 2)
    for f in gone[4:]:
        f[1:4, 6:9] = -1
    (lost,) = top.detachments(gone, seed, rule)
    assert (lost["fate"], lost["fate_day"]) == ("dissipated", 4)


def test_a_shallow_touch_is_no_rejoin_and_no_new_detachment():
    seed = np.zeros((6, 12), bool)
    seed[1:4, 0:2] = True
    rule = top.Rule(level=0.5, least_depth=0.1, days=2, window=5)
    days = moving(12, 2)
    days[4][2, 4:6] = 0.55  # touches for a day, not deep enough
    (only,) = top.detachments(days, seed, rule)
    assert (only["day"], only["fate"], only["touches"], round(only["deepest_touch"], 6)) == (2, "record_end", 1, 0.05)
    days = moving(12, 2, 5)
    days[7][2, 4:6] = -1.0  # deep on two days only, apart for one, then for good
    first, *_ = top.detachments(days, seed, rule)
    assert (first["day"], first["fate"], first["fate_day"], first["outcome"], first["touches"]) == (2, "reattached", 8, "separated", 2) and not first["final"]


def test_events_close_spans_of_reattachments(spark):
    rows = [
        (1, 1, "reattached", "reattached", False, 9), (1, 3, "reattached", "separated", False, 9), (1, 4, "dissipated", "dissipated", False, 9), (1, 5, "dissipated", "separated", True, 9),
        (1, 6, "record_end", "censored", False, 9), (1, 8, "reattached", "reattached", False, 9), (2, 2, "record_end", "separated", True, 9), (2, 1, "reattached", "reattached", False, 1),
    ]
    found = spark.createDataFrame(rows, "series int, day long, fate string, outcome string, final boolean, cell long")
    got = top.separation_events(found, ["series"], F.col("cell") > 4, ["day"]).orderBy("series", "day")
    assert [tuple(r) for r in got.select("series", "day", "censored", "first_day", "reattachments", "late_reattachments").collect()] == [(1, 5, False, 1, 2, 1), (1, 6, True, 6, 0, 0), (2, 2, False, 2, 0, 0)]


def test_images_of_full_size():
    """385 by 525 cells, in seconds."""
    y, x = np.mgrid[:385, :525]
    f = np.sin(y / 31) * np.cos(x / 23) + 0.2 * np.sin(x / 7 + y / 5) + 1e-9 * (y * 525 + x)
    f[300:, 400:] = np.nan
    started = time.monotonic()
    found = top.persistence(f, open_edge=True)
    assert all(np.isfinite(d) for _, d, _ in found)
    a, b = 193 * 525 + 20, 20 * 525 + 500
    level = top.connection_level(f, a, b)
    parts = top.labels(np.nan_to_num(f, nan=-np.inf) >= level).ravel(), top.labels(np.nan_to_num(f, nan=-np.inf) > level).ravel()
    assert parts[0][a] == parts[0][b] and (parts[1][a] == 0 or parts[1][a] != parts[1][b])
    assert time.monotonic() - started < 30


def test_distances_against_all_matchings():
    rng = np.random.default_rng(6)
    for _ in range(40):
        a, b = (np.sort(rng.random((rng.integers(0, 4), 2)), 1)[:, ::-1] for _ in range(2))
        c = top._costs(a, b)
        ways = [[c[i, j] for i, j in enumerate(p)] for p in itertools.permutations(range(len(c)))] if len(c) else [[0.0]]
        assert top.wasserstein(a, b) == pytest.approx(min(map(sum, ways)))
        assert top.bottleneck(a, b) == pytest.approx(min(map(max, ways)))
    assert top.wasserstein(a, a) == 0 and top.bottleneck(np.zeros((0, 2)), np.zeros((0, 2))) == 0


# functions


def test_density_and_calendar(spark):
    row = spark.range(1).select(physics.sigma2(F.lit(10.0), F.lit(35.0)).alias("s"), *(physics.insolation(F.lit(d).cast("date"), F.lit(lat)).alias(n) for n, d, lat in (("equinox", "2024-03-20", 0.0), ("night", "2024-12-21", 80.0), ("day", "2024-06-21", 80.0)))).first()
    c = physics.SIGMA2
    assert row["s"] == pytest.approx(c[0] + c[1] * 10 + c[2] * 35 + c[3] * 100 + c[4] * 350 + c[5] * 1000 + c[6] * 3500)
    assert 425 < row["equinox"] < 445 and row["night"] == pytest.approx(0, abs=1e-9) and row["day"] > 500
    leap = spark.range(1).select(physics.phase(F.lit("2024-12-31").cast("date")).alias("a"), physics.phase(F.lit("2023-12-31").cast("date")).alias("b")).first()
    assert leap["a"] == pytest.approx(2 * math.pi * 365.5 / 366) and leap["b"] == pytest.approx(2 * math.pi * 364.5 / 365)


# rollouts


def test_chunks_change_nothing_and_runs_end_at_their_horizon(spark):
    starts = spark.createDataFrame([("a", 1.0, 5), ("b", -2.0, 2), ("c", 0.0, 0)], "k string, x0 double, h int")
    model = spark.createDataFrame([(k, 0.5, 1.0) for k in "abc"], "k string, slope double, base double")
    whole = values(rollouts.unrolled(starts, model, ["k"], "x0", F.col("h")), "k", "lead", "pred")
    for chunk in (1, 2, 3, 5, 9):  # up to five chunks
        assert whole == values(rollouts.unrolled(starts, model, ["k"], "x0", F.col("h"), chunk=chunk), "k", "lead", "pred")
    assert [r[:2] for r in whole] == [("a", k) for k in range(1, 6)] + [("b", 1), ("b", 2)] and whole[0][2] == 1.5


def test_pairs_of_states_in_chunks_are_one_recurrence(spark):
    """Thirty days, two states, forcing, boundary cells that take the truth, horizons that end early."""
    rng = random.Random(21)
    days = [DAY + timedelta(k) for k in range(31)]
    truth = {(c, d): rng.uniform(-2, 2) for c in range(6) for d in days}
    drive = {(c, d): rng.uniform(0, 1) for c in range(6) for d in days if rng.random() < 0.9}  # some days lack it
    starts = [(c, days[s], truth[c, days[s]], truth[c, days[s - 1]], h) for c in range(6) for s, h in ((1, 29), (5, 3), (9, 0), (20, 10))]
    inputs = [(c, d, f, truth[c, d] if c % 3 == 0 else None) for (c, d), f in drive.items()]
    want = []
    for c, day, last, before, h in starts:
        for lead in range(1, h + 1):
            at = (c, day + timedelta(lead))
            value = truth[at] if c % 3 == 0 and at in drive else 0.8 * last + 0.15 * before + 0.3 * drive.get(at, 0.0)
            last, before = value, last
            want.append((c, day, lead, value))
    step = lambda last, before, given: 0.8 * last + 0.15 * before + 0.3 * F.coalesce(given["f"], F.lit(0.0))
    runs, given = spark.createDataFrame(starts, "c int, day date, x0 double, x1 double, horizon int"), spark.createDataFrame(inputs, "c int, day date, f double, edge double")
    for chunk in (1, 4, 30):
        got = [tuple(r) for r in rollouts.unrolled_pairs(runs, given, ["c"], "day", step, "edge", chunk).select("c", "day", "lead", "pred").collect()]
        assert [r[:3] for r in sorted(got)] == [r[:3] for r in sorted(want)]
        np.testing.assert_allclose([r[3] for r in sorted(got)], [r[3] for r in sorted(want)], rtol=1e-12)
    assert rollouts.unrolled_pairs(runs.where("horizon = 0"), given, ["c"], "day", step, "edge", 4).count() == 0


def test_members_don_t_depend_on_partitions(spark):
    rows = spark.createDataFrame([(k, lead, 1.0) for k in range(500) for lead in (1, 2)], "k int, lead int, pred double")
    made = [{(r["k"], r["lead"], r["member"]): r["pred"] for r in rollouts.ensemble(rows.repartition(n), ["k", "lead"], 4, F.col("lead") * 0.5, 3).collect()} for n in (2, 16)]
    assert made[0] == made[1] and len(made[0]) == 4000
    z = np.array([(v - 1.0) / (0.5 * lead) for (_, lead, _), v in made[0].items()])
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05 and len(set(z)) == 4000
    other = rollouts.ensemble(rows, ["k", "lead"], 4, F.col("lead") * 0.5, 4).first()["pred"]
    assert other not in made[0].values()


def test_registry_names_every_statistic():
    from gridquarry.operators import statistics

    names = statistics.registry()
    assert len(names) == 126 and set(s.family for s in names.values()) == set(statistics.FAMILIES)
    for some in ("rmse_pers_temp", "corr_change_ssh", "mean_salin_0m_truth", "maxspeed_model", "spec_temp_100m_gt200km_ratio", "lc_lce_truth", "lc_north_error", "op_tw_100m_200m_s50_error", "op_cont_s15_lhs_truth", "front_hausdorff_km_pers", "op_inversions_model"):
        assert some in names


def test_main_piece_and_eddies():
    from gridquarry.operators.statistics import pieces

    deep, strip, km2 = np.ones((6, 6), bool), np.zeros((6, 6), bool), np.full((6, 6), 600.0)
    lat = np.repeat(np.arange(20.0, 26.0)[:, None], 6, 1)
    strip[0, :3] = True
    ssh = np.zeros((6, 6))
    ssh[0:3, 1] = 5.0  # on the strip
    ssh[4:6, 4] = 5.0  # two cells: an eddy
    ssh[0, 5] = 5.0  # one cell: too small
    assert pieces(ssh, deep, strip, lat, km2) == (22.0, 1, 1800.0)
    assert pieces(-ssh * 0, deep, strip, lat, km2) == (None, 0, 0.0)
    assert pieces(ssh, deep, np.zeros((6, 6), bool), lat, km2) == (None, 2, 0.0)


def test_scorecard_of_32(spark):
    """Runs every 60 days; energy is half the truth's from lead 12 on, eddies never exist in the truth."""
    from gridquarry.operators import scorecard, statistics

    names = list(statistics.registry())
    days = [date(2020, 1, 1) + timedelta(60 * k) for k in range(28)]
    rows = [(d, lead, *[0.5 if n == "ke_model" and lead >= 12 else 0.0 if n == "lc_lce_truth" else 0.1 * lead * (k + 1) if n in ("mean_ssh_truth", "mean_ssh_model") else 1.0 for n in names]) for k, d in enumerate(days) for lead in range(1, 21)]
    stats = spark.createDataFrame(rows, f"start date, lead int, {', '.join(f'{n} double' for n in names)}")
    got = scorecard.full_scorecard(stats, F.col("start") >= F.lit(date(2024, 2, 2)), F.col("start") < F.lit(date(2022, 1, 1)), (1, 14)).collect()
    assert len(got) == 32 and got[0]["diagnostic"] == "ke" and (got[0]["departs_test"], got[0]["departs_in_sample"], got[0]["d1"], got[0]["d14"]) == (12, 12, 1.0, 0.5)
    rest = {r["diagnostic"]: r for r in got}
    assert [r["diagnostic"] for r in got if r["departs_test"] is None] == sorted(r["diagnostic"] for r in got if r["departs_test"] is None)
    assert rest["lc_lce"]["d1"] is None and rest["lc_lce"]["departs_test"] is None  # infinite
    change = np.std([0.7 * (k + 1) for k in range(28) for _ in range(13)])
    assert math.isclose(rest["mean_ssh"]["high"], change) and rest["mean_ssh"]["low"] == -rest["mean_ssh"]["high"]
    assert rest["geo_s15"]["truth_residual_share"] == 1.0 and rest["geo_s15"]["usable_as_loss"] is False and rest["ke"]["truth_residual_share"] is None
    assert rest["ke"]["n_test"] == sum(d >= date(2024, 2, 2) for d in days)


def test_json_is_sorted(spark):
    got = spark.range(1).select(F.to_json(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b"))).alias("j")).first()[0]
    assert json.loads(got) == {"a": 1, "b": 2} and datetime(2024, 1, 1)


# selection and blocks


def test_row_at_a_rank_without_a_global_sort(spark):
    from gridquarry.operators.selection import at_rank

    rng = random.Random(4)
    for rows in ([(rng.random(), k) for k in range(500)], [(1.0, k) for k in range(200)], [(float(rng.randint(0, 3)), k) for k in range(300)], [(2.0, 1)], []):
        df = spark.createDataFrame(rows, "v double, k int")
        for rank in {0, len(rows) // 2, max(0, len(rows) - 1)}:
            want = sorted(rows)[rank : rank + 1]
            assert [tuple(r) for r in at_rank(df, "v", "k", rank, few=20).collect()] == want
        assert at_rank(df, "v", "k", len(rows)).count() == 0


def test_as_of_by_blocks_is_as_of(spark):
    rng = random.Random(7)
    left = spark.createDataFrame([(rng.randint(1, 2), rng.randint(0, 99), k) for k in range(150)], "k int, t int, id int")
    right = spark.createDataFrame([(rng.randint(1, 2), t, None if t % 5 == 0 else t * 10) for t in rng.sample(range(100), 25)], "k int, t int, v int")
    whole = values(joins.as_of(left, right, ["k"], "t", "v", "got"), "k", "t", "id", "got")
    assert whole == values(joins.as_of(left, right, ["k"], "t", "v", "got", F.floor(F.col("t") / 7)), "k", "t", "id", "got")


def test_quantiles_of_many_ranks(spark):
    from gridquarry.operators.selection import quantiles

    rng = random.Random(12)
    draws = {
        "even": lambda: rng.uniform(-5, 5), "ties": lambda: float(rng.choice([1, 1, 1, 2, 7])), "tail": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300),
        "same": lambda: 4.25, "ends": lambda: rng.choice([-math.inf, math.inf, rng.gauss(0, 1)]), "one": lambda: 3.0, None: lambda: rng.gauss(0, 1), "odd": lambda: rng.choice([None, math.nan, 2.0, 3.0]), "none": lambda: None,
    }
    rows = [(g, draw()) for g, draw in draws.items() for _ in range(1 if g == "one" else 700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    fractions = {"q0": 0.0, "q1": 0.013, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    for few in (1, 30, 10_000):
        got = {r["g"]: r for r in quantiles(df, ["g"], {n: (F.col("v"), f) for n, f in fractions.items()} | {"other": (-F.col("v"), 0.25)}, few).collect()}
        assert got.keys() == draws.keys()
        for g in draws:
            v = np.sort([x for k, x in rows if k == g and x is not None and not math.isnan(x)])
            for n, f in fractions.items():
                if not len(v):
                    assert got[g][n] is None
                elif g != "ends":
                    low, high = v[math.floor(f * (len(v) - 1))], v[math.ceil(f * (len(v) - 1))]
                    assert math.isclose(got[g][n], low + (high - low) * (f * (len(v) - 1) % 1), rel_tol=1e-9), (g, n, few)
            if g == "even":
                assert math.isclose(got[g]["other"], np.quantile(-v, 0.25))
        assert got["ends"]["q0"] == -math.inf and got["ends"]["q100"] == math.inf
    whole = quantiles(df.where("g = 'even'"), [], {"m": (F.col("v"), 0.5)}, 10).first()
    assert math.isclose(whole["m"], np.median([x for k, x in rows if k == "even"]))
    assert quantiles(df.where("false"), ["g"], {"m": (F.col("v"), 0.5)}).count() == 0


# drawn sections, noise, resampling


def plain_drawn(lon, lat, sections, per_cell=4):
    """Point by point, then the four neighbours of each cell."""
    side = min(min(abs(b - a) for a, b in zip(lon, lon[1:], strict=False)), min(abs(b - a) for a, b in zip(lat, lat[1:], strict=False)))
    cells = set()
    for (x0, y0), (x1, y1) in sections:
        n = max(2, math.ceil(per_cell * math.hypot(x1 - x0, y1 - y0) / side) + 1)
        for k in range(n):
            x, y = x0 + (x1 - x0) * k / (n - 1), y0 + (y1 - y0) * k / (n - 1)
            cells.add((min(range(len(lat)), key=lambda i: (abs(lat[i] - y), i)), min(range(len(lon)), key=lambda i: (abs(lon[i] - x), i))))  # noqa: B023
    return {(y + dy, x + dx) for y, x in cells for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) if 0 <= y + dy < len(lat) and 0 <= x + dx < len(lon)}


def test_sections_close_a_basin():
    rng = random.Random(15)
    for ny, nx in ((8, 8), (30, 47)):
        lon, lat = [-98 + 0.25 * x for x in range(nx)], [18 + 0.2 * y for y in range(ny)]
        for _ in range(30):
            sections = [tuple((rng.uniform(lon[0] - 0.3, lon[-1] + 0.3), rng.uniform(lat[0], lat[-1])) for _ in range(2)) for _ in range(2)]
            ocean = np.array([[rng.random() < 0.8 for _ in lon] for _ in lat])
            cells = plain_drawn(lon, lat, sections)
            assert {tuple(c) for c in np.argwhere(top.drawn(np.array(lon), np.array(lat), sections))} == cells
            seed = (rng.choice(lon), rng.choice(lat))
            start, seen = (lat.index(seed[1]), lon.index(seed[0])), set()
            todo = [start] if ocean[start] and start not in cells else []
            while todo:
                y, x = todo.pop()
                if (y, x) not in seen and 0 <= y < ny and 0 <= x < nx and ocean[y, x] and (y, x) not in cells:
                    seen.add((y, x))
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
            found = top.basin(ocean, np.array(lon), np.array(lat), sections, seed)
            assert (set() if found is None else {tuple(c) for c in np.argwhere(found)}) == seen
    # a slanted section from shore to shore parts the two sides, and without it they are one
    whole, lon, lat = np.ones((20, 20), bool), np.arange(20.0), np.arange(20.0)
    part = top.basin(whole, lon, lat, [((-1.0, 4.2), (20.0, 11.7))], (3.0, 15.0))
    assert part[19].all() and not part[0].any() and top.basin(whole, lon, lat, [], (3.0, 15.0)).all()


def test_noise_floor_is_a_plain_run(spark):
    valid = np.ones((16, 20), bool)
    valid[:4, :5] = False
    got = top.noise_floor(spark, valid, (8.0, 8.0), n=24, seed=3).first()
    plain = []
    for k in range(24):
        noise = 0.035 * spectra.correlated_noise((16, 20), (8.0, 8.0), 50.0, 3 * 1_000_003 + k)
        plain += [abs(b - d) for _, b, d, _ in top.both_signs(np.where(valid, noise, np.nan), open_edge=True) if math.isfinite(b - d)]
    assert got["features"] == len(plain) and got["fields"] == 24 and math.isclose(got["floor"], np.quantile(plain, 0.95))
    other = top.noise_floor(spark, valid, (8.0, 8.0), n=24, seed=4).first()
    assert other["floor"] != got["floor"] and abs(other["floor"] / got["floor"] - 1) < 0.25


def test_draws_of_starts_are_multinomial(spark, monkeypatch):
    monkeypatch.setattr(scores, "CELL_STARTS", 16)  # many cells
    rng = np.random.default_rng(8)
    rows = [(f, s, float(rng.normal(2, 1)), float(rng.normal(5, 2)), 1.0) for f, n in (("a", 100), ("b", 3)) for s in range(n)]
    df = spark.createDataFrame(rows, "f string, s int, x double, y double, n double")
    got = scores.bootstrap_sums(df.repartition(5), "f", "s", ["x", "y", "n"], 300, 11).collect()
    assert len(got) == 600 and all(r["n"] == {"a": 100, "b": 3}[r["f"]] for r in got)  # counts sum to the starts
    again = {(r["f"], r["draw"]): r["x"] for r in scores.bootstrap_sums(df.repartition(2), "f", "s", ["x", "y", "n"], 300, 11).collect()}
    assert all(math.isclose(again[r["f"], r["draw"]], r["x"]) for r in got)
    x = np.array([r[2] for r in rows if r[0] == "a"])
    sums = np.array([r["x"] for r in got if r["f"] == "a"])
    assert abs(sums.mean() - x.sum()) < 4 * x.std() * 10 / math.sqrt(300) and abs(sums.std() / (x.std() * 10) - 1) < 0.2


def test_pairs_of_model_truth_and_start():
    rng = np.random.default_rng(4)
    smooth = lambda: spectra.correlated_noise((12, 14), (8.0, 8.0), 20.0, int(rng.integers(1 << 30)))
    truth, start = smooth(), smooth()
    truth[:3, :4] = start[:3, :4] = np.nan
    exact, still = top.pair_scores(truth, truth, start, 0.1), top.pair_scores(start, truth, start, 0.1)
    for kind, *numbers in exact:
        r = dict(zip(top.PAIR_SCORES, numbers, strict=True))
        sign = 1 if kind == "max" else -1
        amplitudes = [b - d for b, d, _ in top.persistence(sign * truth, open_edge=True) if b - d >= 0.1]
        assert r["count_model"] == r["count_truth"] == len(amplitudes) and math.isclose(r["amp_sum_truth"], sum(amplitudes))
        assert math.isclose(r["amp_median_truth"], np.median(amplitudes)) and math.isclose(r["amp_p90_truth"], np.quantile(amplitudes, 0.9))
        assert r["w1_model"] == r["bottleneck_model"] == 0 and r["w1_pers"] >= r["bottleneck_pers"] > 0
    for kind, *numbers in still:
        r = dict(zip(top.PAIR_SCORES, numbers, strict=True))
        assert r["w1_model"] == r["w1_pers"] and r["bottleneck_model"] == r["bottleneck_pers"]
    flat = dict(zip(top.PAIR_SCORES, top.pair_scores(truth * 0, truth, start, 0.1)[0][1:], strict=True))
    assert flat["count_model"] == 0 and math.isnan(flat["amp_median_model"]) and flat["amp_sum_model"] == 0


def test_places_and_ranks_of_large_groups(spark, monkeypatch):
    from gridquarry.operators.selection import placed

    monkeypatch.setattr(scores, "BLOCK", 4)
    rng = random.Random(17)
    rows = [(rng.choice("aaaab"), k, float(rng.randrange(40))) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, k long, v double").repartition(4)
    got = {r["k"]: r["at"] for r in placed(df, ["g"], ["v", "k"], "at").collect()}
    ranks = {r["k"]: r["rank"] for r in scores.ranked(df, ["g"], "v", "rank").collect()}
    for g in "ab":
        mine = sorted((v, k) for x, k, v in rows if x == g)
        assert [got[k] for _, k in mine] == list(range(len(mine)))
        values = [v for v, _ in mine]
        assert all(ranks[k] == values.index(v) + (values.count(v) + 1) / 2 for v, k in mine)
