"""What a task reads or holds stays bounded where tables grow."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquarry import shared
from gridquarry.plans import QUERIES


def plan(spark, sf_dir, name):
    """The physical plan's lines, without adaptive execution and broadcasts by size."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def dealt(lines):
    """(key, parts, whether rows were aggregated before) of each exchange by hash."""
    found = []
    for at, line in enumerate(lines):
        if m := re.search(r"Exchange hashpartitioning\((.*), (\d+)\)", line):
            found.append((re.sub(r"#\d+L?", "", m[1]), int(m[2]), "Aggregate" in "".join(lines[at + 1 : at + 2])))
    return found


@pytest.mark.parametrize("name", ["n01_thickness_weighted_loss", "m03_persistence_loss", "n03_mean_penalty", "q04_functional_table"])
def test_samples_are_summed_before_they_meet_their_field(spark, sf_dir, name):
    by_few = [d for d in dealt(plan(spark, sf_dir, name)) if d[0] in ("field", "lead")]
    assert by_few and all(summed or name == "q04_functional_table" for *_, summed in by_few)
    assert sum(not summed for *_, summed in by_few) == (name == "q04_functional_table")  # the table of weights itself


def test_parts_grow_with_the_files(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity")
    assert shared.spread(rows, "l_orderkey").rdd.getNumPartitions() == 4
    monkeypatch.setattr(shared, "PART_BYTES", 1000)
    assert shared.spread(rows, "l_orderkey").rdd.getNumPartitions() > 16
    assert shared.spread(rows.where(F.lit(False)), "l_orderkey").count() == 0


@pytest.mark.parametrize("name", ["b11_valid_days", "e10_ensemble_scores", "e11_calibration", "e11_gaussian_scores", "f10_projected_thickness", "i06_gaussian_crps", "n04_crps_loss"])
def test_keys_are_dealt_to_parts_that_grow_with_the_files(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(shared, "PART_BYTES", 1000)
    by_key = [parts for key, parts, _ in dealt(plan(spark, sf_dir, name)) if key in ("l_orderkey", "o_orderkey", "col", "key")]
    assert by_key and min(by_key) > 16


def test_a_start_has_one_digest_for_all_its_groups_and_draws(spark):
    from gridquarry.operators import digests, scores

    rows = [(g, s, float(len(g or "") + len(s or "")), 1.0 if g else None) for g in ("A", "bc", None) for s in ("1", "22", "", "x" * 53, "y" * 70, "é", None)]
    df = spark.createDataFrame(rows, "g string, s string, v double, n double").repartition(1)
    steps = [0.3, 0.7, 0.9]

    def share(s, d):
        return 0 if s is None else sum(int(hashlib.md5(f"{s}:{d}".encode()).hexdigest()[:8], 16) / 2**32 >= p for p in steps)

    want = {(g, d): (sum(share(s, d) * v for k, s, v, _ in rows if k == g), sum(share(s, d) * (n or 0) for k, s, _, n in rows if k == g)) for g in ("A", "bc", None) for d in range(1, 13)}
    assert {(r["g"], r["draw"]): (r["v"], r["n"]) for r in scores.poisson_sums(df, "g", "s", ["v", "n"], 12, steps).collect()} == want
    texts = [b"1", b"", b"x" * 53, b"y" * 70]
    assert [h.tolist() for h in digests.heads(np.array([*texts, None], object)[:-1], [":1", ":22"])] == [[int(hashlib.md5(t + e).hexdigest()[:8], 16) for t in texts] for e in (b":1", b":22")]


def test_counts_of_a_cell_are_made_from_picks(spark):
    """A number for each pick, not a binomial number for each start."""
    from gridquarry.operators import scores

    sums = spark.range(3000).select(F.lit("a").alias("g"), "id", F.lit(1.0).alias("n"), (F.col("id") % 7).cast("double").alias("v"))
    rows = scores.bootstrap_sums(sums, "g", "id", ["n", "v"], 300, 5).agg(F.min("n"), F.max("n"), F.avg("v"), F.stddev_pop("v"), F.count("*")).first()
    assert rows[0] == rows[1] == 3000.0 and rows[4] == 300
    assert abs(rows[2] - 3000 * 3) < 40 and 90 < rows[3] < 130  # the std of a draw's sum is 2 times the root of 3,000
    assert scores.picked(np.random.default_rng(1), 4, 0).tolist() == [0, 0, 0, 0] and scores.picked(np.random.default_rng(1), 1, 9).tolist() == [9]


def test_ranked_samples_are_scored_once(spark, sf_dir):
    lines = plan(spark, sf_dir, "g01_best_median_worst")
    assert any("ExistingRDD" in x for x in lines) and not any("lineitem" in x for x in lines)


@pytest.mark.parametrize("name", ["n03_step_loss", "m04_statistics", "j15_step_checks"])
def test_starts_are_sent_their_days_and_no_cells(spark, sf_dir, name):
    """In the whole plan of the steps only whole days go to their start; what is summed of them is dealt after."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = [(key, summed, " ".join(lines[at : at + 2])) for at, line in enumerate(lines) for key, _, summed in dealt(lines[at : at + 2]) if line]
    assert any(key == "start" for key, *_ in found)
    assert not any(re.search(r"\b[yx]\b", key) for key, *_ in found if name != "j15_step_checks")


def test_the_scorecard_is_made_of_starts_that_are_sent_their_days(spark, sf_dir, monkeypatch):
    """In the plan of the statistics that a scorecard stores only whole days go to their start, and no cell by its row or column."""
    from gridquarry.plans import statistics as steps

    class Planned(Exception):
        pass

    made, whole, store = [], steps.ops.statistics, steps.cut

    def cut(df):  # the steps' days are stored as ever; of the statistics the plan is looked at
        if any(df is m for m in made):
            raise Planned(df._jdf.queryExecution().executedPlan().toString())
        return store(df)

    monkeypatch.setattr(steps, "cut", cut)
    monkeypatch.setattr(steps.ops, "statistics", lambda *args: made.append(whole(*args)) or made[-1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with pytest.raises(Planned) as found:
            QUERIES["e22_scorecard"](spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    keys = [key for key, *_ in dealt(str(found.value).splitlines())]
    assert "start" in keys
    assert not any(re.search(r"\b[yx]\b", key) for key in keys)


def test_a_plan_makes_only_the_channels_it_needs(spark, sf_dir):
    """Of nineteen predicted channels a cell has the two that are asked for."""
    from gridquarry.plans import statistics as steps

    of = steps.steps(spark, sf_dir)
    steps.ops.stored_cells(of, {("pred", "ssh"), ("pred", "temp_0m")})
    assert of.cells._jdf.queryExecution().optimizedPlan().toString().count("[1.0,0.7,") == 2


def test_an_image_is_smoothed_once_with_its_slopes(spark):
    """As rows and columns are, null beyond the mask, a missing cell being as one beyond it, for images of any extent; where rows lie by their image without a shuffle."""
    from gridquarry.operators import grids

    rng = np.random.default_rng(3)
    rows = [(k, 1, int(y), int(x), float(v) if v > 0.1 else None, bool(v < 0.9 and (y, x) != (2, 2)), bool(v > 0.3 and (y, x) != (2, 2))) for k, (ny, nx) in enumerate([(5, 7), (1, 1), (9, 4)]) for (y, x), v in np.ndenumerate(rng.random((ny, nx)))]
    df = spark.createDataFrame(rows, "start long, lead int, y long, x long, a double, m boolean, n boolean").withColumn("y", F.col("y") + 3).withColumn("b", F.col("a") ** 2)
    sigmas, by = {"s": 0.6, "t": 1.7}, ["start", "lead"]
    there = "NOT (y = 5 AND x = 2)"
    names = [f"{v}_{s}" for v in "ab" for s in sigmas]
    want = {tuple(r[:4]): r for r in grids.smoothed_by(df, by, {"a": "m", "b": "n"}, sigmas).where(there).select(*by, "y", "x", *names).collect()}
    images = grids.smoothed_images(df.where(there).repartition(3, "start"), by, {"a": "m", "b": "n"}, sigmas, {"a": "xy", "b": "y"})
    got = {tuple(r[:4]): r for r in images.collect()}
    assert got.keys() == want.keys() == {r[:2] + (r[2] + 3, r[3]) for r in rows if r[2:4] != (2, 2)}
    assert all(got[k][n] == want[k][n] for k in want for n in names)
    slope = lambda k, n, dy, dx: None if None in (p := [want[q][n] if (q := (k[0], k[1], k[2] + s * dy, k[3] + s * dx)) in want else None for s in (-1, 0, 1)]) else p[2] - p[0]
    for v, axis, dy, dx in (("a", "x", 0, 1), ("a", "y", 1, 0), ("b", "y", 1, 0)):
        assert all(got[k][f"{v}_d{axis}_{s}"] == slope(k, f"{v}_{s}", dy, dx) for k in want for s in sigmas)
    assert any(got[k]["a_dx_s"] is not None for k in got) and "b_dx_s" not in images.columns
    assert sum("Exchange" in line for line in images._jdf.queryExecution().sparkPlan().toString().splitlines()) == 1


def test_a_field_of_noise_and_its_maxima_take_little_beside_it(monkeypatch):
    """Some rows at a time, with the same result."""
    import tracemalloc

    from gridquarry.operators import spectra
    from gridquarry.operators import topology as top

    valid = np.random.default_rng(1).random((40, 21)) > 0.1
    noise = spectra.correlated_noise(valid.shape, (8.0, 8.0), 30.0, 5)
    size, full = [n + 24 for n in valid.shape], [np.fft.fftfreq(n + 24, 8.0) for n in valid.shape]
    gain = np.exp(-np.add.outer(*(np.square(2 * np.pi * k) for k in full)) * 900 / 4)
    plain = np.fft.ifft2(np.fft.fft2(np.random.default_rng(5).standard_normal(size)) * gain / np.sqrt(np.square(gain).mean())).real[12:-12, 12:-12]
    assert np.allclose(noise, plain, rtol=0, atol=1e-12)
    whole = [top.both_signs(np.where(valid, noise, np.nan), open_edge=o, connectivity=c) for o in (True, False) for c in (4, 8)]
    for m in (spectra, top):
        monkeypatch.setattr(m, "AT_ONCE", 50)
    assert (spectra.correlated_noise(valid.shape, (8.0, 8.0), 30.0, 5) == noise).all()
    assert [top.both_signs(np.where(valid, noise, np.nan), open_edge=o, connectivity=c) for o in (True, False) for c in (4, 8)] == whole
    monkeypatch.undo()
    n, held = 40 * 25_000, []
    for make in (lambda: spectra.correlated_noise((25_000, 40), (8.0, 8.0), 50.0, 1), lambda: top.persistence(np.sin(np.arange(n) / 1000).reshape(25_000, 40))):
        tracemalloc.start()
        make()
        held.append(tracemalloc.get_traced_memory()[1] / n)
        tracemalloc.stop()
    assert held[0] < 50 and held[1] < 80, held  # bytes a cell
