"""Queries over every row of their tables, by small tables or plain counts."""

import pandas as pd

from gridquarry.operators import joins
from gridquarry.operators import topology as top
from gridquarry.plans import QUERIES


def read(sf_dir, name):
    return pd.read_parquet(f"{sf_dir}/{name}.parquet")


def test_losses_after_the_fortieth_step_count(spark, tmp_path):
    parked = [99.0] * 3 + [-99.0] * 42 + [99.0] * 15
    falling = [(1.199 * 0.988 ** (min(step, 50) // 5) - 1.1) * 1000 for step in range(1, 61)]
    rows = [(k, run, v) for run, values in enumerate([parked, falling]) for k, v in enumerate(values, 100 * run)]
    pd.DataFrame(rows, columns=["c_custkey", "c_nationkey", "c_acctbal"]).to_parquet(tmp_path / "customer.parquet")
    pd.DataFrame({"n_nationkey": [0, 1], "n_name": ["parked", "falling"]}).to_parquet(tmp_path / "nation.parquet")
    got = lambda name: {r["run"]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("f05_collapse")[0]["epoch"] == 46
    assert got("f17_stage_verdicts")[0]["collapsed"]
    last = got("f07_plateau")[1]
    assert (last["stopped"], last["decays"], last["best"]) == (58, 12, round(1.199 * 0.988**10, 6))


def test_every_field_has_a_connection_level(spark, sf_dir):
    want = {r.vec_id: round(float(top.connection_level(r.embedding.astype(float).reshape(8, 8), 0, 63)), 8) for r in read(sf_dir, "embeddings").itertuples()}
    assert dict(map(tuple, QUERIES["l05_connection_levels"](spark, sf_dir).select("id", "level").collect())) == want and len(want) > 8


def test_far_points_have_their_nearest_too(spark):
    a = {1: (0.0, 0.0), 2: (0.5, 300.0), 3: (-70.0, 2.0), 4: (3.0, 3.0), 5: (float("nan"), 1.0), 6: (float("inf"), 1.0), 7: (1.5, None)}
    b = {k: (float(k % 5), float(k // 5)) for k in range(20)}
    left, right = (spark.createDataFrame([(k, *v) for k, v in some.items()], f"{n} int, x double, y double") for n, some in (("a", a), ("b", b)))
    for k in (4, 50):
        want = {i: sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, (u, v) in b.items())[:k] for i, (x, y) in list(a.items())[:4]}
        got = {i: [] for i in want}
        for r in joins.nearest(left, right, k, 1.0).collect():
            got[r["a"]].append((r["distance"], r["b"]))
        assert {i: sorted(v) for i, v in got.items()} == want
    assert joins.nearest(left, right.where("false"), 4, 1.0).count() == 0


def test_every_cell_has_four_neighbours(spark, tmp_path):
    pd.DataFrame({"p_partkey": [0, 100, 4000], "p_size": [1, 2, 3], "p_retailprice": [900.0, 950.0, 990.0]}).to_parquet(tmp_path / "part.parquet")
    pd.DataFrame({"c_custkey": range(1000, 1300)}).to_parquet(tmp_path / "customer.parquet")
    got = QUERIES["d08_nearest_neighbours"](spark, str(tmp_path)).collect()
    assert sorted((r["cell"], r["n"]) for r in got) == [(0, 4), (100, 4), (4000, 4)]


def test_every_start_is_written_as_parts(spark, sf_dir):
    lines = read(sf_dir, "lineitem")
    got = QUERIES["b10_rollout_parts"](spark, sf_dir)
    assert got.count() == len(lines[["l_orderkey", "l_linenumber"]].drop_duplicates())
    assert got.select("start").distinct().count() == lines["l_orderkey"].nunique()


def test_every_row_of_the_image_is_archived(spark, sf_dir):
    part = read(sf_dir, "part")
    rows = set(part["p_partkey"] // 40)
    assert QUERIES["a06_bottom_depths"](spark, sf_dir).first()["cells"] == 40 * len(rows)
    got = QUERIES["a07_mean_archive"](spark, sf_dir).collect()
    assert {(r["name"], r["y"]) for r in got} == {(n, y) for n in ("thickness", "surface") for y in rows}


def test_every_order_is_a_file(spark, sf_dir):
    orders = read(sf_dir, "orders")
    days = orders.groupby("o_orderstatus")["o_orderdate"].agg(lambda d: set(pd.to_datetime(d).dt.date))
    every = set().union(*days)
    have = {"start": ("F", -1), "applied": ("P", -1), "mean": ("O", 0), "end": ("F", 0), "observed": ("O", 1)}
    want = {role: sum(d + pd.Timedelta(days=o) not in days[p] for d in every) for role, (p, o) in have.items()}
    assert {r["role"]: r["missing"] for r in QUERIES["d02_missing_roles"](spark, sf_dir).collect()} == {k: n for k, n in want.items() if n}
    assert QUERIES["d01_cycles"](spark, sf_dir).where("path IS NOT NULL").count() == sum(len(every) - n for n in want.values())
    paths = set(zip(orders["o_orderstatus"], pd.to_datetime(orders["o_orderdate"]).dt.date, orders["o_orderkey"] % 2, strict=True))
    assert sum(r["n"] for r in QUERIES["a02_catalog_index"](spark, sf_dir).collect()) == len(paths)
    both = pd.Series([p[:2] for p in paths]).value_counts()
    assert QUERIES["a02_clashes"](spark, sf_dir).count() == (both > 1).sum()


def test_all_events_take_part_in_the_blocks(spark, sf_dir):
    events = read(sf_dir, "events").sort_values("ts")
    odd = events["user_id"] % 2 != 0
    want = pd.merge_asof(events[odd], events.loc[~odd, ["event_type", "ts", "event_id"]].rename(columns={"event_id": "epoch"}), on="ts", by="event_type")
    got = {r["event_id"]: r["epoch"] for r in QUERIES["d13_as_of_blocks"](spark, sf_dir).collect()}
    assert got == {i: None if pd.isna(e) else int(e) for i, e in zip(want["event_id"], want["epoch"], strict=True)}
