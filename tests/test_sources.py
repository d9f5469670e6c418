"""Listings, binary archives, packs, metrics and reports."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquarry.sources import archive, binary, config, listing, metrics, packs, reports
from gridquarry.streaming import incremental


def test_system_paths_and_free_runs():
    text = 'name = "x"\nroot = "/data/x"\nfree = {}\n[products]\nincrements = "inc/*.a"\nmeans = "m/*.a"\n'
    s = config.System.from_toml(text.format("false"))
    assert s.glob("means") == "/data/x/m/*.a" and "increments" in s.products and s.assimilation
    assert "increments" not in config.System.from_toml(text.format("true")).products
    assert config.parse_years("2001,2010-2012") == [2001, 2010, 2011, 2012]
    assert config.parse_levels("50,0,50", [0, 10, 50]) == [0.0, 50.0] and config.parse_levels("all", [0, 10]) == [0, 10]
    with pytest.raises(ValueError, match="unknown"):
        config.parse_levels("7", [0, 10])


def test_listing_parses_times_and_finds_clashes(spark, tmp_path):
    for name in ("archv.2024_032_18.a", "obs.2024020106.nc", "notes.txt"):
        (tmp_path / name).write_bytes(b"abc")
    got = {r["path"].rsplit("/", 1)[1]: r["valid"] for r in listing.with_valid_time(listing.listing(spark, f"{tmp_path}/*")).collect()}
    assert got == {"archv.2024_032_18.a": datetime(2024, 2, 1, 18), "obs.2024020106.nc": datetime(2024, 2, 1, 6), "notes.txt": None}
    files = spark.createDataFrame([("p", 1, "a"), ("p", 1, "b"), ("p", 2, "c"), ("p", 2, "c")], "product string, valid int, path string")
    assert [tuple(r) for r in listing.clashes(files, ["product", "valid"]).collect()] == [("p", 1, 2)]
    days = spark.createDataFrame([("k", date(2010, 12, 29)), ("k", date(2010, 12, 31)), ("k", date(2011, 1, 2))], "kind string, day date")
    assert {(r["year"], r["days"], r["missing"]) for r in listing.inventory(days, ["kind"]).collect()} == {(2010, 2, 1), (2011, 1, 1)}
    assert listing.unreadable_dirs(f"{tmp_path}/*/x") == []


def test_binary_records(spark, tmp_path):
    shape = (5, 7)
    a = np.arange(70, dtype=">f4").reshape(2, 35)
    a[0, 3] = 1.267651e30
    words = binary.record_words(shape)
    (tmp_path / "one.a").write_bytes(b"".join(np.pad(r, (0, words - 35)).astype(">f4").tobytes() for r in a))
    rows = binary.read_records(spark, f"{tmp_path}/*.a", shape, ["u", "v"]).collect()
    assert len(rows) == 70 and {(r["y"], r["x"]): r["value"] for r in rows if r["name"] == "v"}[2, 3] == 35 + 17
    assert [r for r in rows if r["value"] is None][0]["x"] == 3
    assert binary.read_records(spark, f"{tmp_path}/*.a", shape, ["u", "v"], stride=2).count() == 2 * 3 * 4
    (tmp_path / "depth.b").write_bytes(np.pad(a[0], (0, words - 35)).astype(">f4").tobytes())
    assert {(r["y"], r["x"]): r["depth"] for r in binary.read_depths(spark, f"{tmp_path}/depth.b", shape).collect()}[0, 3] == 0.0
    (tmp_path / "bad.a").write_bytes(b"xx")
    with pytest.raises(Exception, match="bytes"):
        binary.read_records(spark, f"{tmp_path}/bad.a", shape, ["u"]).count()


def test_pack_is_resumed_guarded_and_finished(spark, tmp_path):
    rows = spark.createDataFrame([(date(2024, 1, d), c, "f", float(d * c)) for d in range(1, 8) for c in (1, 2)], "day date, cell int, feature string, value double")
    pack = packs.Pack(spark, str(tmp_path / "pack"))
    first = rows.select("day").distinct().where("day < DATE '2024-01-04'")
    pack.build(rows, {"stride": 4}, first)
    assert pack.rows().count() == 6 and not pack.complete
    pack.build(rows, {"stride": 4}).build(rows, {"stride": 4})
    assert pack.rows().count() == 14 and pack.rows(2024).count() == 14 and pack.rows(2023).count() == 0
    with pytest.raises(ValueError, match="stride"):
        pack.build(rows, {"stride": 2})
    pack.finish(["cell"], "2024-01-05")
    assert pack.complete and pack.statistics().first()["n"] == 10


def test_stacked_members_need_equal_coordinates(spark):
    a = spark.createDataFrame([(1, 2.0)], "cell int, value double")
    assert packs.stacked({"a": a, "b": a}, ["cell"]).count() == 2
    with pytest.raises(ValueError, match="cell"):
        packs.stacked({"a": a, "b": a.withColumn("cell", F.lit(7))}, ["cell"])


def test_parts_of_another_run_clash(spark, tmp_path):
    rows = spark.createDataFrame([(s, k, 1.0) for s in (1, 2) for k in (1, 2)], "start int, lead int, pred double")
    starts = rows.select("start").distinct()
    assert packs.append_parts(spark, str(tmp_path), rows, starts.where("start = 1"), 2, "h").count() == 2
    assert packs.append_parts(spark, str(tmp_path), rows, starts, 2, "h").count() == 4
    with pytest.raises(ValueError, match="another"):
        packs.append_parts(spark, str(tmp_path), rows, starts, 3, "h")


def test_metrics(spark):
    runs = spark.createDataFrame([("u", "stage")], "run_uuid string, name string")
    rows = spark.createDataFrame([("u", "loss", float(v), k) for k, v in enumerate([3, 2, float("nan"), 1])], "run_uuid string, key string, value double, step int")
    assert metrics.histories(runs, rows.where("step <> 2"), "loss").first()["values"] == [3.0, 2.0, 1.0]
    r = metrics.curves(rows, ["run_uuid"], 2).first()
    assert (r["n"], r["bad"], r["medians"]) == (4, 1, [2.5, 1.0])
    assert metrics.latest(rows, ["run_uuid"]).first()["value"] == 1.0


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456), ("b", float("nan")), ("c", None)], "name string, score double")
    assert [r["line"] for r in reports.markdown(df, 2).collect()] == ["| a | 1.23 |", "| b |  |", "| c |  |"]
    assert reports.header(df) == "| name | score |\n|---|---|"
    reports.write_csv(df, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).fillna("").collect()) == [("a", "1.23456"), ("b", ""), ("c", "")]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(k, datetime(2024, 1, 1, k), float(k)) for k in range(20)], "id long, ts timestamp, v double")
    rows.where("id < 10").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: incremental.stream_of(spark, str(tmp_path / "in"), rows.schema)
    assert incremental.append_new(stream(), str(tmp_path / "state"), ["id"]).count() == 10
    rows.where("id >= 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert incremental.append_new(stream(), str(tmp_path / "state"), ["id"]).count() == 20
    out = incremental.run_once(incremental.window_means(stream(), "ts", "v", [], "6 hours", "0 seconds"), str(tmp_path / "windows"))
    assert sorted(r["n"] for r in out.collect()) == [6, 7, 12] or out.count() == 3


def test_a_batch_writes_one_file_to_a_folder(spark, tmp_path):
    spark.range(4000).select("id").repartition(4).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stream = incremental.stream_of(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files=4)
        assert incremental.append_new(stream, str(tmp_path / "state"), ["id"], F.expr("id div 100")).count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "state" / "rows").glob("*/*/*.parquet"))) == 40


def test_streaks_are_kept_between_batches(spark, tmp_path):
    flags = [1, 1, 0, 1, 1, 1, 0, 0, 1, 0]
    for k, f in enumerate(flags):
        spark.createDataFrame([(1, datetime(2024, 1, 1, k), bool(f))], "k long, ts timestamp, on boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out = incremental.run_once(incremental.streaks(incremental.stream_of(spark, str(tmp_path / "in"), schema, files=100), "k", "ts", "on", "0 seconds"), str(tmp_path / "out"))
    assert sorted(r["n"] for r in out.collect()) == [1, 2, 3]


# archives as a data source


def days_frame(spark):
    rows = [(date(2010, 12, 29) + timedelta(d), n, z, y, x, None if (y, x) == (0, 1) else d + (z or 0) + y / 8 + x) for d in range(6) for n, z in (("temp", 0.0), ("temp", 100.0), ("ssh", None)) for y in range(4) for x in range(6)]
    return rows, spark.createDataFrame(rows, "day date, name string, level double, y long, x long, value double")


def test_archive_reads_what_is_asked_for(spark, tmp_path):
    rows, df = days_frame(spark)
    records = archive.records_of("temp:0, temp:100, ssh")
    wrote = archive.write_archive(df, str(tmp_path), (4, 6), records).collect()
    assert len(wrote) == 6 and {r["bytes"] for r in wrote} == {3 * 4 * binary.PAD} and (tmp_path / "a.2010_363_00.a").exists()
    read = lambda **kw: archive.read_archive(spark, str(tmp_path), (4, 6), "temp:0,temp:100,ssh", **kw)
    plain = lambda df: sorted(map(repr, (tuple(r) for r in df.select("day", "name", "level", "y", "x", "value").collect())))
    assert plain(read()) == sorted(map(repr, rows))
    assert plain(read(stride=3)) == sorted(repr(r) for r in rows if r[3] % 3 == 0 and r[4] % 3 == 0)
    picks = archive.Picks(("temp",), (50.0, None), (date(2011, 1, 1), None))
    some = read(picks=picks).where("x < 3")
    assert plain(some) == sorted(repr(r) for r in rows if r[1] == "temp" and r[2] == 100 and r[0] >= date(2011, 1, 1) and r[4] < 3)
    assert some.rdd.getNumPartitions() == 3  # the other days' files aren't opened
    plan = some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(name,temp)" in plan and "GreaterThanOrEqual(day,2011-01-01)" in plan and "GreaterThanOrEqual(level,50.0)" in plan
    condition = next(line for line in plan.splitlines() if line.startswith("Condition"))
    assert "x#" in condition and "temp" not in condition  # what is left to Spark
    assert read(picks=archive.Picks(("ssh", "none"))).count() == 6 * 24 and read().where("level IS NULL").count() == 6 * 24
    # one table used twice: what one use asks for doesn't reach the other
    whole = read()
    both = whole.where("name = 'ssh'").union(whole.where("name = 'temp' AND level = 0"))
    assert {r["name"]: r["count"] for r in both.groupBy("name").count().collect()} == {"ssh": 144, "temp": 144} and whole.count() == 432
    twice = some.union(some.where("y = 0")).union(read(picks=archive.Picks(("ssh",))))
    assert {r["name"]: r["count"] for r in twice.groupBy("name").count().collect()} == {"temp": 3 * 12 + 3 * 3, "ssh": 144}
    (tmp_path / "a.2011_005_00.a").write_bytes(b"\x00" * 100)
    with pytest.raises(Exception, match="100 bytes"):
        read(picks=archive.Picks(days=(date(2011, 1, 5), None))).count()
    assert read(picks=archive.Picks(days=(None, date(2011, 1, 4)))).count() == 6 * 72


def test_archive_of_members_and_text_files(spark, tmp_path):
    rows, df = days_frame(spark)
    records = [archive.Record("temp", 0.0, 8), archive.Record("temp", 100.0, 8), archive.Record("ssh", None, 4)]
    years = df.withColumn("year", F.year("day"))
    wrote = archive.write_archive(years, str(tmp_path), (4, 6), records, lambda key: f"old/{key[0]}.tar" if key[0] < 2011 else f"new/{key[0]}.zip", ["year"]).collect()
    assert sorted((r["path"].split("/")[-2:], r["files"]) for r in wrote) == [(["new", "2011.zip"], 3), (["old", "2010.tar"], 3)]
    whole = archive.read_archive(spark, str(tmp_path), (4, 6))
    assert sorted(map(repr, (tuple(r) for r in whole.select("day", "name", "level", "y", "x", "value").collect()))) == sorted(map(repr, rows))
    assert {tuple(r) for r in whole.select("name", "parts").distinct().collect()} == {("temp", 8), ("ssh", 4)}
    one = archive.read_archive(spark, str(tmp_path), (4, 6), picks=archive.Picks(("ssh",), days=(date(2011, 1, 1), None)))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 72
    assert archive.expected(whole, ["a.2010_363_00.a"]) is whole
    with pytest.raises(FileNotFoundError, match="2012"):
        archive.expected(whole, ["a.2010_363_00.a", "2012.zip"])


def test_many_files_share_tasks(spark, tmp_path):
    """A task for each of thousands of small files sends the driver more than the files hold."""
    image = np.zeros(binary.PAD, ">f4")
    for k in range(600):
        image[1] = k
        (tmp_path / f"a.{2000 + k // 300}_{1 + k % 300:03d}_00.a").write_bytes(image.tobytes())
    read = archive.read_archive(spark, str(tmp_path), (1, 2), "v")
    assert archive.ALONE / 2 < read.rdd.getNumPartitions() <= archive.ALONE
    assert sorted(r["value"] for r in read.where("x = 1").collect()) == list(range(600)) and read.select("path").distinct().count() == 600
    files = [archive.File(str(k), None, size) for k, size in enumerate([1 << 28, *[10] * 1000, 1 << 28])]
    tasks = archive.dealt(files)
    assert [f for t in tasks for f in t.files] == files and all(len(t.files) for t in tasks)
    assert len(tasks[0].files) == len(tasks[-1].files) == 1 and len(archive.dealt(files[:9])) == 9 and archive.dealt([]) == []


def test_days_and_records_from_text():
    assert archive.day_in("a.2011_002_18.a") == date(2011, 1, 2) and archive.day_in("x_2011010312.a") == date(2011, 1, 3) and archive.day_in("depth.a") is None
    assert archive.described("a header\nthknss  =  12  1\nsalin = 12 1.5\nmontg1 = 6\n") == [archive.Record("thknss", 1.0, 12), archive.Record("salin", 1.5, 12), archive.Record("montg1", None, 6)]
