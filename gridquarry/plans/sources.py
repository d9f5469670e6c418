"""Scans and sinks."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..shared import shared_folder
from ..sources import archive
from ..sources import listing as lists
from ..sources import metrics as met
from ..sources import packs, reports
from .registry import query
from .scores import tidy
from .tables import DAILY, FIELDS, IMAGE, SAMPLES, daily, fields, image, lined, samples, table


def shared(spark) -> str:
    """A new folder under the one that driver and executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


NAMES = "files AS (SELECT o_orderstatus AS product, '/arch/' || o_orderstatus || '/a.' || strftime(o_orderdate, '%Y_%j') || '_18.' || (o_orderkey % 2) AS path, o_orderdate + INTERVAL 18 HOUR AS valid FROM orders)"


def names(spark, sf):
    path = F.concat(F.lit("/arch/"), "o_orderstatus", F.lit("/a."), F.date_format("o_orderdate", "yyyy_DDD"), F.lit("_18."), (F.col("o_orderkey") % 2).cast("string"))
    return lists.with_valid_time(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("product"), path.alias("path")))


@query("a02_catalog_index", f"WITH {NAMES} SELECT product, valid, min(path) AS path, count(DISTINCT path) AS n FROM files GROUP BY ALL")
def catalog(spark, sf):
    """Files by product and the valid time in their names."""
    return names(spark, sf).groupBy("product", "valid").agg(F.min("path").alias("path"), F.count_distinct("path").alias("n"))


@query("a02_clashes", f"WITH {NAMES} SELECT product, valid, count(DISTINCT path) AS n FROM files GROUP BY ALL HAVING count(DISTINCT path) > 1")
def clashes(spark, sf):
    return lists.clashes(names(spark, sf), ["product", "valid"])


@query("a04_inventory", "WITH d AS (SELECT DISTINCT o_orderstatus AS kind, CAST(o_orderdate AS DATE) AS day FROM orders), e AS (SELECT kind, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY kind) SELECT e.kind, CAST(year(e.day) AS INT) AS year, count(d.day) AS days, count_if(d.day IS NULL) AS missing FROM e LEFT JOIN d ON d.kind = e.kind AND d.day = e.day GROUP BY ALL")
def inventory(spark, sf):
    return lists.inventory(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("kind"), F.to_date("o_orderdate").alias("day")), ["kind"])


#: The channels of a day's file: layers at levels, then the surface; a day has a field for each.
DAY_LEVELS = (0, 100, 200, 500)
DAY_RECORDS = [(v, z) for v in ("temp", "salin", "u", "v") for z in DAY_LEVELS] + [("ssh", None), ("ubaro", None), ("vbaro", None)]
DAY_FILES = FIELDS + f""", channel AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{n}', {'NULL' if z is None else f'{z}::DOUBLE'})" for k, (n, z) in enumerate(DAY_RECORDS))}) c(c, name, level)),
    stored AS (SELECT DATE '2024-01-01' + CAST(id // {len(DAY_RECORDS)} AS INTEGER) AS day, name, level, (i - 1) // 8 AS y, (i - 1) % 8 AS x, v[i] AS value FROM fields JOIN channel ON c = id % {len(DAY_RECORDS)}, range(1, 65) t(i))"""


@query("a05_level_pick", f"WITH {DAY_FILES} SELECT day, name, level, y, x, value FROM stored WHERE name IN ('temp', 'salin') AND level >= 100 AND level < 500 AND day >= DATE '2024-01-05' AND y % 2 = 0 AND x % 2 = 0")
def level_pick(spark, sf):
    """Levels, names and days picked from an archive of daily files, every second cell: other files aren't opened, of these only the records asked for are read."""
    n = len(DAY_RECORDS)
    names = F.create_map(*(F.lit(v) for k, (name, _) in enumerate(DAY_RECORDS) for v in (k, name)))
    levels = F.create_map(*(F.lit(v).cast("double") if j else F.lit(v) for k, (_, z) in enumerate(DAY_RECORDS) for j, v in enumerate((k, z))))
    rows = fields(spark, sf).select(F.expr(f"date_add(DATE '2024-01-01', int(id div {n}))").alias("day"), (F.col("id") % n).cast("int").alias("c"), F.posexplode("v").alias("at", "value"))
    rows = rows.select("day", names[F.col("c")].alias("name"), levels[F.col("c")].alias("level"), F.expr("bigint(at div 8)").alias("y"), (F.col("at") % 8).cast("long").alias("x"), "value")
    folder, records = shared(spark), [archive.Record(name, None if z is None else float(z)) for name, z in DAY_RECORDS]
    archive.write_archive(rows, folder, (8, 8), records).agg(F.sum("bytes")).collect()
    days = archive.read_archive(spark, folder, (8, 8), ",".join(r.name if r.level is None else f"{r.name}:{r.level:g}" for r in records), 2, archive.Picks(("temp", "salin"), (100.0, 200.0), (date(2024, 1, 5), None)))
    return days.where("value IS NOT NULL").select("day", "name", "level", "y", "x", "value")


@query("a08_hourly_records", "WITH r AS (SELECT date_trunc('hour', ts + INTERVAL 30 MINUTE) AS hour, event_id, value FROM events) SELECT hour, arg_min(event_id, event_id) AS file, round(arg_min(value, event_id), 6) AS value FROM r GROUP BY hour")
def hourly_records(spark, sf):
    """Records by hour, rounded; of several files the first wins."""
    hour = F.date_trunc("hour", F.col("ts") + F.expr("INTERVAL 30 MINUTES")).cast("timestamp_ntz")
    rows = table(spark, sf, "events").groupBy(hour.alias("hour")).agg(F.min("event_id").alias("file"), F.min_by("value", "event_id").alias("value"))
    return tidy(rows, 6)


LIMITS = {"temp": 0.05, "salin": 0.03, "pin": 30.0}


@query("a09_layer_observations", """WITH d AS (SELECT l_orderkey AS prof, l_linenumber - 1 AS layer, l_discount AS temp, l_tax AS salin, l_quantity AS pin FROM lineitem),
    u AS (SELECT prof, layer, type, val FROM d UNPIVOT (val FOR type IN (temp, salin, pin))) SELECT prof, layer, type, round(val, 6) AS val, round(val - val/3, 6) AS hxb, abs(val/3) > CASE type WHEN 'temp' THEN 0.02 WHEN 'salin' THEN 0.02 ELSE 12.0 END AS clipped FROM u WHERE val > 0.015""")
def layer_observations(spark, sf):
    """Dense observations to one row a valid one: value, background from the innovation, and whether it is clipped."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("prof"), (F.col("l_linenumber") - 1).alias("layer"), F.col("l_discount").alias("temp"), F.col("l_tax").alias("salin"), F.col("l_quantity").alias("pin"))
    rows = rows.unpivot(["prof", "layer"], ["temp", "salin", "pin"], "type", "val").where("val > 0.015")
    limit = F.when(F.col("type").isin("temp", "salin"), 0.02).otherwise(12.0)
    return tidy(rows.select("prof", "layer", "type", "val", (F.col("val") - F.col("val") / 3).alias("hxb"), (F.abs(F.col("val") / 3) > limit).alias("clipped")), 6)


@query("a10_statics", f"WITH {IMAGE} SELECT y, x, v IS NOT NULL AS ocean, round(coalesce(v, 0), 4) AS depth FROM image")
def statics(spark, sf):
    """The grid's dimension table, land having depth 0."""
    return tidy(image(spark, sf).select("y", "x", F.col("v").isNotNull().alias("ocean"), F.coalesce("v", F.lit(0.0)).alias("depth")))


@query("a12_standardized", f"WITH {DAILY}, s AS (SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS std FROM daily WHERE day <= DATE '2024-01-20' GROUP BY feature) SELECT cell, day, feature, round((value - mean)/std, 6) AS z FROM daily JOIN s USING (feature) WHERE day > DATE '2024-01-20'")
def standardized(spark, sf):
    """A split of the pack in units of the training statistics."""
    from ..operators.moments import moments

    rows = daily(spark, sf)
    stats = moments(rows.where("day <= DATE '2024-01-20'"), ["feature"], "value")
    return tidy(rows.where("day > DATE '2024-01-20'").join(stats, "feature").select("cell", "day", "feature", ((F.col("value") - F.col("mean")) / F.col("std")).alias("z")), 6)


RUNS = "runs AS (SELECT n_nationkey::VARCHAR AS run_uuid, n_name AS name FROM nation), metrics AS (SELECT c_nationkey::VARCHAR AS run_uuid, CASE c_custkey % 2 WHEN 0 THEN 'loss' ELSE 'lr' END AS key, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS value, c_custkey AS step FROM customer)"


def metrics(spark, sf):
    runs = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("run_uuid"), F.col("n_name").alias("name"))
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("run_uuid"), F.when(F.col("c_custkey") % 2 == 0, "loss").otherwise("lr").alias("key"), F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")).alias("value"), F.col("c_custkey").alias("step"))
    return runs, rows


@query("a06_bottom_depths", f"WITH {IMAGE} SELECT count(*) AS cells, round(sum(coalesce(CAST(CAST(v AS FLOAT) AS DOUBLE), 0)), 1) AS total FROM image")
def bottom_depths(spark, sf):
    """Depths written as big-endian records, one file a row of the image, and read again; invalid is 0. The records' 32 bits show in the total."""
    import numpy as np
    import pandas as pd

    from ..sources.binary import FILL, decoded, record_words

    words, folder = record_words((1, 40)), shared(spark)

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros(words, ">f4")
        line[p["x"].to_numpy()] = p["v"].fillna(2 * FILL).to_numpy()
        return pd.DataFrame({"path": [f"depth_{p['y'].iloc[0]}"], "content": [line.tobytes()]})

    image(spark, sf).groupBy("y").applyInPandas(pack, "path string, content binary").write.parquet(folder)
    rows = decoded(spark.read.parquet(folder), (1, 40), ["depth"])
    return tidy(rows.agg(F.count("*").alias("cells"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total")), 1)


@query("a07_mean_archive", f"WITH {IMAGE} SELECT name, y, (12 * k)::BIGINT AS parts, count(*) AS cells, round(sum(CAST(CAST(coalesce(v, 0)*k AS FLOAT) AS DOUBLE)), 1) AS total FROM image, (VALUES ('thickness', 1), ('surface', 2)) n(name, k) GROUP BY ALL")
def mean_archive(spark, sf):
    """Archives of two records, which the text files beside them name and say of how many times each is the mean."""
    lines = image(spark, sf).select(F.expr("date_add(DATE '2000-01-01', int(y))").alias("day"), F.lit(0).cast("long").alias("y"), "x", F.coalesce("v", F.lit(0.0)).alias("v"))
    kinds = F.array(F.struct(F.lit("thickness").alias("name"), F.lit(1).alias("k")), F.struct(F.lit("surface").alias("name"), F.lit(2).alias("k")))
    rows = lines.select("day", "y", "x", "v", F.inline(kinds)).select("day", "name", F.lit(1.0).alias("level"), "y", "x", (F.col("v") * F.col("k")).alias("value"))
    folder = shared(spark)
    archive.write_archive(rows, folder, (1, 40), [archive.Record("thickness", 1.0, 12), archive.Record("surface", 1.0, 24)]).agg(F.sum("bytes")).collect()
    got = archive.read_archive(spark, folder, (1, 40)).withColumn("line", F.datediff("day", F.lit("2000-01-01")).cast("long"))
    cells = image(spark, sf).groupBy(F.col("y").alias("line")).agg(F.max("x").alias("last"))  # the last line of the image may be short
    return tidy(got.join(cells, "line").where("x <= last").groupBy("name", F.col("line").alias("y"), "parts").agg(F.count("*").alias("cells"), F.sum("value").alias("total")), 1)


SYSTEM = """
name = "stand-in"
root = "/archive"
free = true
[products]
means = "F/*.a"
increments = "P/*.a"
forcing = "O/*.a"
"""


@query("a01_products", "SELECT product, n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'means' WHEN 'O' THEN 'forcing' END AS product, count(*) AS n FROM orders GROUP BY ALL) WHERE product IS NOT NULL")
def products(spark, sf):
    """Files of each product of a system; a free run has none of assimilation."""
    from ..sources.config import System

    system = System.from_toml(SYSTEM)
    kinds = F.create_map(*(F.lit(x) for product in system.products for x in (system.glob(product).split("/")[2], product)))
    rows = table(spark, sf, "orders").select(F.try_element_at(kinds, F.col("o_orderstatus")).alias("product"))
    return rows.where("product IS NOT NULL").groupBy("product").agg(F.count("*").alias("n"))


@query("c10_chosen_years", f"WITH {SAMPLES} SELECT year(o_orderdate)::INT AS y, l_linenumber AS level, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE year(o_orderdate) IN (1996, 1998, 1999, 2000) AND l_linenumber IN (2, 5) GROUP BY ALL")
def chosen_years(spark, sf):
    """Years and levels given as text."""
    from ..sources.config import parse_levels, parse_years

    years, levels = parse_years("1996,1998-2000"), parse_levels("5,2", list(range(1, 8)))
    orders = table(spark, sf, "orders").where(F.year("o_orderdate").isin(years)).select("o_orderkey", F.year("o_orderdate").alias("y"))
    lines = table(spark, sf, "lineitem").where(F.col("l_linenumber").isin([int(x) for x in levels])).select("l_orderkey", F.col("l_linenumber").alias("level"))
    return lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("y", "level").agg(F.count("*").alias("n"))


@query("a13_file_of_year", "SELECT o_orderkey AS key, CASE WHEN year(o_orderdate) < 1998 THEN 'old/' ELSE 'new/' END || year(o_orderdate) || CASE WHEN year(o_orderdate) < 1998 THEN '.tar' ELSE '.zip' END AS path FROM orders")
def file_of_year(spark, sf):
    """Archive names, which differ by era."""
    y = F.year("o_orderdate")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.when(y < 1998, "old/").otherwise("new/"), y.cast("string"), F.when(y < 1998, ".tar").otherwise(".zip")).alias("path"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("a13_unpacked", f"""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, list_position({list(PRIORITIES)}, o_orderpriority) - 1 AS x, count(*) AS n, max(o_totalprice) AS largest FROM orders GROUP BY ALL)
    SELECT day, x::BIGINT AS x, CASE WHEN year(day) < 1998 THEN 'old/' ELSE 'new/' END || year(day) || CASE WHEN year(day) < 1998 THEN '.tar' ELSE '.zip' END AS file, round(CAST(CAST(largest AS FLOAT) AS DOUBLE), 4) AS value FROM d WHERE year(day) IN (1996, 1998, 1999)""")
def unpacked(spark, sf):
    """Years of daily records packed into tar files of one era and zip files of the other; of chosen years one variable is read from the members."""
    place = F.array_position(F.array(*(F.lit(p) for p in PRIORITIES)), F.col("o_orderpriority")) - 1
    rows = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day"), place.cast("long").alias("x")).agg(F.count("*").cast("double").alias("n"), F.max("o_totalprice").alias("largest"))
    rows = rows.unpivot(["day", "x"], ["n", "largest"], "name", "value").select(F.year("day").alias("year"), "day", "name", F.lit(None).cast("double").alias("level"), F.lit(0).cast("long").alias("y"), "x", "value")
    folder = shared(spark)
    archive.write_archive(rows, folder, (1, 5), [archive.Record("n"), archive.Record("largest")], lambda key: f"old/{key[0]}.tar" if key[0] < 1998 else f"new/{key[0]}.zip", ["year"]).agg(F.sum("files")).collect()
    picks = archive.Picks(("largest",), days=(date(1996, 1, 1), date(1999, 12, 31)))
    found = archive.read_archive(spark, folder, (1, 5), "n,largest", picks=picks).where("year(day) <> 1997 AND value > 0")
    file = F.regexp_extract("path", "((?:old|new)/[^/!]*)!", 1)
    return tidy(found.select("day", "x", file.alias("file"), "value"))


@query("a14_rows_of_year", "SELECT month(o_orderdate)::INT AS month, count(*) AS n FROM orders WHERE year(o_orderdate) = 1999 GROUP BY ALL")
def rows_of_year(spark, sf):
    """One year of a pack, by a range of days that prunes what is read."""
    rows = table(spark, sf, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1999-01-01' AND o_orderdate < TIMESTAMP_NTZ '2000-01-01'")
    return rows.groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))


@query("a15_stage_histories", f"WITH {RUNS} SELECT name, list(value ORDER BY step) AS values FROM runs JOIN metrics USING (run_uuid) WHERE key = 'loss' GROUP BY name")
def stage_histories(spark, sf):
    return met.histories(*metrics(spark, sf), "loss")


@query("a16_metric_curves", f"WITH {RUNS}, c AS (SELECT run_uuid, key, value, ntile(12) OVER (PARTITION BY run_uuid, key ORDER BY step) AS chunk FROM metrics), m AS (SELECT run_uuid, key, chunk, count(*) AS n, count_if(value IS NULL) AS bad, quantile_cont(value, 0.5) AS m FROM c GROUP BY ALL) SELECT run_uuid, key, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, round(max(CASE WHEN chunk = 1 THEN m END), 4) AS first, round(arg_max_null(m, chunk), 4) AS last FROM m GROUP BY ALL")
def metric_curves(spark, sf):
    rows = met.curves(metrics(spark, sf)[1], ["run_uuid", "key"])
    return tidy(rows.select("run_uuid", "key", "n", "bad", F.element_at("medians", 1).alias("first"), F.element_at("medians", -1).alias("last")))


@query("a17_latest_metric", f"WITH {RUNS} SELECT run_uuid, round(arg_max_null(value, step), 4) AS value FROM metrics WHERE key = 'lr' GROUP BY run_uuid")
def latest_metric(spark, sf):
    return tidy(met.latest(metrics(spark, sf)[1].where("key = 'lr'"), ["run_uuid"]))


@query("a18_daily_speed", f"WITH {DAILY} SELECT day, count(*) AS cells, round(max(sqrt(a.value*a.value + b.value*b.value)), 6) AS fastest FROM daily a JOIN daily b USING (day, cell) WHERE a.feature = 'view' AND b.feature = 'click' GROUP BY day")
def daily_speed(spark, sf):
    rows = daily(spark, sf).where("feature IN ('view', 'click')").groupBy("day", "cell").pivot("feature", ["view", "click"]).agg(F.first("value")).where("view IS NOT NULL AND click IS NOT NULL")
    return tidy(rows.groupBy("day").agg(F.count("*").alias("cells"), F.max(F.hypot("view", "click")).alias("fastest")), 6)


@query("a19_functional_series", f"WITH {DAILY} SELECT day, feature, round(sum(value*(1 + cell % 7)), 4) AS total, round(avg(value), 6) AS mean FROM daily GROUP BY ALL")
def functional_series(spark, sf):
    """Functionals of every day of the record in one pass."""
    return tidy(daily(spark, sf).groupBy("day", "feature").agg(F.sum(F.col("value") * (1 + F.col("cell") % 7)).alias("total"), F.avg("value").alias("mean")), 6, total=4)


@query("a20_truth_series", f"WITH {DAILY} SELECT day, count_if(value > 5) AS high, count_if(value < 1) AS low FROM daily WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY day")
def truth_series(spark, sf):
    return daily(spark, sf).where("day BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'").groupBy("day").agg(F.count_if(F.col("value") > 5).alias("high"), F.count_if(F.col("value") < 1).alias("low"))


@query("a21_always_valid", f"WITH {DAILY} SELECT cell, bool_and(value > 0.2) AS ocean, count(*) AS days FROM daily WHERE feature = 'view' GROUP BY cell")
def always_valid(spark, sf):
    """Cells valid on all their days."""
    return daily(spark, sf).where("feature = 'view'").groupBy("cell").agg(F.bool_and(F.col("value") > 0.2).alias("ocean"), F.count("*").alias("days"))


# Sinks: each writes to a shared folder and returns what can be read back.


@query("b01_resumed_build", f"WITH {DAILY} SELECT feature, count(*) AS n, round(sum(value), 6) AS total FROM daily GROUP BY feature")
def resumed_build(spark, sf):
    """A build stopped after ten days and run again: the same rows, each once."""
    rows, plan = daily(spark, sf), {"table": "events", "train_end": "2024-01-20"}
    pack = packs.Pack(spark, shared(spark))
    pack.build(rows, plan, spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-10')) AS day"))
    pack.build(rows, plan).build(rows, plan)
    return tidy(pack.rows().groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 6)


@query("b02_prepared_rows", f"WITH {DAILY}, l AS (SELECT cell, feature, day, value, 0.75*lag(value, 2) OVER w + 0.25*lag(value, 1) OVER w AS forcing, row_number() OVER w AS n FROM daily WINDOW w AS (PARTITION BY cell, feature ORDER BY day)) SELECT feature, count(*) AS n, round(avg(value), 6) AS mean, round(avg(coalesce(forcing, 0)), 6) AS forcing FROM l WHERE n > 2 GROUP BY feature")
def prepared(spark, sf):
    """The first two rows of each chain dropped, forcing from lagged increments."""
    from ..operators.series import weighted_lags

    rows = daily(spark, sf).withColumns({"forcing": weighted_lags("value", {2: 0.75, 1: 0.25}, ["cell", "feature"], "day"), "n": F.row_number().over(Window.partitionBy("cell", "feature").orderBy("day"))}).where("n > 2")
    return tidy(rows.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg(F.coalesce("forcing", F.lit(0.0))).alias("forcing")), 6)


@query("b04_stacked_members", f"WITH {DAILY}, s AS (SELECT 'base' AS member, * FROM daily UNION ALL SELECT 'free', day, cell, feature, value*0.9 FROM daily), c AS (SELECT *, CASE WHEN datediff('day', lag(day) OVER w, day) = 1 THEN value - lag(value) OVER w END AS change FROM s WINDOW w AS (PARTITION BY member, cell, feature ORDER BY day)) SELECT feature, count(*) AS n, round(avg(value), 6) AS mean, count(change) AS n_diff, round(stddev_pop(change), 6) AS scale FROM c GROUP BY feature")
def stacked(spark, sf):
    """Two members in one pack, statistics pooled anew; changes never cross members."""
    from ..operators.moments import with_change

    base = daily(spark, sf)
    rows = packs.stacked({"base": base, "free": base.withColumn("value", F.col("value") * 0.9)}, ["day", "cell", "feature"])
    rows = with_change(rows, ["member", "cell", "feature"], "day", "value")
    return tidy(rows.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.count("change").alias("n_diff"), F.stddev_pop("change").alias("scale")), 6)


@query("b03_packed_rows", f"WITH {DAILY} SELECT cell, count(*) AS n, round(sum(value), 6) AS total FROM daily WHERE feature = 'view' GROUP BY cell")
def packed_rows(spark, sf):
    """A copy committed whole: its files appear when the write succeeds."""
    folder = shared(spark)
    daily(spark, sf).where("feature = 'view'").repartition("day").write.partitionBy("day").parquet(folder)
    return tidy(spark.read.parquet(folder).groupBy("cell").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 6)


@query("b05_finished_pack", f"WITH {DAILY}, s AS (SELECT feature, count(*) AS n, avg(value) AS mean, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS std FROM daily WHERE day <= DATE '2024-01-20' GROUP BY feature) SELECT feature, n, round(mean, 6) AS mean, round(std, 6) AS std FROM s")
def finished_pack(spark, sf):
    """A pack with its plan, rows and, written last, its training statistics."""
    pack = packs.Pack(spark, shared(spark)).build(daily(spark, sf), {"table": "events"}).finish(["cell", "feature"], "2024-01-20")
    return tidy(pack.statistics().select("feature", "n", "mean", "std"), 6)


@query("b08_overlaid_features", f"WITH {DAILY}, d AS (SELECT day, cell, avg(value) AS base FROM daily WHERE feature = 'view' GROUP BY ALL), m AS (SELECT day, cell, avg(value) - 273.15 AS more FROM daily WHERE feature = 'error' GROUP BY ALL) SELECT day, cell, round(base, 6) AS base, round(more, 6) AS more FROM d JOIN m USING (day, cell)")
def overlaid(spark, sf):
    """Base features beside new ones, Kelvin made Celsius."""
    rows = daily(spark, sf)
    base, more = (rows.where(F.col("feature") == f).select("day", "cell", F.col("value").alias(n)) for f, n in (("view", "base"), ("error", "more")))
    return tidy(packs.overlaid(base, more.withColumn("more", F.col("more") - 273.15), ["day", "cell"]), 6)


@query("b09_appended_blocks", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS block, count(*) AS n, round(avg(value)*1.00031729137, 6) AS mean FROM events GROUP BY ALL")
def appended_blocks(spark, sf):
    """Six-hour means appended month half by month half."""
    folder = shared(spark)
    for some in ("ts < TIMESTAMP_NTZ '2024-01-16'", "ts >= TIMESTAMP_NTZ '2024-01-16'"):
        rows = table(spark, sf, "events").where(some).groupBy(F.window("ts", "6 hours")["start"].cast("timestamp_ntz").alias("block")).agg(F.count("*").alias("n"), (F.avg("value") * 1.00031729137).alias("mean"))
        rows.write.mode("append").parquet(folder)
    return tidy(spark.read.parquet(folder), 6)


@query("b10_rollout_parts", f"WITH {SAMPLES} SELECT start, lead, round(sum(pred), 4) AS pred FROM samples GROUP BY ALL")
def rollout_parts(spark, sf):
    """Parts appended in two batches of starts, the even ones first, and again: starts that are there are skipped."""
    rows = samples(spark, sf).groupBy("start", "lead").agg(F.sum("pred").alias("pred"))
    starts, folder = rows.select("start").distinct(), shared(spark)
    for some in (starts.where("start % 2 = 0"), starts, starts):
        out = packs.append_parts(spark, folder, rows, some, 7, "abc")
    return tidy(out.select("start", "lead", "pred"))


@query("b11_valid_days", "SELECT l_orderkey AS start, l_linenumber AS lead, CAST(o_orderdate AS DATE) + l_linenumber AS valid, o_orderdate < TIMESTAMP '1999-01-01' AS in_sample, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL")
def valid_days(spark, sf):
    """(start, lead) rows with their valid day and whether the start was trained on."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    rows = lined(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), orders)
    return rows.groupBy(F.col("l_orderkey").alias("start"), F.col("l_linenumber").alias("lead"), F.date_add("o_orderdate", F.col("l_linenumber")).alias("valid"), (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).alias("in_sample")).agg(F.count("*").alias("n"))


@query("b12_chosen_fields", f"WITH {SAMPLES} SELECT start, lead, round(sum(pred), 4) AS model, round(sum(truth), 4) AS truth, round(sum(x0), 4) AS initial FROM samples WHERE field = 'A' GROUP BY ALL")
def chosen_fields(spark, sf):
    return tidy(samples(spark, sf).where("field = 'A'").groupBy("start", "lead").agg(F.sum("pred").alias("model"), F.sum("truth").alias("truth"), F.sum("x0").alias("initial")))


@query("b13_markdown_rows", f"WITH {SAMPLES} SELECT '| ' || field || ' | ' || count(*) || ' |  |' AS line FROM samples GROUP BY field")
def markdown_rows(spark, sf):
    """A table's lines, NaN blank."""
    rows = samples(spark, sf).groupBy("field").agg(F.count("*").alias("n"), F.lit(float("nan")).alias("score"))
    return reports.markdown(rows)


@query("b14_report_leads", f"WITH {SAMPLES} SELECT lead, '| ' || lead || ' | ' || count(*) || ' | ' || count_if(pred > 50000) || ' |' AS line FROM samples WHERE lead IN (1, 4, 7) GROUP BY lead")
def report_leads(spark, sf):
    """A report's lines at the chosen leads."""
    rows = samples(spark, sf).where("lead IN (1, 4, 7)").groupBy("lead").agg(F.count("*").alias("n"), F.count_if(F.col("pred") > 50000).alias("high"))
    return rows.select("lead", reports.line(["lead", "n", "high"]).alias("line"))


@query("s01_figure_tables", f"WITH {SAMPLES} SELECT field, CAST(floor(pred/10000) AS INT) AS bin, count(*) AS n, round(avg(truth), 4) AS truth FROM samples GROUP BY ALL")
def figure_tables(spark, sf):
    """The table behind a figure; nothing is drawn."""
    return tidy(samples(spark, sf).groupBy("field", F.floor(F.col("pred") / 10000).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("truth").alias("truth")))


@query("b15_grid_roundtrip", f"WITH {IMAGE} SELECT count(*) AS cells, count(v) AS ocean, round(sum(v), 4) AS total FROM image")
def grid_roundtrip(spark, sf):
    """A static grid written and read again."""
    folder = shared(spark)
    image(spark, sf).write.parquet(folder)
    return tidy(spark.read.parquet(folder).agg(F.count("*").alias("cells"), F.count("v").alias("ocean"), F.sum("v").alias("total")))
