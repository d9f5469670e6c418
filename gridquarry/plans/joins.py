"""Joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as ops
from .registry import query
from .scores import tidy
from .tables import DAILY, daily, table

#: role: (product, offset in days). Two roles may share a product.
ROLES = {"start": ("F", -1), "applied": ("P", -1), "mean": ("O", 0), "end": ("F", 0), "observed": ("O", 1)}
FILES = "files AS (SELECT o_orderstatus AS product, CAST(o_orderdate AS DATE) AS day, min('/archive/' || o_orderstatus || '/' || o_orderkey) AS path FROM orders GROUP BY ALL), spine AS (SELECT DISTINCT day FROM files)"
CYCLES = FILES + ", roles AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{p}', {o})" for r, (p, o) in ROLES.items()) + ") t(role, product, shift)), cycles AS (SELECT s.day, role, path FROM spine s CROSS JOIN roles r LEFT JOIN files f ON f.product = r.product AND f.day = s.day + r.shift)"


def cycles(spark, sf):
    files = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("product"), F.to_date("o_orderdate").alias("day")).agg(F.min(F.concat(F.lit("/archive/"), "o_orderstatus", F.lit("/"), F.col("o_orderkey").cast("string"))).alias("path"))
    return ops.at_offsets(files.select("day").distinct(), files, ROLES, "day")


@query("d01_cycles", f"WITH {CYCLES} SELECT day, role, path FROM cycles")
def cycle_roles(spark, sf):
    """Each day's file of each role, found by product and time offset."""
    return cycles(spark, sf)


@query("d02_missing_roles", f"WITH {CYCLES} SELECT role, count(*) AS missing, min(day) AS first FROM cycles WHERE path IS NULL GROUP BY role")
def missing(spark, sf):
    return cycles(spark, sf).where("path IS NULL").groupBy("role").agg(F.count("*").alias("missing"), F.min("day").alias("first"))


@query("d04_day_of_blocks", """WITH b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS block, event_type AS feature, avg(value) AS v FROM events GROUP BY ALL), t AS (SELECT DISTINCT date_trunc('day', block) + INTERVAL 18 HOUR AS t FROM b)
    SELECT t AS t, feature, count(*) AS blocks, round(CASE WHEN count(*) = 4 THEN avg(v) END, 6) AS mean FROM t, (VALUES (24), (18), (12), (6)) o(h), b WHERE b.block = t - h * INTERVAL 1 HOUR GROUP BY t, feature""")
def day_of_blocks(spark, sf):
    """The mean of the four blocks before a time; null unless all are there."""
    blocks = table(spark, sf, "events").groupBy(F.window("ts", "6 hours")["start"].cast("timestamp_ntz").alias("block"), F.col("event_type").alias("feature")).agg(F.avg("value").alias("v"))
    times = blocks.select((F.date_trunc("day", "block").cast("timestamp_ntz") + F.expr("INTERVAL 18 HOURS")).alias("t")).distinct()
    want = times.withColumn("h", F.explode(F.array(*map(F.lit, (24, 18, 12, 6))))).select("t", F.expr("t - make_interval(0, 0, 0, 0, h)").cast("timestamp_ntz").alias("block"))
    return tidy(want.join(blocks, "block").groupBy("t", "feature").agg(F.count("*").alias("blocks"), F.when(F.count("*") == 4, F.avg("v")).alias("mean")), 6)


@query("d05_store_check", """WITH j AS (SELECT l_linenumber AS k, l_extendedprice/l_quantity AS hx, 900 + (l_partkey % 1000)/10.0 AS grid, l_discount < 0.08 AS unclipped, l_quantity >= 2 AS massive FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT k, count(*) AS n, round(max(abs(hx - grid)), 4) AS most, count_if(abs(hx - grid) > 1) AS beyond FROM j WHERE unclipped AND massive GROUP BY k""")
def store_check(spark, sf):
    """Observations against the grid at their cell: the largest difference where neither clipped nor massless."""
    grid = table(spark, sf, "part").select("p_partkey", (900 + (F.col("p_partkey") % 1000) / 10.0).alias("grid"))
    obs = table(spark, sf, "lineitem").where("l_discount < 0.08 AND l_quantity >= 2").select(F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("p_partkey"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("hx"))
    d = F.abs(F.col("hx") - F.col("grid"))
    return tidy(obs.join(grid, "p_partkey").groupBy("k").agg(F.count("*").alias("n"), F.max(d).alias("most"), F.count_if(d > 1).alias("beyond")))


AXIS = [0, 10, 25, 50, 100, 200, 500]


@query("d07_nearest_level", f"WITH a AS (SELECT i - 1 AS i, ([{', '.join(map(str, AXIS))}])[i] AS z FROM range(1, 8) t(i)) SELECT p_partkey AS key, CAST(arg_min(i, struct_pack(d := abs(p_size*5.0 - z), i := i)) AS INT) AS level FROM part, a GROUP BY p_partkey")
def nearest_level(spark, sf):
    """The nearest entry of a fixed axis, ties to the first."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") * 5.0).alias("z"))
    return ops.nearest_on_axis(rows, "z", AXIS, "level").select("key", "level")


@query("d06_nearest_line", "SELECT c_nationkey AS block, arg_min(c_custkey, struct_pack(d := abs(c_acctbal - 2500), k := c_custkey)) AS line, round(min(abs(c_acctbal - 2500)), 4) AS off FROM customer GROUP BY ALL")
def nearest_line(spark, sf):
    """The grid line nearest to a coordinate."""
    d = F.abs(F.col("c_acctbal") - 2500)
    return tidy(table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("block")).agg(F.min_by("c_custkey", F.struct(d, F.col("c_custkey"))).alias("line"), F.min(d).alias("off")))


@query("d09_start_set", """WITH r AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem), i AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS s, count(*) OVER () AS n FROM r), want AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
    SELECT w.day, i.day IS NULL AS missing, CASE WHEN i.day IS NOT NULL THEN least(60, n - 2 - s) END AS horizon FROM want w LEFT JOIN i ON i.day = w.day""")
def start_set(spark, sf):
    """Requested starts against the record's days: which are missing, and how far each can run."""
    from pyspark.sql.window import Window as W

    record = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    # places by year, then within it: no window over the whole record
    years = record.groupBy(F.year("day").alias("y")).agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    before = years.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("one").orderBy("y").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(W.partitionBy("one")))
    at = record.withColumn("y", F.year("day")).withColumn("r", F.row_number().over(W.partitionBy("y").orderBy("day"))).join(before, "y")
    at = at.select("day", (F.col("before") + F.col("r") - 1).alias("s"), "all")
    want = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return want.join(at, "day", "left").select("day", F.col("s").isNull().alias("missing"), F.when(F.col("s").isNotNull(), F.least(F.lit(60).cast("long"), F.col("all") - 2 - F.col("s"))).alias("horizon"))


@query("d10_lagged_pairs", f"WITH {DAILY} SELECT a.cell, a.feature, a.day, round(b.value - a.value, 6) AS change FROM daily a JOIN daily b ON b.cell = a.cell AND b.feature = a.feature AND b.day = a.day + 7 WHERE b.day <= DATE '2024-01-25'")
def lagged_pairs(spark, sf):
    """Pairs a fixed lead apart within a split."""
    a = daily(spark, sf)
    b = a.select("cell", "feature", F.date_sub("day", 7).alias("day"), F.col("value").alias("later")).where("day <= DATE '2024-01-18'")
    return tidy(a.join(b, ["cell", "feature", "day"]).select("cell", "feature", "day", (F.col("later") - F.col("value")).alias("change")), 6)


@query("d12_schedule", "WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'P') SELECT CAST(year(day) AS INT) AS y, count(*) AS days FROM (SELECT day FROM a INTERSECT SELECT day FROM b) GROUP BY ALL")
def schedule(spark, sf):
    """Days on which both kinds of file exist."""
    day = table(spark, sf, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("day"))
    both = day.where("o_orderstatus IN ('F', 'P')").groupBy("day").agg(F.count_distinct("o_orderstatus").alias("kinds")).where("kinds = 2")
    return both.groupBy(F.year("day").alias("y")).agg(F.count("*").alias("days"))


@query("d13_as_of", """WITH e AS (SELECT user_id, ts, event_id AS epoch FROM events WHERE event_type = 'signup'), t AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
    SELECT t.event_id, t.user_id, e.epoch FROM t ASOF LEFT JOIN e ON t.user_id = e.user_id AND t.ts >= e.ts""")
def as_of(spark, sf):
    """The latest epoch that began by each time."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    left = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = events.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("epoch"))
    return ops.as_of(left, right, ["user_id"], "ts", "epoch", "epoch").select("event_id", "user_id", "epoch")


@query("d13_as_of_blocks", """WITH e AS (SELECT event_type, ts, event_id AS epoch FROM events WHERE user_id % 2 = 0 OR user_id IS NULL), t AS (SELECT event_type, ts, event_id FROM events WHERE user_id % 2 <> 0)
    SELECT t.event_id, t.event_type, e.epoch FROM t ASOF LEFT JOIN e ON t.event_type = e.event_type AND t.ts >= e.ts""")
def as_of_blocks(spark, sf):
    """The same for groups too large for one task, by day and carried from day to day: all events of odd users against all others."""
    events = table(spark, sf, "events").select("event_type", "ts", "event_id", "user_id")
    left = events.where("user_id % 2 <> 0").select("event_type", "ts", "event_id")
    right = events.where("user_id % 2 = 0 OR user_id IS NULL").select("event_type", "ts", F.col("event_id").alias("epoch"))
    return ops.as_of(left, right, ["event_type"], "ts", "epoch", "epoch", F.to_date("ts")).select("event_id", "event_type", "epoch")


@query("d14_climatology", "WITH c AS (SELECT month(o_orderdate) AS m, avg(o_totalprice) AS mean FROM orders WHERE year(o_orderdate) < 1999 GROUP BY ALL) SELECT o_orderkey AS key, round(o_totalprice - mean, 4) AS anomaly FROM orders JOIN c ON m = month(o_orderdate) WHERE year(o_orderdate) >= 1999")
def climatology(spark, sf):
    """Anomalies from the training years' mean of the month."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.month("o_orderdate").alias("m"), F.year("o_orderdate").alias("y"))
    means = rows.where("y < 1999").groupBy("m").agg(F.avg("o_totalprice").alias("mean"))
    return tidy(rows.where("y >= 1999").join(F.broadcast(means), "m").select(F.col("o_orderkey").alias("key"), (F.col("o_totalprice") - F.col("mean")).alias("anomaly")))  # 12 rows


@query("d15_member_forcing", "SELECT o_orderkey % 5 AS member, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL")
def member_forcing(spark, sf):
    """Samples dealt to members in turn."""
    return tidy(table(spark, sf, "orders").groupBy(F.pmod("o_orderkey", F.lit(5)).alias("member")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")))


@query("d16_ranked_samples", "SELECT c_custkey AS key, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quarter FROM customer")
def ranked(spark, sf):
    w = Window.partitionBy("c_nationkey")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.dense_rank().over(w.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("r"), F.ntile(4).over(w.orderBy("c_acctbal", "c_custkey")).cast("long").alias("quarter"))
