"""Projections, filters and predicates; strings, arrays and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics as phys
from .registry import query
from .scores import tidy
from .tables import DAILY, FIELDS, SAMPLES, daily, fields, samples, table


@query("c01_valid_values", "SELECT count(*) AS n, count(v) AS valid, round(avg(v), 6) AS mean FROM (SELECT CASE WHEN event_id % 7 <> 0 THEN CAST(value AS FLOAT) END AS v FROM events)")
def valid_values(spark, sf):
    """Fills and NaN become null, the rest single precision."""
    raw = F.when(F.col("event_id") % 14 == 0, F.lit(1.267651e30)).when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = table(spark, sf, "events").select(phys.valid(raw).cast("float").cast("double").alias("v"))
    return tidy(rows.agg(F.count("*").alias("n"), F.count("v").alias("valid"), F.avg("v").alias("mean")), 6)


@query("c02_level_validity", "SELECT l_orderkey AS col, l_linenumber AS level, bool_and(l_discount > 0.005 AND l_tax < 0.075) AS real FROM lineitem GROUP BY ALL")
def level_validity(spark, sf):
    """A level is real if all its variables are."""
    ok = (F.col("l_discount") > 0.005) & (F.col("l_tax") < 0.075)
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("col"), F.col("l_linenumber").alias("level")).agg(F.bool_and(ok).alias("real"))


@query("c03_cells_of_fields", f"WITH {FIELDS} SELECT id, CAST(i - 1 AS INT) AS grid_index, CAST((i - 1) // 8 AS INT) AS x, CAST((i - 1) % 8 AS INT) AS y, round(v[i], 8) AS value FROM fields, range(1, 65) t(i)")
def cells_of_fields(spark, sf):
    """Arrays to cells, the index running along y within x."""
    rows = fields(spark, sf).select("id", F.posexplode("v").alias("grid_index", "value"))
    return tidy(rows.select("id", "grid_index", F.expr("CAST(grid_index div 8 AS INT)").alias("x"), (F.col("grid_index") % 8).alias("y"), "value"), 8)


@query("c04_derived_fields", "SELECT l_orderkey AS key, l_linenumber AS k, round(l_discount + l_tax, 6) AS u, round(l_extendedprice/9.806, 4) AS ssh, round(sqrt(l_discount*l_discount + l_tax*l_tax), 6) AS speed FROM lineitem")
def derived(spark, sf):
    """Total velocity, surface height from its flux, speed as a channel of its own."""
    return tidy(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("k"), (F.col("l_discount") + F.col("l_tax")).alias("u"), (F.col("l_extendedprice") / 9.806).alias("ssh"), F.sqrt(F.col("l_discount") ** 2 + F.col("l_tax") ** 2).alias("speed")), 6, ssh=4)


@query("c05_point_weights", f"WITH {SAMPLES} SELECT r_name AS region, round(sum(CASE WHEN s_acctbal > 0 THEN cos(radians(n_nationkey*3.0 - 36)) ELSE 0 END), 6) AS weight, count_if(s_acctbal > 0) AS points FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def point_weights(spark, sf):
    """Area of the region's real points; the small region tables are broadcast where Spark finds them small."""
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    real = F.col("s_acctbal") > 0
    return tidy(rows.groupBy(F.col("r_name").alias("region")).agg(F.sum(F.when(real, F.cos(F.radians(F.col("n_nationkey") * 3.0 - 36))).otherwise(0.0)).alias("weight"), F.count_if(real).alias("points")), 6)


@query("c06_in_period", "WITH s AS (SELECT o_orderkey AS key, min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT key FROM s WHERE first - 2 >= DATE '1996-01-01' AND last <= DATE '2000-12-31'")
def in_period(spark, sf):
    """Samples whose two initial days and targets all lie in a period."""
    day = F.to_date("l_shipdate")
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderkey").alias("key")).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return rows.where((F.date_sub("first", 2) >= F.lit("1996-01-01").cast("date")) & (F.col("last") <= F.lit("2000-12-31").cast("date"))).select("key")


@query("c08_channel_names", "SELECT p_name AS name, split_part(p_name, ' ', 1) AS var, CAST(regexp_extract(p_name || '_' || p_size || 'm', '_([0-9]+)m$', 1) AS INT) AS depth, count(*) AS n FROM part GROUP BY ALL")
def channel_names(spark, sf):
    """Names of variable and depth taken apart."""
    name = F.concat(F.col("p_name"), F.lit("_"), F.col("p_size").cast("string"), F.lit("m"))
    rows = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("var"), F.regexp_extract(name, "_([0-9]+)m$", 1).cast("int").alias("depth"))
    return rows.groupBy("name", "var", "depth").agg(F.count("*").alias("n"))


@query("c09_virtual_channel", f"WITH {SAMPLES} SELECT field, lead, round(max(sqrt(pred*pred + x0*x0)), 4) AS fastest FROM samples GROUP BY ALL")
def virtual_channel(spark, sf):
    return tidy(samples(spark, sf).groupBy("field", "lead").agg(F.max(F.hypot("pred", "x0")).alias("fastest")))


@query("c11_background_guard", "SELECT o_custkey AS cycle, count_if(o_orderstatus = 'F') > 0 AND count_if(o_orderstatus = 'P') > 0 AS whole FROM orders GROUP BY ALL")
def background_guard(spark, sf):
    """Cycles that have both partial means."""
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cycle")).agg(((F.count_if(F.col("o_orderstatus") == "F") > 0) & (F.count_if(F.col("o_orderstatus") == "P") > 0)).alias("whole"))


@query("c12_renamed", "SELECT o_orderkey AS cycle, o_totalprice AS thknss, o_orderstatus AS source FROM orders")
def renamed(spark, sf):
    names = {"o_orderkey": "cycle", "o_totalprice": "thknss", "o_orderstatus": "source"}
    return table(spark, sf, "orders").select(*names).withColumnsRenamed(names)


@query("c13_nest_band", "SELECT c_custkey AS cell, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE c_acctbal/4e9 END > 1/864000.0 AS band FROM customer")
def nest_band(spark, sf):
    """Cells relaxed faster than in ten days; fills count as 0."""
    rate = F.when(F.col("c_custkey") % 11 == 0, F.lit(1.267651e30)).otherwise(F.col("c_acctbal") / 4e9)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"), phys.band_mask(rate).alias("band"))


@query("c14_layer_columns", "SELECT split_part(p_name, ' ', 1) AS var, list_sort(list(DISTINCT split_part(p_name, ' ', 1) || '_k' || lpad(CAST(p_size AS VARCHAR), 2, '0'))) AS names FROM part GROUP BY ALL")
def layer_columns(spark, sf):
    """The columns of a layered variable by name."""
    name = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("_k"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    return table(spark, sf, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("var")).agg(F.array_sort(F.collect_set(name)).alias("names"))


@query("i11_stamps", "WITH s AS (SELECT o_orderkey AS key, strftime(o_orderdate, '%Y_%j_18') AS stamp FROM orders) SELECT key, CAST(CAST(substr(stamp, 1, 4) || '-01-01' AS DATE) + CAST(substr(stamp, 6, 3) AS INT) - 1 AS DATE) AS day, CAST(substr(stamp, 10) AS INT) AS hour FROM s")
def stamps(spark, sf):
    """Days of the year in file names back to dates."""
    stamp = F.concat(F.date_format("o_orderdate", "yyyy_DDD"), F.lit("_18"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), stamp.alias("stamp"))
    return rows.select("key", F.to_date(F.substring("stamp", 1, 8), "yyyy_DDD").alias("day"), F.substring_index("stamp", "_", -1).cast("int").alias("hour"))


@query("i12_json_report", f"WITH {DAILY}, s AS (SELECT feature, count(*) AS n, count(DISTINCT cell) AS cells FROM daily GROUP BY feature) SELECT feature, '{{\"cells\":' || cells || ',\"n\":' || n || '}}' AS report FROM s")
def json_report(spark, sf):
    """Scores as JSON."""
    rows = daily(spark, sf).groupBy("feature").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("cells"))
    return rows.select("feature", F.to_json(F.struct("cells", "n")).alias("report"))


@query("i12_array_functions", f"WITH {FIELDS} SELECT id, round(list_sum(list_transform(list_zip(v, list_reverse(v)), lambda p: p[1]*p[2])), 8) AS mirrored, round(list_max(v) - list_min(v), 8) AS span FROM fields")
def arrays(spark, sf):
    both = F.zip_with("v", F.reverse("v"), lambda a, b: a * b)
    return tidy(fields(spark, sf).select("id", F.aggregate(both, F.lit(0.0), lambda a, b: a + b).alias("mirrored"), (F.array_max("v") - F.array_min("v")).alias("span")), 8)


@query("i13_fingerprints", "SELECT p_partkey AS key, sha256('{\"brand\":\"' || p_brand || '\",\"size\":\"' || p_size || '\"}') AS structural, sha256('{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\",\"size\":\"' || p_size || '\"}') AS strict, md5(p_name) AS file FROM part")
def fingerprints(spark, sf):
    """Digests of JSON with sorted keys, of the structure alone and of all, and of a file's content."""
    size = F.col("p_size").cast("string").alias("size")
    brand, name = F.col("p_brand").alias("brand"), F.col("p_name").alias("name")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.sha2(F.to_json(F.struct(brand, size)), 256).alias("structural"), F.sha2(F.to_json(F.struct(brand, name, size)), 256).alias("strict"), F.md5("p_name").alias("file"))


@query("r02_carried_rate", "SELECT n_nationkey AS stage, round(CAST(least(0.001, greatest(0.0001, 2*(n_nationkey + 1)*0.00005)) AS DOUBLE), 8) AS rate FROM nation")
def carried_rate(spark, sf):
    """The next stage's starting rate: twice the last, within bounds."""
    return tidy(table(spark, sf, "nation").select(F.col("n_nationkey").alias("stage"), F.least(F.lit(0.001), F.greatest(F.lit(0.0001), 2 * (F.col("n_nationkey") + 1) * 0.00005)).alias("rate")), 8)
