"""Aggregations, quantiles, selections and set operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import moments as mom
from ..operators import scores as sco
from ..operators.selection import at_rank, placed, quantiles
from ..shared import cut, spread
from .registry import query
from .scores import tidy
from .tables import CELLS, DAILY, FIELDS, IMAGE, SAMPLES, TRUTH, cells, daily, fields, image, samples, table


@query("e01_mass_weighted_mean", """WITH p AS (SELECT l_partkey % 200 AS cell, l_linenumber AS k, sum(l_quantity*l_discount*1.00031729137::DOUBLE) AS w, sum(l_quantity*l_discount*1.00031729137::DOUBLE*l_extendedprice*0.99983172619::DOUBLE) AS wx, sum(l_quantity) AS n FROM lineitem GROUP BY ALL),
    m AS (SELECT cell, k, w/n AS mean_w, wx/CASE WHEN w > 0 THEN w ELSE 1 END AS x FROM p) SELECT cell, k, round(mean_w, 6) AS thickness, round(last_value(CASE WHEN mean_w >= 0.03 THEN x END IGNORE NULLS) OVER (PARTITION BY cell ORDER BY k ROWS UNBOUNDED PRECEDING), 4) AS x FROM m""")
def mass_weighted_mean(spark, sf):
    """Mean of partial means by mass; layers of no mass copy the one above, after averaging."""
    from ..operators.series import from_above

    w = F.col("l_quantity") * F.col("l_discount") * 1.00031729137
    rows = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 200).alias("cell"), F.col("l_linenumber").alias("k")).agg(F.sum(w).alias("w"), F.sum(w * F.col("l_extendedprice") * 0.99983172619).alias("wx"), F.sum("l_quantity").alias("n"))
    rows = rows.select("cell", "k", (F.col("w") / F.col("n")).alias("thickness"), (F.col("wx") / mom.safe(F.col("w"))).alias("x"))
    return tidy(rows.select("cell", "k", F.round("thickness", 6).alias("thickness"), from_above(F.col("x"), F.col("thickness") < 0.03, ["cell"], "k").alias("x")), thickness=6)


@query("e02_block_means", f"SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS block, event_type AS feature, count(*) AS n, round(avg(value)*{TRUTH}, 6) AS mean, round(avg(abs(value - 5))*{TRUTH}, 6) AS mean_abs FROM events GROUP BY ALL")
def block_means(spark, sf):
    """Six-hour means."""
    rows = table(spark, sf, "events").groupBy(F.window("ts", "6 hours").alias("w"), F.col("event_type").alias("feature")).agg(F.count("*").alias("n"), (F.avg("value") * TRUTH).alias("mean"), (F.avg(F.abs(F.col("value") - 5)) * TRUTH).alias("mean_abs"))
    return tidy(rows.select(F.col("w.start").cast("timestamp_ntz").alias("block"), "feature", "n", "mean", "mean_abs"), 6)


@query("e03_daily_weighted_mean", """WITH h AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, avg(value) AS x FROM events GROUP BY ALL), w AS (SELECT *, CASE WHEN hour = 12 THEN 1.84 ELSE 1.0 END AS w FROM h)
    SELECT day, count(*) AS hours, round(CASE WHEN count(*) = 24 AND count(DISTINCT hour) = 24 THEN sum(w*x)/sum(w) END, 6) AS mean FROM w GROUP BY day""")
def daily_weighted_mean(spark, sf):
    """The mean of a day's hours, noon weighing more; null unless all 24 are there."""
    hours = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.avg("value").alias("x"))
    w = F.when(F.col("hour") == 12, 1.84).otherwise(1.0)
    whole = (F.count("*") == 24) & (F.count_distinct("hour") == 24)
    return tidy(hours.groupBy("day").agg(F.count("*").alias("hours"), F.when(whole, F.sum(w * F.col("x")) / F.sum(w)).alias("mean")), 6)


@query("e04_moments", f"WITH {SAMPLES} SELECT field, lead, count(*) AS n, round(avg(truth), 4) AS mean, round(CASE WHEN stddev_pop(truth) > 0 THEN stddev_pop(truth) ELSE 1 END, 4) AS std FROM samples GROUP BY ALL")
def moments(spark, sf):
    return tidy(mom.moments(samples(spark, sf), ["field", "lead"], "truth"))


CHANGED = DAILY + """, c AS (SELECT *, CASE WHEN datediff('day', lag(day) OVER w, day) = 1 THEN value - lag(value) OVER w END AS change FROM daily WINDOW w AS (PARTITION BY cell, feature ORDER BY day)),
    s AS (SELECT feature, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS raw, count(change) AS n_diff, avg(change) AS diff_mean, stddev_pop(change) AS raw_diff FROM c WHERE {where} GROUP BY feature)
    SELECT feature, n, round(mean, 6) AS mean, round(CASE WHEN raw > 0 THEN raw ELSE 1 END, 6) AS std, n_diff, round(diff_mean, 6) AS diff_mean, round(CASE WHEN greatest(coalesce(raw_diff, 0), 0.05*raw) > 0 THEN greatest(coalesce(raw_diff, 0), 0.05*raw) ELSE 1 END, 6) AS diff_std FROM s"""


@query("e05_train_statistics", "WITH " + CHANGED.format(where="true"))
def train_statistics(spark, sf):
    return tidy(mom.train_statistics(daily(spark, sf), ["feature"], ["cell", "feature"], "day", "value"), 6)


@query("e06_masked_statistics", "WITH " + CHANGED.replace("datediff('day', lag(day) OVER w, day) = 1", "datediff('day', lag(day) OVER w, day) = 1 AND value > 2 AND lag(value) OVER w > 2").format(where="value > 2"))
def masked_statistics(spark, sf):
    """The same over the rows in use; a skipped one breaks the chain."""
    return tidy(mom.train_statistics(daily(spark, sf), ["feature"], ["cell", "feature"], "day", "value", F.col("value") > 2), 6)


LEVELS = "levels AS (SELECT l_returnflag AS var, l_linenumber AS level, stddev_pop(l_discount)*CASE WHEN l_linenumber > 5 THEN 0.01 ELSE 1 END AS std FROM lineitem GROUP BY l_returnflag, l_linenumber)"


@query("e07_floored_std", f"WITH {LEVELS}, f AS (SELECT *, greatest(0.001, 0.1*quantile_cont(std, 0.5) OVER (PARTITION BY var)) AS floor FROM levels) SELECT var, level, round(floor, 8) AS floor, round(greatest(std, floor), 8) AS floored, greatest(std, floor) > std AS raised FROM f")
def floored_std(spark, sf):
    """Standard deviations not below a physical minimum nor a share of the column's median."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("var"), "l_linenumber").agg(F.stddev_pop("l_discount").alias("s"))
    rows = rows.select("var", F.col("l_linenumber").alias("level"), (F.col("s") * F.when(F.col("l_linenumber") > 5, 0.01).otherwise(1.0)).alias("std"))
    return tidy(mom.floored_std(rows, "var", "std", F.lit(0.001)).select("var", "level", "floor", "floored", "raised"), 8)


@query("e14_wind_check", """WITH d AS (SELECT CASE WHEN day(l_shipdate) <= 15 THEN 'a' ELSE 'b' END AS win, year(l_shipdate) >= 1999 AS era, l_extendedprice AS truth, l_extendedprice*(1-l_discount) AS v FROM lineitem)
    SELECT win, era, count(*) AS n, round(corr(truth, v), 6) AS corr, round(sqrt(avg(pow(v-truth, 2)))/stddev_pop(truth), 6) AS rms_over_std, round(avg(v-truth), 4) AS bias, corr(truth, v) >= 0.97 AND sqrt(avg(pow(v-truth, 2)))/stddev_pop(truth) <= 0.15 AS passed FROM d GROUP BY ALL""")
def wind_check(spark, sf):
    """Correlation, rms over the truth's std and bias per window and era, and whether they pass."""
    rows = table(spark, sf, "lineitem").select(F.when(F.dayofmonth("l_shipdate") <= 15, "a").otherwise("b").alias("win"), (F.year("l_shipdate") >= 1999).alias("era"), F.col("l_extendedprice").alias("truth"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    e = F.col("v") - F.col("truth")
    share = F.sqrt(F.avg(e * e)) / F.stddev_pop("truth")
    out = rows.groupBy("win", "era").agg(F.count("*").alias("n"), F.corr("truth", "v").alias("corr"), share.alias("rms_over_std"), F.avg(e).alias("bias"), ((F.corr("truth", "v") >= 0.97) & (share <= 0.15)).alias("passed"))
    return tidy(out, 6, bias=4)


@query("e14_best_window", """WITH d AS (SELECT CASE WHEN day(l_shipdate) <= 15 THEN 'a' ELSE 'b' END AS win, year(l_shipdate) AS y, corr(l_extendedprice, l_extendedprice*(1-l_discount)) AS c FROM lineitem GROUP BY ALL), m AS (SELECT win, avg(c) AS c FROM d GROUP BY win) SELECT max_by(win, c) AS win, round(max(c), 6) AS corr FROM m""")
def best_window(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.when(F.dayofmonth("l_shipdate") <= 15, "a").otherwise("b").alias("win"), F.year("l_shipdate").alias("y")).agg(F.corr("l_extendedprice", F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("c"))
    return tidy(rows.groupBy("win").agg(F.avg("c").alias("c")).agg(F.max_by("win", "c").alias("win"), F.max("c").alias("corr")), 6)


@query("e15_seam_check", """WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS y, avg(o_totalprice) AS m FROM orders GROUP BY ALL), s AS (SELECT y, m, m - lag(m) OVER (ORDER BY y) AS step FROM y)
    SELECT CAST(y AS INT) AS y, round(m, 4) AS mean, round(step, 4) AS step, abs(step) > 2*(SELECT stddev_samp(step) FROM s WHERE y <> 1998) AS jumps FROM s""")
def seam_check(spark, sf):
    """Annual means, their steps, and whether a step exceeds twice the sample std of the steps off the seam."""
    years = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("m"), F.lit(1).alias("one"))
    rows = years.withColumn("step", F.col("m") - F.lag("m").over(Window.partitionBy("one").orderBy("y")))  # one row a year
    spread = F.stddev_samp(F.when(F.col("y") != 1998, F.col("step"))).over(Window.partitionBy("one"))
    return tidy(rows.select("y", F.col("m").alias("mean"), "step", (F.abs("step") > 2 * spread).alias("jumps")))


@query("e15_monthly_climatology", "SELECT CAST(month(o_orderdate) AS INT) AS month, round(avg(CASE WHEN year(o_orderdate) < 1999 THEN o_totalprice END), 4) AS train, round(avg(CASE WHEN year(o_orderdate) = 2000 THEN o_totalprice END), 4) AS year2000 FROM orders GROUP BY ALL")
def monthly_climatology(spark, sf):
    y, v = F.year("o_orderdate"), F.col("o_totalprice")
    return tidy(table(spark, sf, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.avg(F.when(y < 1999, v)).alias("train"), F.avg(F.when(y == 2000, v)).alias("year2000")))


@query("e16_regrid", f"WITH {IMAGE} SELECT y//4 AS cy, x//4 AS cx, count(*) AS total, count(v) AS inside, round(avg(v), 6) AS mean FROM image GROUP BY ALL HAVING count(v) > 0 AND 2*count(v) >= count(*)")
def regrid(spark, sf):
    """Coarse cells: the mean of the fine ones in the region, kept if they are half or more."""
    rows = image(spark, sf).groupBy(F.expr("y div 4").alias("cy"), F.expr("x div 4").alias("cx")).agg(F.count("*").alias("total"), F.count("v").alias("inside"), F.avg("v").alias("mean"))
    return tidy(rows.where("inside > 0 AND 2 * inside >= total"), 6)


@query("e17_largest_anomaly", """WITH m AS (SELECT l_returnflag AS f, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std FROM lineitem WHERE l_orderkey % 10 = 0 GROUP BY ALL)
    SELECT f AS feature, round(max(abs(l_extendedprice - mean)/std), 6) AS z, max_by(l_orderkey, struct_pack(a := abs(l_extendedprice - mean), b := -l_orderkey, c := -l_linenumber)) AS key FROM lineitem JOIN m ON f = l_returnflag WHERE l_orderkey % 10 = 0 GROUP BY f""")
def largest_anomaly(spark, sf):
    """Per feature the largest distance from the mean in stds, and where it is, over every tenth day."""
    rows = table(spark, sf, "lineitem").where("l_orderkey % 10 = 0").select(F.col("l_returnflag").alias("feature"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"))
    stats = rows.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    d = F.abs(F.col("x") - F.col("mean"))
    out = rows.join(stats, "feature").groupBy("feature").agg(F.max(d / F.col("std")).alias("z"), F.max_by("l_orderkey", F.struct(d, -F.col("l_orderkey"), -F.col("l_linenumber"))).alias("key"))
    return tidy(out, 6)


@query("e22_median_over_starts", f"WITH {SAMPLES}, r AS (SELECT lead, start, sqrt(sum(w*pow(pred-truth,2))/sum(w)) AS e FROM samples GROUP BY ALL) SELECT lead, round(quantile_cont(e, 0.5), 4) AS median, round(avg(e), 4) AS mean FROM r GROUP BY lead")
def median_over_starts(spark, sf):
    e = F.col("pred") - F.col("truth")
    rows = samples(spark, sf).groupBy("lead", "start").agg(F.sqrt(F.sum(F.col("w") * e * e) / F.sum("w")).alias("e"))
    return tidy(quantiles(rows, ["lead"], {"median": (F.col("e"), 0.5)}).join(rows.groupBy("lead").agg(F.avg("e").alias("mean")), "lead"))


@query("e23_quantile_bands", f"WITH {SAMPLES}, r AS (SELECT lead, start, CASE WHEN count(*) > 0 THEN sum(pred)/sum(truth) END AS r FROM samples GROUP BY ALL) SELECT lead, round(quantile_cont(r, 0.1), 6) AS q10, round(quantile_cont(r, 0.5), 6) AS q50, round(quantile_cont(r, 0.9), 6) AS q90 FROM r GROUP BY lead")
def quantile_bands(spark, sf):
    rows = samples(spark, sf).groupBy("lead", "start").agg((F.sum("pred") / F.sum("truth")).alias("r"))
    return tidy(quantiles(rows, ["lead"], {n: (F.col("r"), f) for n, f in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))}), 6)


@query("e24_grouping_sets", "SELECT l_returnflag AS variable, l_linenumber AS level, grouping_id(l_returnflag, l_linenumber) AS grouping, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_returnflag), (l_linenumber), ())")
def grouping_sets(spark, sf):
    rows = samples(spark, sf).cube("field", "lead").agg(F.grouping_id().alias("grouping"), F.count("*").alias("n"), F.sum("w").alias("total"))
    return tidy(rows.select(F.col("field").alias("variable"), F.col("lead").alias("level"), "grouping", "n", "total"))


@query("e26_band_slope", f"WITH {CELLS}, s AS (SELECT label, sum(h*h) AS ff, sum(g*g) AS yy, sum(h*g) AS fy FROM (SELECT *, coalesce(lag(h) OVER (PARTITION BY id ORDER BY y, x), h) AS g FROM cells) GROUP BY label) SELECT label, round(fy/ff, 6) AS slope, round(yy/ff, 6) AS ratio, round(fy/sqrt(ff*yy), 6) AS corr FROM s")
def band_slope(spark, sf):
    """Pooled slope, variance ratio and correlation from sums of products; the slope is the correlation over the root of the inverse ratio."""
    w = Window.partitionBy("id").orderBy("y", "x")
    rows = cells(spark, sf).withColumn("g", F.coalesce(F.lag("h").over(w), "h"))
    h, g = F.col("h"), F.col("g")
    s = rows.groupBy("label").agg(F.sum(h * h).alias("ff"), F.sum(g * g).alias("yy"), F.sum(h * g).alias("fy"))
    return tidy(s.select("label", (F.col("fy") / F.col("ff")).alias("slope"), (F.col("yy") / F.col("ff")).alias("ratio"), (F.col("fy") / F.sqrt(F.col("ff") * F.col("yy"))).alias("corr")), 6)


#: Cumulative probabilities of a Poisson count of mean 1.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


@query("e27_bootstrap_slope", f"""WITH {SAMPLES}, r AS (SELECT field, start, sum(pred*pred) AS ff, sum(pred*truth) AS fy FROM samples GROUP BY ALL),
    e AS (SELECT *, CAST('0x' || substr(md5(start || ':' || draw), 1, 8) AS BIGINT)/4294967296.0 AS u FROM r, range(1, 201) d(draw)),
    s AS (SELECT field, draw, sum(n*fy)/sum(n*ff) AS slope FROM (SELECT *, {" + ".join(f"CASE WHEN u >= {p!r} THEN 1 ELSE 0 END" for p in POISSON)} AS n FROM e) GROUP BY ALL)
    SELECT field, round(quantile_cont(slope, 0.05), 6) AS low, round(quantile_cont(slope, 0.95), 6) AS high FROM s GROUP BY field""")
def bootstrap_slope(spark, sf):
    """Quantiles of the pooled slope over resampled starts: each start counts a hashed, Poisson-distributed number of times in each draw, so no draw gathers the rows."""
    rows = spread(samples(spark, sf).select("field", "start", "pred", "truth"), "start").groupBy("field", "start").agg(F.sum(F.col("pred") * F.col("pred")).alias("ff"), F.sum(F.col("pred") * F.col("truth")).alias("fy"))
    drawn = sco.poisson_sums(rows, "field", "start", ["ff", "fy"], 200, POISSON)
    s = drawn.select("field", (F.col("fy") / F.col("ff")).alias("slope"))
    q = s.groupBy("field").agg(F.expr("percentile(slope, array(0.05, 0.95))").alias("q"))
    return tidy(q.select("field", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")), 6)


@query("e27_resampled_slope")
def resampled_slope(spark, sf):
    """Quantiles of the pooled slope over 1,000 draws of as many starts as there are, with repetition: counts are exactly multinomial."""
    rows = samples(spark, sf).groupBy("field", "start").agg(F.sum(F.col("pred") * F.col("pred")).alias("ff"), F.sum(F.col("pred") * F.col("truth")).alias("fy"), F.lit(1.0).alias("n"))
    drawn = cut(sco.bootstrap_sums(rows, "field", "start", ["ff", "fy", "n"], 1000, 5))
    slope = F.col("fy") / F.col("ff")
    q = quantiles(drawn, ["field"], {"low": (slope, 0.05), "median": (slope, 0.5), "high": (slope, 0.95)})
    return tidy(drawn.groupBy("field").agg(F.count("*").alias("draws"), F.min("n").alias("least"), F.max("n").alias("most")).join(q, "field"), 6)


@query("e28_ensemble_limit", "WITH m AS (SELECT l_linenumber AS m, avg(pow(l_discount - 0.05, 2)) AS mse FROM lineitem GROUP BY l_linenumber) SELECT round(regr_intercept(mse, 1.0/m), 8) AS bound, round(regr_slope(mse, 1.0/m), 8) AS slope FROM m")
def ensemble_limit(spark, sf):
    """The error of an endless ensemble: the intercept of the mean square error against 1 / M."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("m")).agg(F.avg((F.col("l_discount") - 0.05) ** 2).alias("mse"))
    return tidy(rows.agg(F.regr_intercept("mse", 1.0 / F.col("m")).alias("bound"), F.regr_slope("mse", 1.0 / F.col("m")).alias("slope")), 8)


@query("e30_two_regressors", """WITH c AS (SELECT l_returnflag AS f, avg(l_extendedprice) AS my, avg(l_quantity) AS ma, avg(l_tax) AS mb, covar_pop(l_extendedprice, l_quantity) AS ya, covar_pop(l_extendedprice, l_tax) AS yb, var_pop(l_quantity) AS aa, var_pop(l_tax) AS bb, covar_pop(l_quantity, l_tax) AS ab FROM lineitem GROUP BY ALL)
    SELECT f AS field, round((ya*bb - yb*ab)/(aa*bb - ab*ab), 4) AS slope_a, round((yb*aa - ya*ab)/(aa*bb - ab*ab), 3) AS slope_b FROM c""")
def two_regressors(spark, sf):
    """Least squares on two regressors, by the normal equations."""
    a, b, y = F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice")
    c = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("field")).agg(F.covar_pop(y, a).alias("ya"), F.covar_pop(y, b).alias("yb"), F.var_pop(a).alias("aa"), F.var_pop(b).alias("bb"), F.covar_pop(a, b).alias("ab"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return tidy(c.select("field", ((F.col("ya") * F.col("bb") - F.col("yb") * F.col("ab")) / det).alias("slope_a"), ((F.col("yb") * F.col("aa") - F.col("ya") * F.col("ab")) / det).alias("slope_b")), slope_b=3)


@query("e30_distance_bands", f"WITH {SAMPLES} SELECT least(CAST(floor(w/10) AS INT) + 1, 5) AS band, count(*) AS n, round(avg(pred - truth), 4) AS mean, round(avg(CASE WHEN pred > truth THEN 1.0 ELSE 0 END), 6) AS positive FROM samples GROUP BY ALL")
def distance_bands(spark, sf):
    band = F.least(F.width_bucket("w", F.lit(0.0), F.lit(50.0), F.lit(5)).cast("int"), F.lit(5))
    e = F.col("pred") - F.col("truth")
    return tidy(samples(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(e).alias("mean"), F.avg((e > 0).cast("double")).alias("positive")), positive=6)


@query("e34_product_summary", """SELECT o_orderstatus AS product, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY ALL""")
def product_summary(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("product")).agg(F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last"), F.count_distinct(day).alias("days"))


@query("e35_mask_overlap", "SELECT round(count_if(p_size > 20 AND p_retailprice > 1200)/count_if(p_size > 20 OR p_retailprice > 1200), 8) AS jaccard FROM part")
def mask_overlap(spark, sf):
    """The Jaccard index of two masks, joined cell by cell."""
    part = table(spark, sf, "part")
    a = part.select("p_partkey", (F.col("p_size") > 20).alias("a"))
    b = part.select("p_partkey", (F.col("p_retailprice") > 1200).alias("b"))
    return tidy(a.join(b, "p_partkey", "full").agg((F.count_if(F.col("a") & F.col("b")) / F.count_if(F.col("a") | F.col("b"))).alias("jaccard")), 8)


@query("e36_pack_profile", f"WITH {DAILY} SELECT feature, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, bool_and(value IS NOT NULL AND NOT isnan(value)) AS finite FROM daily GROUP BY feature")
def pack_profile(spark, sf):
    v = F.col("value")
    return tidy(daily(spark, sf).groupBy("feature").agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.bool_and(v.isNotNull() & ~F.isnan(v)).alias("finite")), 6)


@query("e19_census", f"WITH {CELLS} SELECT label, count(h) AS n, round(quantile_cont(h, 0.5), 8) AS median, round(quantile_cont(h, 0.9), 8) AS p90, round(sum(h), 6) AS total FROM cells WHERE h >= 0.1 GROUP BY label")
def census(spark, sf):
    """Count, median, 90th percentile and sum of what reaches a floor."""
    rows = cells(spark, sf).where("h >= 0.1")
    q = quantiles(rows, ["label"], {"median": (F.col("h"), 0.5), "p90": (F.col("h"), 0.9)})
    return tidy(rows.groupBy("label").agg(F.count("h").alias("n"), F.sum("h").alias("total")).join(q, "label"), 8, total=6)


@query("e20_front_medians", f"WITH {SAMPLES}, f AS (SELECT lead, start, max(CASE WHEN pred > 60000 THEN pred END) AS p, max(CASE WHEN truth > 60000 THEN truth END) AS t FROM samples GROUP BY ALL), s AS (SELECT lead, CASE WHEN p IS NULL AND t IS NULL THEN 'both_empty' WHEN p IS NULL THEN 'pred_empty' WHEN t IS NULL THEN 'true_empty' ELSE 'ok' END AS status, abs(p - t) AS d FROM f) SELECT lead, round(quantile_cont(CASE WHEN status = 'ok' THEN d END, 0.5), 4) AS median, count_if(status = 'ok') AS ok, count_if(status = 'pred_empty') AS pred_empty, count_if(status <> 'ok' AND status <> 'pred_empty') AS other FROM s GROUP BY lead")
def front_medians(spark, sf):
    """Medians over the samples whose status is ok, and the counts by status."""
    rows = samples(spark, sf).groupBy("lead", "start").agg(F.max(F.when(F.col("pred") > 60000, F.col("pred"))).alias("p"), F.max(F.when(F.col("truth") > 60000, F.col("truth"))).alias("t"))
    p, t = F.col("p").isNull(), F.col("t").isNull()
    rows = rows.select("lead", F.when(p & t, "both_empty").when(p, "pred_empty").when(t, "true_empty").otherwise("ok").alias("status"), F.abs(F.col("p") - F.col("t")).alias("d"))
    ok = F.col("status") == "ok"
    counts = rows.groupBy("lead").agg(F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "pred_empty").alias("pred_empty"), F.count_if(~ok & (F.col("status") != "pred_empty")).alias("other"))
    return tidy(quantiles(rows, ["lead"], {"median": (F.when(ok, F.col("d")), 0.5)}).join(counts, "lead"))


# Selections


@query("g01_best_median_worst", f"""WITH {SAMPLES}, s AS (SELECT start, sqrt(avg(pow(pred-truth, 2)))/sqrt(avg(pow(x0-truth, 2))) AS skill FROM samples GROUP BY start HAVING avg(pow(x0-truth, 2)) > 0), r AS (SELECT *, row_number() OVER (ORDER BY skill, start) AS r, count(*) OVER () AS n FROM s)
    SELECT CASE r WHEN 1 THEN 'best' WHEN n THEN 'worst' ELSE 'median' END AS which, start, round(skill, 6) AS skill FROM r WHERE r IN (1, n//2 + 1, n)""")
def best_median_worst(spark, sf):
    """The samples ranked first, in the middle and last by skill."""
    e, p = F.col("pred") - F.col("truth"), F.col("x0") - F.col("truth")
    rows = spread(samples(spark, sf).select("start", "truth", "pred", "x0"), "start")
    s = cut(rows.groupBy("start").agg(F.sqrt(F.avg(e * e)).alias("e"), F.sqrt(F.avg(p * p)).alias("p")).where("p > 0").select("start", (F.col("e") / F.col("p")).alias("skill")))  # read by each pass
    n = s.count()
    if not n:
        return s.select(F.lit("").alias("which"), "start", "skill")
    middle = at_rank(s, "skill", "start", n // 2)
    ends = s.orderBy("skill", "start").limit(1), s.orderBy(F.desc("skill"), F.desc("start")).limit(1)
    rows = [x.select(F.lit(k).alias("which"), "start", "skill") for k, x in (("best", ends[0]), ("median", middle), ("worst", ends[1]))]
    return tidy(rows[0].union(rows[1]).union(rows[2]), 6)


@query("g03_limited_starts", "SELECT o_orderkey AS start, CAST(o_orderdate AS DATE) AS day, least(60, datediff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') - 2) AS horizon FROM orders ORDER BY 3 DESC, 2, 1 LIMIT 40")
def limited_starts(spark, sf):
    """The starts with the longest horizons, then the earliest: a top-k."""
    day = F.to_date("o_orderdate")
    horizon = F.least(F.lit(60), F.datediff(F.lit("2001-08-01"), day) - 2).cast("long")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("start"), day.alias("day"), horizon.alias("horizon")).orderBy(F.desc("horizon"), "day", "start").limit(40)


@query("g04_strided_sample", """WITH r AS (SELECT c_mktsegment AS seg, c_custkey AS key, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
    SELECT DISTINCT seg, key FROM r, range(0, 5) t(k) WHERE i = CAST(floor(k*(n - 1)/4.0) AS BIGINT)""")
def strided_sample(spark, sf):
    """Five rows of each segment, evenly spread, both ends included."""
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("key"))
    rows = placed(rows, ["seg"], ["key"], "i").join(rows.groupBy("seg").agg(F.count("*").alias("n")), "seg")
    picks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.floor(k * (F.col("n") - 1) / 4.0))
    return rows.where(F.array_contains(picks, F.col("i").cast("long"))).select("seg", "key")


@query("g05_limits", f"WITH {SAMPLES} SELECT field, round(quantile_cont(abs(pred - truth), 0.99), 4) AS symmetric, round(quantile_cont(pred - truth, 0.01), 4) AS low, round(quantile_cont(pred - truth, 0.99), 4) AS high FROM samples GROUP BY field")
def limits(spark, sf):
    rows = samples(spark, sf).withColumn("e", F.col("pred") - F.col("truth"))
    e = F.col("e")
    return tidy(quantiles(rows, ["field"], {"symmetric": (F.abs(e), 0.99), "low": (e, 0.01), "high": (e, 0.99)}))


@query("g06_exact_quantiles", "SELECT event_type AS feature, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY ALL")
def exact_quantiles(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("feature"), "value")
    return tidy(quantiles(rows, ["feature"], {n: (F.col("value"), f) for n, f in (("q05", 0.05), ("q25", 0.25), ("q75", 0.75), ("q95", 0.95))}), 6)


@query("g07_argmax_mode", """WITH m AS (SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS k FROM customer GROUP BY ALL), a AS (SELECT c_nationkey AS n, arg_max(c_custkey, struct_pack(a := c_acctbal, b := -c_custkey)) AS richest FROM customer GROUP BY ALL)
    SELECT n, any_value(richest) AS richest, arg_min(s, struct_pack(a := -k, b := s)) AS mode FROM m JOIN a USING (n) GROUP BY n""")
def argmax_mode(spark, sf):
    """Argmax with the first index winning ties, and the most frequent label with the smallest winning."""
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey", "c_mktsegment", "c_acctbal")
    best = rows.groupBy("n").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("richest"))
    mode = rows.groupBy("n", "c_mktsegment").count().groupBy("n").agg(F.min_by("c_mktsegment", F.struct(-F.col("count"), F.col("c_mktsegment"))).alias("mode"))
    return best.join(mode, "n")


@query("g09_lowest_score", "SELECT p_brand AS run, arg_min(p_name || '/' || p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS path, round(min(p_retailprice), 4) AS score FROM part WHERE p_retailprice IS NOT NULL GROUP BY ALL")
def lowest_score(spark, sf):
    """The candidate with the least stored score; those without one are skipped."""
    rows = table(spark, sf, "part").where("p_retailprice IS NOT NULL")
    return tidy(rows.groupBy(F.col("p_brand").alias("run")).agg(F.min_by(F.concat_ws("/", "p_name", F.col("p_partkey").cast("string")), F.struct("p_retailprice", "p_partkey")).alias("path"), F.min("p_retailprice").alias("score")))


# Sets


@query("h01_union", "SELECT status, count(*) AS n, count(lead) AS with_lead FROM (SELECT o_orderstatus AS status, NULL AS lead FROM orders UNION ALL SELECT l_linestatus, l_linenumber FROM lineitem) GROUP BY status")
def union(spark, sf):
    """Parts stacked, a column that one lacks becoming null."""
    a = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"))
    b = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("lead"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("status").agg(F.count("*").alias("n"), F.count("lead").alias("with_lead"))


KINDS = "a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_quantity > 25)"


def kinds(spark, sf):
    return table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")), table(spark, sf, "lineitem").where("l_quantity > 25").select(F.to_date("l_shipdate").alias("day"))


@query("h02_intersect", f"WITH {KINDS} SELECT day FROM a INTERSECT SELECT day FROM b")
def intersect(spark, sf):
    a, b = kinds(spark, sf)
    return a.intersect(b)


@query("h03_except", f"WITH {KINDS} SELECT day FROM a EXCEPT SELECT day FROM b")
def still_to_do(spark, sf):
    """What is wanted and not done."""
    a, b = kinds(spark, sf)
    return a.join(b, "day", "left_anti").distinct()


@query("h04_equal_sets", f"WITH {KINDS}, d AS ((SELECT day FROM a EXCEPT SELECT day FROM b) UNION ALL (SELECT day FROM b EXCEPT SELECT day FROM a)) SELECT count(*) = 0 AS equal, count(*) AS differing FROM d")
def equal_sets(spark, sf):
    """Whether two sets of coordinates are equal, and how many differ."""
    a, b = (x.distinct() for x in kinds(spark, sf))
    return a.exceptAll(b).union(b.exceptAll(a)).agg((F.count("*") == 0).alias("equal"), F.count("*").alias("differing"))


# Fixed point


STATS = "s AS (SELECT event_type AS feature, avg(value) AS mean, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS std FROM events WHERE event_id % 3 = 0 GROUP BY ALL)"


@query("b06_quantized", f"WITH {STATS}, q AS (SELECT feature, CAST(least(greatest(round_even((value - mean)/std*2000, 0), -32000), 32000) AS SMALLINT) AS q FROM events JOIN s ON feature = event_type) SELECT feature, count(*) AS n, sum(CAST(q AS BIGINT))::BIGINT AS total, count_if(abs(q) >= 32000) AS clipped FROM q GROUP BY feature")
def quantized(spark, sf):
    """Values as 16-bit counts per standard deviation."""
    rows, stats = statistics(spark, sf)
    q = rows.join(stats, "feature").select("feature", mom.quantized(F.col("value"), F.col("mean"), F.col("std")).alias("q"))
    return q.groupBy("feature").agg(F.count("*").alias("n"), F.sum("q").alias("total"), mom.at_clip(F.col("q")).alias("clipped"))


@query("a11_fixed_point_read", f"WITH {STATS}, q AS (SELECT feature, value, CAST(least(greatest(round_even((value - mean)/std*2000, 0), -32000), 32000) AS SMALLINT)*std/2000 + mean AS back FROM events JOIN s ON feature = event_type) SELECT feature, round(avg(back), 5) AS mean, count_if(abs(back - value) > 0.01) AS far FROM q GROUP BY feature")
def fixed_point(spark, sf):
    """16-bit values read back with the std that they were written with."""
    rows, stats = statistics(spark, sf)
    q = rows.join(stats, "feature").withColumn("q", mom.quantized(F.col("value"), F.col("mean"), F.col("std")))
    back = mom.unquantized(F.col("q"), F.col("mean"), F.col("std"))
    return tidy(q.withColumn("back", back).groupBy("feature").agg(F.avg("back").alias("mean"), F.count_if(F.abs(F.col("back") - F.col("value")) > 0.01).alias("far")), 5)


def statistics(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("feature"), "event_id", "value")
    return rows, mom.moments(rows.where("event_id % 3 = 0"), ["feature"], "value").drop("n")


@query("b07_refloored", f"WITH {STATS} SELECT feature, round(greatest(std, 3.0), 6) AS std, round(std, 6) AS decode_std, std < 3.0 AS raised FROM s")
def refloored(spark, sf):
    """New statistics with floored stds, beside the std that stored counts are decoded with."""
    _, stats = statistics(spark, sf)
    return tidy(stats.select("feature", F.greatest("std", F.lit(3.0)).alias("std"), F.col("std").alias("decode_std"), (F.col("std") < 3.0).alias("raised")), 6)


@query("g02_noise_quantile", f"WITH {FIELDS} SELECT round(quantile_cont(abs(u), 0.95), 8) AS q95 FROM (SELECT unnest(v) AS u FROM fields)")
def noise_quantile(spark, sf):
    """A high quantile of pooled amplitudes."""
    return tidy(fields(spark, sf).select(F.explode("v").alias("u")).agg(F.expr("percentile(abs(u), 0.95)").alias("q95")), 8)


@query("g02_noise_floor")
def noise_floor(spark, sf):
    """What features of pure noise persist at most, but for a twentieth, on the ocean of an image: 200 fields of correlated noise."""
    from ..operators import topology as top

    size = image(spark, sf).agg(F.max("y")).first()[0] + 1
    ocean = np.zeros((size, 40), bool)
    for y, x in image(spark, sf).where("v IS NOT NULL").select("y", "x").collect():  # one image's mask, which each task holds
        ocean[y, x] = True
    return tidy(top.noise_floor(spark, ocean, (8.0, 8.0)), 8)


@query("g08_daily_maxima", f"WITH {DAILY}, r AS (SELECT day, feature, cell, value, row_number() OVER (PARTITION BY day, feature ORDER BY value DESC, cell) AS r FROM daily) SELECT day, feature, cell, round(value, 6) AS value, r AS rank FROM r WHERE r <= 3")
def daily_maxima(spark, sf):
    """The three largest of each day, in one table."""
    w = Window.partitionBy("day", "feature").orderBy(F.desc("value"), "cell")
    return tidy(daily(spark, sf).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("day", "feature", "cell", "value", "rank"), 6)
