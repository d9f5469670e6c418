"""Forecast scores."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import scores as ops
from ..operators.selection import quantiles
from ..shared import spread
from .registry import query
from .tables import DAILY, MEMBERS, SAMPLES, daily, members, samples, table

SUMS = SAMPLES + """, sums AS (SELECT field, lead, sum(w) w, sum(w*(pred-truth)) we, sum(w*(pred-truth)*(pred-truth)) we2, sum(w*(truth-x0)*(truth-x0)) wp2,
    sum(w*(truth-x0)) wa, sum(w*(pred-x0)) wb, sum(w*(truth-x0)*(truth-x0)) wa2, sum(w*(pred-x0)*(pred-x0)) wb2, sum(w*(truth-x0)*(pred-x0)) wab FROM samples GROUP BY ALL)"""
CORR = "(wab - wa*wb/w) / CASE WHEN (wa2 - wa*wa/w) * (wb2 - wb*wb/w) > 0 THEN sqrt((wa2 - wa*wa/w) * (wb2 - wb*wb/w)) END"
RESULT = f"round(sqrt(we2/w), 4) AS rmse, round(sqrt(wp2/w), 4) AS rmse_pers, round(we/w, 4) AS bias, round({CORR}, 6) AS corr_change"


def tidy(df, places=4, **other):
    """Doubles rounded at the edge."""
    return df.select(*(F.round(c, other.get(c, places)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("e08_lead_scores", f"WITH {SUMS} SELECT field, lead, {RESULT} FROM sums")
def lead_scores(spark, sf):
    by = ["field", "lead"]
    return tidy(ops.scored(ops.weighted_sums(samples(spark, sf), by), by), corr_change=6)


@query("e08_column_scores", f"""WITH {SUMS}, col AS (SELECT field, sum(w*(8-lead)) w, sum(we*(8-lead)) we, sum(we2*(8-lead)) we2, sum(wp2*(8-lead)) wp2, sum(wa*(8-lead)) wa,
    sum(wb*(8-lead)) wb, sum(wa2*(8-lead)) wa2, sum(wb2*(8-lead)) wb2, sum(wab*(8-lead)) wab FROM sums GROUP BY field) SELECT field, {RESULT} FROM col""")
def column_scores(spark, sf):
    """Levels (here leads) combined with their thickness, sum by sum."""
    sums = ops.weighted_sums(samples(spark, sf), ["field", "lead"]).withColumn("dz", 8 - F.col("lead"))
    return tidy(ops.scored(ops.combined(sums, ["field"], "dz"), ["field"]), corr_change=6)


@query("e09_pooled_scores", f"""WITH {SAMPLES}, s AS (SELECT field, greatest(w - 10, 0) AS w, truth, pred, x0 FROM samples),
    sums AS (SELECT field, sum(w) w, sum(w*(pred-truth)) we, sum(w*(pred-truth)*(pred-truth)) we2, sum(w*(truth-x0)*(truth-x0)) wp2, sum(w*(truth-x0)) wa, sum(w*(pred-x0)) wb,
    sum(w*(truth-x0)*(truth-x0)) wa2, sum(w*(pred-x0)*(pred-x0)) wb2, sum(w*(truth-x0)*(pred-x0)) wab FROM s GROUP BY ALL) SELECT field, {RESULT} FROM sums""")
def pooled_scores(spark, sf):
    """Weights from the truth's thickness, clipped at 0."""
    rows = samples(spark, sf).withColumn("w", F.greatest(F.col("w") - 10, F.lit(0.0)))
    return tidy(ops.scored(ops.weighted_sums(rows, ["field"]), ["field"]), corr_change=6)


@query("e21_step_scores", f"""WITH {SAMPLES}, s AS (SELECT start, lead, w, pred, truth, x0 FROM samples),
    m AS (SELECT start, lead, sum(w) w, sum(w*(pred-truth)*(pred-truth)) e2, sum(w*(pred-truth)) e, sum(w*pred) p, max(sqrt(pred*pred+truth*truth)) ms, sum(w*pred*pred)/2 ke FROM s GROUP BY ALL)
    SELECT start, lead, round(sqrt(e2/w), 4) AS rmse, round(e/w, 4) AS bias, round(p/w, 4) AS mean, round(ke/w, 2) AS ke, round(ms, 4) AS maxspeed FROM m""")
def step_scores(spark, sf):
    """Per start and lead: rmse, bias, mean, kinetic energy over area, largest speed."""
    w, e = F.col("w"), F.col("pred") - F.col("truth")
    rows = samples(spark, sf).groupBy("start", "lead").agg(
        F.sqrt(F.sum(w * e * e) / F.sum(w)).alias("rmse"), (F.sum(w * e) / F.sum(w)).alias("bias"), (F.sum(w * F.col("pred")) / F.sum(w)).alias("mean"),
        (F.sum(w * F.col("pred") * F.col("pred")) / 2 / F.sum(w)).alias("ke"), F.max(F.sqrt(F.col("pred") * F.col("pred") + F.col("truth") * F.col("truth"))).alias("maxspeed"),
    )
    return tidy(rows, ke=2)


@query("m03_persistence_loss", f"WITH {SAMPLES}, s AS (SELECT field, stddev_pop(truth) AS std FROM samples GROUP BY field) SELECT lead, round(sum(w*((x0-truth)/std)*((x0-truth)/std))/sum(w), 6) AS wmse FROM samples JOIN s USING (field) GROUP BY lead")
def persistence_loss(spark, sf):
    """Weighted squared error over the variance, of no change, per lead."""
    rows = samples(spark, sf)
    variance = rows.groupBy("field").agg(F.var_pop("truth").alias("variance"))
    e = F.col("x0") - F.col("truth")
    sums = rows.groupBy("field", "lead").agg(F.sum(F.col("w") * e * e).alias("we2"), F.sum("w").alias("w"))  # few rows: no sample meets its variance by a shuffle
    return tidy(sums.join(variance, "field").groupBy("lead").agg((F.sum(F.col("we2") / F.col("variance")) / F.sum("w")).alias("wmse")), 6)


CRPS = MEMBERS + """, sorted AS (SELECT key, grp, x, y, w, row_number() OVER (PARTITION BY key ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY key) AS m FROM members),
    crps AS (SELECT key, any_value(grp) AS grp, any_value(m) AS members, any_value(y) AS y, avg(x) AS mean, var_samp(x) AS variance, avg((x-y)*(x-y)) AS e2_member, sum(w) AS w, avg(abs(x-y)) AS away, sum((2*i-m+1)*x) AS pairs FROM sorted GROUP BY key)"""


@query("m02_fair_crps", f"WITH {CRPS} SELECT key, members, round(mean, 6) AS mean, round(away - CASE WHEN members > 1 THEN pairs/(members*(members-1)) ELSE 0 END, 6) AS crps FROM crps")
def crps(spark, sf):
    return tidy(ops.fair_crps(members(spark, sf), ["key"]).select("key", F.col("members").cast("long"), "mean", "crps"), 6)


@query("m02_almost_fair_crps", f"WITH {CRPS} SELECT key, round(away - CASE WHEN members > 1 THEN pairs/(members*(members-1)) * (1 - 0.05/members) ELSE 0 END, 6) AS crps FROM crps")
def almost_fair_crps(spark, sf):
    return tidy(ops.fair_crps(members(spark, sf), ["key"], alpha=0.95).select("key", "crps"), 6)


@query("e10_ensemble_scores", f"""WITH {CRPS} SELECT grp, round(sqrt(sum(w*(mean-y)*(mean-y))/sum(w)), 6) AS rmse, round(sqrt(sum(w*e2_member)/sum(w)), 6) AS rmse_member,
    round(sqrt(sum(w*variance*(members+1)/members)/sum(w)), 6) AS spread, round(sqrt(sum(w*variance*(members+1)/members)/sum(w*(mean-y)*(mean-y))), 6) AS spread_skill,
    round(sum(w*(away - pairs/(members*(members-1))))/sum(w), 6) AS crps FROM crps WHERE members > 1 GROUP BY grp""")
def ensemble_scores(spark, sf):
    scored = ops.fair_crps(members(spark, sf), ["grp", "key"], w="w").where("members > 1")
    return tidy(ops.spread_skill(scored, ["grp"]), 6)


@query("e31_spread_skill", f"WITH {CRPS} SELECT round(sqrt(avg(variance*(members+1)/members) / avg((mean-y)*(mean-y))), 6) AS ratio FROM crps WHERE members > 1")
def overall_spread_skill(spark, sf):
    rows = ops.fair_crps(members(spark, sf), ["key"]).where("members > 1")
    return tidy(rows.agg(F.sqrt(F.avg(F.col("variance") * (F.col("members") + 1) / F.col("members")) / F.avg((F.col("mean") - F.col("y")) ** 2)).alias("ratio")), 6)


#: erf(z) = exp(-z²) Σ z^(2n+1) / Γ(n + 3/2), whose terms are all of one sign.
ERF = "(sign({z}) * CASE WHEN abs({z}) > 6 THEN 1 WHEN {z} = 0 THEN 0 ELSE list_sum(list_transform(range(0, 200), lambda n: exp((2*n+1)*ln(abs({z})) - lgamma(n+1.5) - {z}*{z}))) END)"
GAUSS = f"""WITH {CRPS}, g AS (SELECT grp, w, mean, sqrt(variance) AS sigma, y, (y - mean)/sqrt(variance) AS z FROM crps WHERE members > 1 AND variance > 0),
    t AS (SELECT *, sigma*(z*{ERF.format(z="(z/sqrt(2.0))")} + 2*exp(-z*z/2)/sqrt(2*pi()) - 1/sqrt(pi())) AS c FROM g)"""


def gaussian(spark, sf):
    return ops.fair_crps(members(spark, sf), ["grp", "key"], w="w").where("members > 1 AND variance > 0").withColumn("sigma", F.sqrt("variance"))


@query("e11_gaussian_scores", GAUSS + """ SELECT grp, round(sqrt(sum(w*(mean-y)*(mean-y))/sum(w)), 5) AS rmse, round(sqrt(sum(w*sigma*sigma)/sum(w)), 5) AS sigma, round(sum(w*c)/sum(w), 5) AS crps,
    round(sum(CASE WHEN abs(mean-y) <= sigma THEN w ELSE 0 END)/sum(w), 6) AS within1, round(sum(CASE WHEN abs(mean-y) <= 2*sigma THEN w ELSE 0 END)/sum(w), 6) AS within2 FROM t GROUP BY grp""")
def gaussian_scores(spark, sf):
    w, mean, sigma, y = (F.col(c) for c in ("w", "mean", "sigma", "y"))
    rows = gaussian(spark, sf).withColumn("c", ops.gaussian_crps(mean, sigma, y))
    out = rows.groupBy("grp").agg(
        F.sqrt(F.sum(w * (mean - y) ** 2) / F.sum(w)).alias("rmse"), F.sqrt(F.sum(w * sigma * sigma) / F.sum(w)).alias("sigma"), (F.sum(w * F.col("c")) / F.sum(w)).alias("crps"),
        (F.sum(w * ops.covered(mean, sigma, y, 1)) / F.sum(w)).alias("within1"), (F.sum(w * ops.covered(mean, sigma, y, 2)) / F.sum(w)).alias("within2"),
    )
    return tidy(out, 5, within1=6, within2=6)


@query("e11_calibration", GAUSS + """, f AS (SELECT grp, CASE WHEN sum(w*sigma*sigma) > 0 THEN sqrt(sum(w*(mean-y)*(mean-y))/sum(w*sigma*sigma)) ELSE 1 END AS factor FROM t GROUP BY grp)
    SELECT grp, round(any_value(factor), 5) AS factor, round(sum(CASE WHEN abs(mean-y) <= sigma*factor THEN w ELSE 0 END)/sum(w), 6) AS within1 FROM t JOIN f USING (grp) GROUP BY grp""")
def calibrated(spark, sf):
    """The factor fitted per group, applied to the group's sigmas."""
    rows = gaussian(spark, sf)
    factor = ops.calibration(rows, ["grp"], "mean", "y", "variance", "w")
    inside = ops.covered(F.col("mean"), F.col("sigma") * F.col("factor"), F.col("y"), 1)
    out = rows.join(F.broadcast(factor), "grp").groupBy("grp").agg(F.first("factor").alias("factor"), (F.sum(F.col("w") * inside) / F.sum("w")).alias("within1"))
    return tidy(out, 5, within1=6)


@query("i06_gaussian_crps", GAUSS + " SELECT grp, count(*) AS n, round(avg(c), 5) AS crps FROM t GROUP BY grp")
def crps_function(spark, sf):
    rows = gaussian(spark, sf).withColumn("c", ops.gaussian_crps(F.col("mean"), F.col("sigma"), F.col("y")))
    return tidy(rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg("c").alias("crps")), 5)


@query("n04_crps_loss", GAUSS + " SELECT round(sum(c/w)/count(*), 6) AS loss FROM t")
def crps_loss(spark, sf):
    rows = gaussian(spark, sf).withColumn("c", ops.gaussian_crps(F.col("mean"), F.col("sigma"), F.col("y")))
    return tidy(rows.agg((F.sum(F.col("c") / F.col("w")) / F.count("*")).alias("loss")), 6)


QUANTITIES = f"({ops.RHO0} * {ops.CP} * dz / 1e9, 'heat'), ({ops.RHO0} * 1e-3 * dz, 'salt'), (dz, 'volume')"
TOTALS = f"""WITH {SAMPLES}, weights AS (SELECT lead AS level, CAST(lead AS DOUBLE) AS dz FROM range(1, 8) t(lead)),
    q AS (SELECT level, q.weight, q.quantity FROM weights, LATERAL (VALUES {QUANTITIES}) q(weight, quantity))"""


def quantity_weights(spark):
    """(lead, quantity, weight): what each level adds to the heat, the salt and the volume."""
    dz = F.col("lead").cast("double")
    rows = spark.range(1, 8).select(F.col("id").cast("int").alias("lead"))
    values = F.array(*(F.struct(F.lit(n).alias("quantity"), w.alias("weight")) for n, w in (("heat", ops.RHO0 * ops.CP * dz / 1e9), ("salt", ops.RHO0 * 1e-3 * dz), ("volume", dz))))
    return rows.select("lead", F.inline(values))


@query("e12_functionals", TOTALS + " SELECT field, quantity, round(sum(weight*truth)/1e6, 4) AS total FROM samples JOIN q ON lead = level GROUP BY ALL")
def functionals(spark, sf):
    rows = samples(spark, sf).select("field", "lead", F.col("truth").alias("x"))
    out = ops.functionals(rows, quantity_weights(spark), ["lead"], ["field"])
    return tidy(out.withColumn("total", F.col("total") / 1e6))


TOTAL = f"""WITH {SAMPLES}, t AS (SELECT start, lead, sum(truth) AS truth, sum(pred) AS pred, sum(x0) AS x0 FROM samples GROUP BY ALL)"""


@query("e13_conservation", TOTAL + """, s AS (SELECT lead, pred - truth AS e, truth - coalesce(lag(truth) OVER o, x0) AS ts, pred - coalesce(lag(pred) OVER o, x0) AS ps FROM t WINDOW o AS (PARTITION BY start ORDER BY lead))
    SELECT lead, round(avg(e), 3) AS error_mean, round(stddev_pop(e), 3) AS error_std, round(avg(CASE WHEN e > 0 THEN 1.0 ELSE 0 END), 6) AS positive, round(avg(ts), 3) AS truth_step, round(avg(ps), 3) AS model_step FROM s GROUP BY lead""")
def conservation(spark, sf):
    rows = samples(spark, sf).groupBy("start", "lead").agg(F.sum("truth").alias("truth"), F.sum("pred").alias("pred"), F.sum("x0").alias("x0"))
    return tidy(ops.conservation(rows, [], "start", "lead", "truth", "pred", "x0"), 3, positive=6)


@query("e13_offset_pattern", f"WITH {SAMPLES} SELECT field, lead, round(sqrt(sum(w*(pred-truth)*(pred-truth))/sum(w)), 4) AS rmse, round(pow(sum(w*(pred-truth))/sum(w), 2), 2) AS offset2, round(sum(w*(pred-truth)*(pred-truth))/sum(w) - pow(sum(w*(pred-truth))/sum(w), 2), 2) AS pattern2 FROM samples GROUP BY ALL")
def offset_pattern(spark, sf):
    return tidy(ops.offset_pattern(samples(spark, sf), ["field", "lead"], F.col("pred") - F.col("truth"), F.col("w")), 2, rmse=4)


@query("n03_mean_penalty", TOTAL + """, s AS (SELECT lead, stddev_pop(truth) AS s FROM t GROUP BY lead), b AS (SELECT field, stddev_pop(truth) AS std FROM samples GROUP BY field)
    SELECT round((SELECT sum(w*pow((pred-truth)/std, 2))/sum(w) FROM samples JOIN b USING (field)) + 0.1*(SELECT avg(pow((pred-truth)/s, 2)) FROM t JOIN s USING (lead)), 6) AS loss""")
def mean_penalty(spark, sf):
    """Weighted mean square error over the variance, plus a tenth of the squared error of domain totals in their scales."""
    rows = samples(spark, sf)
    e = F.col("pred") - F.col("truth")
    fields = rows.where("field IS NOT NULL").groupBy("field").agg((F.sum(F.col("w") * e * e) / F.var_pop("truth")).alias("z2"), F.sum("w").alias("w"))
    base = fields.agg(F.lit(1).alias("one"), (F.sum("z2") / F.sum("w")).alias("base"))
    totals = spread(rows.where("lead IS NOT NULL").select("start", "lead", "truth", "pred"), "start").groupBy("start", "lead").agg(F.sum("truth").alias("truth"), F.sum("pred").alias("pred"))
    leads = totals.groupBy("lead").agg((F.sum(e * e) / F.var_pop("truth")).alias("q2"), F.count(e).alias("n"))
    penalty = leads.agg(F.lit(1).alias("one"), (F.sum("q2") / F.sum("n")).alias("penalty"))
    return tidy(base.join(penalty, "one").select((F.col("base") + 0.1 * F.col("penalty")).alias("loss")), 6)


@query("n01_thickness_weighted_loss", f"""WITH {SAMPLES}, c AS (SELECT *, avg(w) OVER (PARTITION BY start) AS col FROM samples), s AS (SELECT field, stddev_pop(truth) AS std FROM samples GROUP BY field)
    SELECT field, round(avg(w/col * pow((pred-truth)/std, 2)), 6) AS loss FROM c JOIN s USING (field) GROUP BY field""")
def thickness_weighted(spark, sf):
    """Squared error over the variance, weighted by the layer's thickness over its column's mean."""
    from pyspark.sql import Window

    rows = spread(samples(spark, sf), "start").withColumn("col", F.avg("w").over(Window.partitionBy("start")))
    e = F.col("pred") - F.col("truth")
    return tidy(rows.where("field IS NOT NULL").groupBy("field").agg((F.avg(F.col("w") / F.col("col") * e * e) / F.var_pop("truth")).alias("loss")), 6)


@query("e33_verdict", f"WITH {SUMS}, r AS (SELECT sqrt(we2/w) AS rmse, sqrt(wp2/w) AS pers, {CORR} AS corr FROM sums) SELECT bool_and(coalesce(rmse < pers AND corr > 0, false)) AS passed, count(*) AS n, count_if(rmse < pers) AS better FROM r")
def verdict(spark, sf):
    rows = ops.scored(ops.weighted_sums(samples(spark, sf), ["field", "lead"]), ["field", "lead"])
    better = F.col("rmse") < F.col("rmse_pers")
    return rows.agg(F.bool_and(F.coalesce(better & (F.col("corr_change") > 0), F.lit(False))).alias("passed"), F.count("*").alias("n"), F.count_if(better).alias("better"))


@query("e32_compare_models", f"""WITH {SAMPLES}, m AS (SELECT field, lead, name, sqrt(sum(w*pow(p-truth, 2))/sum(w)) AS rmse FROM (SELECT field, lead, w, truth, pred, x0, (pred + x0)/2 AS mean FROM samples) UNPIVOT (p FOR name IN (pred, x0, mean)) GROUP BY ALL)
    SELECT field, lead, min_by(name, rmse) AS best, round(min(rmse), 4) AS rmse FROM m GROUP BY ALL""")
def compare_models(spark, sf):
    """Several predictors scored at once; the one with the least rmse per field and lead."""
    rows = samples(spark, sf).withColumn("mean", (F.col("pred") + F.col("x0")) / 2).unpivot(["field", "lead", "w", "truth"], ["pred", "x0", "mean"], "name", "p")
    e = F.col("p") - F.col("truth")
    scored = rows.groupBy("field", "lead", "name").agg(F.sqrt(F.sum(F.col("w") * e * e) / F.sum("w")).alias("rmse"))
    return tidy(scored.groupBy("field", "lead").agg(F.min_by("name", "rmse").alias("best"), F.min("rmse").alias("rmse")))


@query("e29_run_differences", f"WITH {SAMPLES} SELECT field, round(max(abs(pred - truth)), 6) AS most, round(max(abs(pred - truth)/greatest(abs(truth), 1e-12)), 6) AS relative FROM samples GROUP BY field")
def run_differences(spark, sf):
    d = F.abs(F.col("pred") - F.col("truth"))
    return tidy(samples(spark, sf).groupBy("field").agg(F.max(d).alias("most"), F.max(d / F.greatest(F.abs("truth"), F.lit(1e-12))).alias("relative")), 6)


@query("e18_mean_skipping_nan", f"WITH {SAMPLES} SELECT lead, round(avg(CASE WHEN w > 5 THEN pred END), 4) AS mean, round(min(CASE WHEN w > 5 THEN pred END), 4) AS least, count_if(w <= 5) AS missing FROM samples GROUP BY lead")
def mean_skipping_nan(spark, sf):
    """NaN becomes null before the mean."""
    v = F.when(F.col("w") > 5, F.col("pred")).otherwise(float("nan"))
    clean = F.when(~F.isnan(v), v)
    return tidy(samples(spark, sf).groupBy("lead").agg(F.avg(clean).alias("mean"), F.min(clean).alias("least"), F.count_if(F.isnan(v)).alias("missing")))


@query("e25_rank_correlation", """WITH r AS (SELECT c_mktsegment AS segment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1)/2 AS ra,
    rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1)/2 AS rb, c_acctbal AS a FROM customer)
    SELECT segment, round(CASE WHEN count(*) > 2 THEN corr(ra, rb) END, 6) AS rank_corr, round(quantile_cont(a, 0.5), 4) AS median FROM r GROUP BY segment""")
def rank_correlation(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("b"))
    middle = quantiles(rows, ["segment"], {"median": (F.col("a"), 0.5)})
    return tidy(ops.spearman(rows, ["segment"], "a", "b").join(middle, "segment").select("segment", "rank_corr", "median"), 6, median=4)


@query("m01_score_report", f"WITH {SUMS} SELECT field, lead, grouping_id(field, lead) AS level, round(sqrt(sum(we2)/sum(w)), 4) AS rmse, round(sum(we)/sum(w), 4) AS bias FROM sums GROUP BY ROLLUP (field, lead)")
def score_report(spark, sf):
    """The report of a split: by field and lead, by field, and over all, from the same sums."""
    sums = ops.weighted_sums(samples(spark, sf), ["field", "lead"])
    out = sums.rollup("field", "lead").agg(F.grouping_id().alias("level"), F.sqrt(F.sum("we2") / F.sum("w")).alias("rmse"), (F.sum("we") / F.sum("w")).alias("bias"))
    return tidy(out.select("field", "lead", "level", "rmse", "bias"))


@query("m06_damped_forecast", f"""WITH {DAILY}, p AS (SELECT feature, cell, day, value, lag(value) OVER w AS x0, lag(day) OVER w AS d0 FROM daily WINDOW w AS (PARTITION BY feature, cell ORDER BY day)),
    q AS (SELECT * FROM p WHERE datediff('day', d0, day) = 1), f AS (SELECT feature, regr_slope(value, x0) AS slope, regr_intercept(value, x0) AS base FROM q WHERE day < DATE '2024-01-20' GROUP BY feature)
    SELECT feature, count(*) AS n, round(sqrt(avg(pow(base + slope*x0 - value, 2))), 4) AS rmse, round(sqrt(avg(pow(x0 - value, 2))), 4) AS rmse_pers FROM q JOIN f USING (feature) WHERE day >= DATE '2024-01-20' GROUP BY feature""")
def damped_forecast(spark, sf):
    """A linear forecast provider fitted on the days before a split, scored after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("feature", "cell").orderBy("day")
    pairs = daily(spark, sf).withColumns({"x0": F.lag("value").over(w), "d0": F.lag("day").over(w)}).where(F.datediff("day", "d0") == 1)
    fit = pairs.where("day < DATE '2024-01-20'").groupBy("feature").agg(F.regr_slope("value", "x0").alias("slope"), F.regr_intercept("value", "x0").alias("base"))
    e = F.col("base") + F.col("slope") * F.col("x0") - F.col("value")
    out = pairs.where("day >= DATE '2024-01-20'").join(fit, "feature").groupBy("feature").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg((F.col("x0") - F.col("value")) ** 2)).alias("rmse_pers"))
    return tidy(out)
