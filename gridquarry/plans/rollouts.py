"""Rollouts and registries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rollouts as ops
from ..operators import scores
from ..operators.series import projected_thickness
from .registry import query
from .scores import ERF, tidy
from .series import LAYERS, layers
from .tables import DAILY, SAMPLES, daily, samples, table

STARTS = DAILY + """, p AS (SELECT *, lag(value) OVER w AS x0, lag(day) OVER w AS d0 FROM daily WINDOW w AS (PARTITION BY cell, feature ORDER BY day)), q AS (SELECT feature, regr_slope(value, x0) AS slope, regr_intercept(value, x0) AS base FROM p WHERE datediff('day', d0, day) = 1 GROUP BY feature),
    s AS (SELECT cell, feature, day AS start, value AS x0, least(5, datediff('day', day, DATE '2024-01-30')) AS horizon FROM daily WHERE day >= DATE '2024-01-24')"""


def pairs(spark, sf):
    w = Window.partitionBy("cell", "feature").orderBy("day")
    return daily(spark, sf).withColumns({"x0": F.lag("value").over(w), "d0": F.lag("day").over(w)}).where(F.datediff("day", "d0") == 1)


def rolled(spark, sf, provider="linear", chunk=None):
    starts = daily(spark, sf).where("day >= DATE '2024-01-24'").select("cell", "feature", F.col("day").alias("start"), F.col("value").alias("x0"))
    model = ops.PROVIDERS[provider](daily(spark, sf).withColumn("x0", F.col("value")) if provider != "linear" else pairs(spark, sf))
    if provider == "linear":
        model = ops.fitted(pairs(spark, sf), ["feature"], "value", "x0")
        by = ["feature"]
    else:
        by = ["cell", "feature"]
    return ops.unrolled(starts, model, by, "x0", F.least(F.lit(5), F.datediff(F.lit("2024-01-30"), "start")), chunk)


#: The model of two states: the fitted line, a share of the last change and of the day's forcing; every fifth cell is boundary.
PUSH, DRIVE = 0.15, 0.05
ROLL = "RECURSIVE " + STARTS + f""", i AS (SELECT user_id AS cell, event_type AS feature, CAST(ts AS DATE) AS day, count(*)/10.0::DOUBLE AS forcing FROM events GROUP BY ALL),
    runs AS (SELECT cell, feature, day AS start, value AS x0, x0 AS x1, datediff('day', day, DATE '2024-01-30') AS horizon FROM p WHERE datediff('day', d0, day) = 1 AND day >= DATE '2024-01-10'),
    r AS (SELECT cell, feature, start, horizon, 0 AS lead, x0 AS pred, x1 AS before FROM runs
        UNION ALL SELECT r.cell, feature, start, horizon, lead + 1, coalesce(CASE WHEN r.cell % 5 = 0 THEN d.value END, base + slope*pred + {PUSH}*(pred - before) + {DRIVE}*coalesce(i.forcing, 0)), pred
            FROM r JOIN q USING (feature) LEFT JOIN i ON i.cell = r.cell AND i.feature = r.feature AND i.day = r.start + (lead + 1) LEFT JOIN daily d ON d.cell = r.cell AND d.feature = r.feature AND d.day = r.start + (lead + 1) WHERE lead < horizon)"""


def rolled_pairs(spark, sf, chunk):
    """Runs from every pair of days since the tenth to the thirtieth, driven by each day's number of events, with the truth on boundary cells."""
    starts = pairs(spark, sf).where("day >= DATE '2024-01-10'").select("cell", "feature", F.col("day").alias("start"), F.col("value").alias("x0"), F.col("x0").alias("x1"), F.datediff(F.lit("2024-01-30"), "day").alias("horizon"))
    events = table(spark, sf, "events").groupBy(F.to_date("ts").alias("start"), F.col("user_id").alias("cell"), F.col("event_type").alias("feature")).agg((F.count("*") / 10.0).alias("forcing"))
    truth = daily(spark, sf).select(F.col("day").alias("start"), "cell", "feature", F.when(F.col("cell") % 5 == 0, F.col("value")).alias("edge"))
    model = ops.fitted(pairs(spark, sf), ["feature"], "value", "x0")
    step = lambda last, before, given: F.col("base") + F.col("slope") * last + PUSH * (last - before) + DRIVE * F.coalesce(given["forcing"], F.lit(0.0))
    return ops.unrolled_pairs(starts.join(model, "feature"), events.join(truth, ["start", "cell", "feature"]), ["cell", "feature"], "start", step, "edge", chunk)


@query("p04_rollout", f"WITH {ROLL} SELECT cell, feature, start, lead, round(pred, 6) AS pred FROM r WHERE lead > 0")
def rollout(spark, sf):
    """A model of two states run lead after lead with its forcing and the boundary's truth; runs leave when their horizon ends."""
    return tidy(rolled_pairs(spark, sf, 20).select("cell", "feature", "start", "lead", "pred"), 6)


@query("p07_chunked_rollout", f"WITH {ROLL} SELECT feature, lead, count(*) AS n, round(avg(pred), 6) AS mean FROM r WHERE lead > 0 GROUP BY ALL")
def chunked(spark, sf):
    """The same in chunks of seven leads, both states carried over."""
    return tidy(rolled_pairs(spark, sf, 7).groupBy("feature", "lead").agg(F.count("*").alias("n"), F.avg("pred").alias("mean")), 6)


@query("o03_providers", f"WITH {STARTS}, l AS (SELECT unnest(range(1, 6)) AS lead), v AS (SELECT s.*, lead FROM s, l WHERE lead <= horizon) SELECT 'persistence' AS provider, CAST(lead AS INT) AS lead, round(sqrt(avg(pow(v.x0 - d.value, 2))), 6) AS rmse FROM v JOIN daily d ON d.cell = v.cell AND d.feature = v.feature AND d.day = v.start + CAST(lead AS INT) GROUP BY lead UNION ALL SELECT 'damped', CAST(lead AS INT), round(sqrt(avg(pow(v.x0*pow(0.8, lead) - d.value, 2))), 6) FROM v JOIN daily d ON d.cell = v.cell AND d.feature = v.feature AND d.day = v.start + CAST(lead AS INT) GROUP BY lead")
def providers(spark, sf):
    """Providers scored against what came."""
    truth = daily(spark, sf).select("cell", "feature", F.col("day").alias("valid"), F.col("value").alias("truth"))
    rows = [rolled(spark, sf, p).withColumns({"provider": F.lit(p), "valid": F.date_add("start", F.col("lead"))}) for p in ("persistence", "damped")]
    scored = rows[0].unionByName(rows[1]).join(truth, ["cell", "feature", "valid"])
    return tidy(scored.groupBy("provider", "lead").agg(F.sqrt(F.avg((F.col("pred") - F.col("truth")) ** 2)).alias("rmse")), 6)


#: Seed, members and a day's sigma of the ensemble provider, which disturbs persistence.
SEED, MEMBERS, SIGMA = 7, 4, 5.0


def normal_sql(*keys: str) -> str:
    """The counted normal number in SQL."""
    u = [f"(CAST('0x' || substr(md5(concat_ws(':', '{SEED}', '{salt}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 13) AS BIGINT) + 0.5)/4503599627370496.0::DOUBLE" for salt in (1, 2)]
    return f"sqrt(-2*ln({u[0]}))*cos(2*pi()*{u[1]})"


PROVIDED = STARTS + f""", v AS (SELECT s.cell, s.feature, s.start, CAST(lead AS INTEGER) AS lead, s.x0, d.value AS y, {SIGMA}*sqrt(lead) AS sigma FROM s, range(1, 6) l(lead), daily d WHERE lead <= horizon AND d.cell = s.cell AND d.feature = s.feature AND d.day = s.start + CAST(lead AS INTEGER)),
    e AS (SELECT *, x0 + sigma*{normal_sql('cell', 'feature', 'start', 'lead', 'member')} AS x FROM v, range(0, {MEMBERS}) m(member))"""


def provided(spark, sf):
    """Persistence with a sigma that grows with the lead, beside what came."""
    truth = daily(spark, sf).select("cell", "feature", F.col("day").alias("valid"), F.col("value").alias("y"))
    rows = rolled(spark, sf, "persistence").withColumn("valid", F.date_add("start", F.col("lead")))
    return rows.join(truth, ["cell", "feature", "valid"]).select("cell", "feature", "start", F.col("lead").cast("int").alias("lead"), "pred", "y", (SIGMA * F.sqrt("lead")).alias("sigma"))


KEY = ["cell", "feature", "start", "lead"]


@query("o03_ensemble_provider", f"""WITH {PROVIDED}, o AS (SELECT *, row_number() OVER (PARTITION BY cell, feature, start, lead ORDER BY x) - 1 AS i FROM e),
    k AS (SELECT cell, feature, start, lead, any_value(y) AS y, avg(x) AS mean, var_samp(x) AS variance, avg(pow(x - y, 2)) AS e2, avg(abs(x - y)) - sum((2*i - {MEMBERS - 1})*x)/{MEMBERS * (MEMBERS - 1)} AS crps FROM o GROUP BY cell, feature, start, lead)
    SELECT lead, round(sqrt(avg(pow(mean - y, 2))), 5) AS rmse, round(sqrt(avg(e2)), 5) AS rmse_member, round(sqrt(avg(variance)*{MEMBERS + 1}/{MEMBERS}), 5) AS spread, round(sqrt(avg(variance)*{MEMBERS + 1}/{MEMBERS}/avg(pow(mean - y, 2))), 5) AS spread_skill, round(avg(crps), 5) AS crps FROM k GROUP BY lead""")
def ensemble_provider(spark, sf):
    """An ensemble provider, four rows a key, and its scores."""
    members = ops.ensemble(provided(spark, sf).drop("sigma"), KEY, MEMBERS, SIGMA * F.sqrt("lead"), SEED)
    return tidy(scores.spread_skill(scores.fair_crps(members, KEY, "pred").withColumn("w", F.lit(1.0)), ["lead"]), 5)


@query("o04_sigma_provider", f"""WITH {PROVIDED}, z AS (SELECT lead, x0 AS mean, y, sigma, (y - x0)/sigma AS z FROM v), t AS (SELECT *, sigma*(z*{ERF.format(z='(z/sqrt(2.0))')} + 2*exp(-z*z/2)/sqrt(2*pi()) - 1/sqrt(pi())) AS c FROM z)
    SELECT lead, round(avg(c), 5) AS crps, round(avg(CASE WHEN abs(mean - y) <= sigma THEN 1.0::DOUBLE ELSE 0 END), 6) AS within1, round(sqrt(avg(pow(mean - y, 2))/avg(sigma*sigma)), 5) AS factor FROM t GROUP BY lead""")
def sigma_provider(spark, sf):
    """A provider with a sigma column: its CRPS, how often the truth lies within a sigma, and the factor that would calibrate it."""
    mean, sigma, y = F.col("pred"), F.col("sigma"), F.col("y")
    rows = provided(spark, sf).withColumns({"c": scores.gaussian_crps(mean, sigma, y), "variance": sigma * sigma, "w": F.lit(1.0)})
    factor = scores.calibration(rows, ["lead"], "pred", "y", "variance", "w")
    return tidy(rows.groupBy("lead").agg(F.avg("c").alias("crps"), F.avg(scores.covered(mean, sigma, y, 1)).alias("within1")).join(factor, "lead"), 5, within1=6)


@query("o05_projected_provider", f"""WITH {LAYERS}, m AS (SELECT col, k, member, prev, cv, dp + 3*{normal_sql('col', 'k', 'member')} AS dp FROM layers, range(0, 3) r(member)), a AS (SELECT *, sum(greatest(prev, 0)) OVER w AS total, sum(greatest(dp, 0)) OVER (PARTITION BY col, member ORDER BY k) AS s FROM m WINDOW w AS (PARTITION BY col, member)),
    b AS (SELECT *, least(s, total) AS face FROM a), c AS (SELECT *, face - coalesce(lag(face) OVER (PARTITION BY col, member ORDER BY k), 0) AS got, CASE WHEN prev > 1 THEN cv ELSE 0 END AS w FROM b), d AS (SELECT *, total - max(face) OVER (PARTITION BY col, member) AS short, greatest(sum(w) OVER (PARTITION BY col, member), 1e-12) AS ws FROM c)
    SELECT member::INTEGER AS member, k::BIGINT AS k, count(*) AS n, round(avg(got + short*w/ws), 5) AS mean, round(stddev_pop(got + short*w/ws), 5) AS spread FROM d GROUP BY ALL""")
def projected_provider(spark, sf):
    """Forecasts of an ensemble's layer thicknesses, projected so that none is negative and columns keep their total."""
    members = ops.ensemble(layers(spark, sf), ["col", "k"], 3, F.lit(3.0), SEED, "dp")
    rows = projected_thickness(members, ["col", "member"], "k", "dp", "prev", "cv", 1.0)
    return tidy(rows.groupBy("member", F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.avg("projected").alias("mean"), F.stddev_pop("projected").alias("spread")), 5)


REGISTRY = """round(sqrt(sum(w*pow(pred-truth,2))/sum(w)), 4) AS rmse, round(sqrt(sum(w*pow(x0-truth,2))/sum(w)), 4) AS rmse_pers, round(sum(w*(pred-truth))/sum(w), 4) AS bias, round(sum(w*(x0-truth))/sum(w), 4) AS bias_pers,
    round(sum(w*pred)/sum(w), 4) AS mean_pred, round(sum(w*pred*pred)/2/sum(w), 2) AS ke_pred, round(max(abs(pred)), 4) AS max_pred, round(sum(w*truth)/sum(w), 4) AS mean_truth, round(sum(w*truth*truth)/2/sum(w), 2) AS ke_truth, round(max(abs(truth)), 4) AS max_truth"""


@query("q01_registered_statistic", f"WITH {SAMPLES} SELECT lead, {REGISTRY}, round(sum(w*pred)/sum(w*truth), 6) AS ratio FROM samples GROUP BY lead")
def registered(spark, sf):
    """One more statistic is one more entry."""
    more = ops.registry() | {"ratio": ops.Statistic("1", F.sum(F.col("w") * F.col("pred")) / F.sum(F.col("w") * F.col("truth")))}
    return tidy(ops.statistics(samples(spark, sf), ["lead"], more), 4, ke_pred=2, ke_truth=2, ratio=6)


@query("m05_shared_steps", f"WITH {SAMPLES}, s AS (SELECT lead, start, sum(w*pred)/sum(w) AS m, sum(w*truth)/sum(w) AS t FROM samples GROUP BY ALL) SELECT lead, round(avg(m), 4) AS model, round(avg(t), 4) AS truth, round(avg(m - t), 4) AS error, round(sqrt(avg(m*m)), 4) AS rms FROM s GROUP BY lead")
def shared_steps(spark, sf):
    """Several statistics from one shared step, planned once."""
    rows = samples(spark, sf).groupBy("lead", "start").agg((F.sum(F.col("w") * F.col("pred")) / F.sum("w")).alias("m"), (F.sum(F.col("w") * F.col("truth")) / F.sum("w")).alias("t"))
    return tidy(rows.groupBy("lead").agg(F.avg("m").alias("model"), F.avg("t").alias("truth"), F.avg(F.col("m") - F.col("t")).alias("error"), F.sqrt(F.avg(F.col("m") ** 2)).alias("rms")))


@query("q04_functional_table", f"WITH {SAMPLES}, f AS (SELECT * FROM (VALUES ('total', 'A', 1.0), ('contrast', 'A', 1.0), ('contrast', 'N', -1.0), ('half', 'R', 0.5)) t(name, field, k)) SELECT name, lead, round(sum(k*w*truth)/1e6, 6) AS value FROM samples JOIN f USING (field) GROUP BY ALL")
def functional_table(spark, sf):
    """Any linear functional, from a table of weights."""
    table = spark.createDataFrame([("total", "A", 1.0), ("contrast", "A", 1.0), ("contrast", "N", -1.0), ("half", "R", 0.5)], "name string, field string, k double")
    sums = samples(spark, sf).groupBy("field", "lead").agg(F.sum(F.col("w") * F.col("truth")).alias("total"))  # few rows meet the weights
    return tidy(sums.join(table, "field").groupBy("name", "lead").agg((F.sum(F.col("k") * F.col("total")) / 1e6).alias("value")), 6)


@query("q05_table_function", "SELECT o_orderkey AS key, CAST(unnest(range(1, 1 + o_orderkey % 4)) AS BIGINT) AS k FROM orders")
def table_function(spark, sf):
    """One row to many."""
    from .tables import table

    rows = table(spark, sf, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("key"))
    return rows.select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("key") % 4)).alias("k"))
