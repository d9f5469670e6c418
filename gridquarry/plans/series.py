"""Time series."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import moments as mom
from ..operators import series as ops
from ..shared import spread
from .registry import query
from .scores import tidy
from .tables import DAILY, SAMPLES, daily, samples, table

DAYS = DAILY + ", days AS (SELECT DISTINCT cell, datediff('day', DATE '2024-01-01', day) AS d FROM daily WHERE feature = 'view')"


def days(spark, sf):
    return daily(spark, sf).where("feature = 'view'").select("cell", F.datediff("day", F.lit("2024-01-01")).cast("long").alias("d")).distinct()


@query("f01_runs", f"WITH {DAYS}, i AS (SELECT cell, d, d - row_number() OVER (PARTITION BY cell ORDER BY d) AS island FROM days) SELECT cell, min(d) AS first, max(d) AS last, count(*) AS length FROM i GROUP BY cell, island")
def runs(spark, sf):
    return ops.runs(days(spark, sf), ["cell"], "d", F.lit(True))


@query("f02_long_gaps", f"WITH {DAYS}, g AS (SELECT cell, d, d - lag(d) OVER (PARTITION BY cell ORDER BY d) - 1 AS gap FROM days) SELECT cell, count(*) AS gaps, max(gap) AS longest FROM g WHERE gap > 3 GROUP BY cell")
def long_gaps(spark, sf):
    """Gaps longer than allowed; a gap of exactly 3 days is."""
    gap = F.col("d") - F.lag("d").over(Window.partitionBy("cell").orderBy("d")) - 1
    return days(spark, sf).select("cell", gap.alias("gap")).where("gap > 3").groupBy("cell").agg(F.count("*").alias("gaps"), F.max("gap").alias("longest"))


@query("f03_gap_fill", f"""WITH {DAILY}, e AS (SELECT cell, feature, min(day) AS a, max(day) AS b FROM daily GROUP BY ALL), s AS (SELECT cell, feature, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e),
    j AS (SELECT s.*, value FROM s LEFT JOIN daily USING (cell, feature, day)),
    k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER p AS pd, last_value(value IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER q AS qd, first_value(value IGNORE NULLS) OVER q AS qv
      FROM j WINDOW p AS (PARTITION BY cell, feature ORDER BY day ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY cell, feature ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT cell, feature, day, round(coalesce(value, (1 - datediff('day', pd, day)/datediff('day', pd, qd))*pv + datediff('day', pd, day)/datediff('day', pd, qd)*qv), 6) AS value, value IS NOT NULL AS real FROM k""")
def gap_fill(spark, sf):
    return tidy(ops.filled(daily(spark, sf), ["cell", "feature"], "day", "value"), 6)


@query("f04_change_scales", f"WITH {DAILY}, c AS (SELECT feature, value - lag(value) OVER w AS c, datediff('day', lag(day) OVER w, day) AS n, day FROM daily WINDOW w AS (PARTITION BY cell, feature ORDER BY day)) SELECT feature, count(*) AS n, round(stddev_pop(c), 6) AS scale FROM c WHERE n = 1 AND day <= DATE '2024-01-20' GROUP BY feature")
def change_scales(spark, sf):
    rows = mom.with_change(daily(spark, sf), ["cell", "feature"], "day", "value").where("change IS NOT NULL AND day <= DATE '2024-01-20'")
    return tidy(rows.groupBy("feature").agg(F.count("*").alias("n"), F.stddev_pop("change").alias("scale")), 6)


LOSSES = "losses AS (SELECT c_nationkey AS run, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS step, 1.1 + (c_acctbal % 100)/1000 AS loss FROM customer), l AS (SELECT * FROM losses)"


def losses(spark, sf):
    """Training histories: run, step from 1, loss."""
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("run"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("step"), (1.1 + (F.col("c_acctbal") % 100) / 1000).alias("loss"))


@query("f05_collapse", f"""WITH {LOSSES}, m AS (SELECT run, step, avg(loss) OVER w AS ma FROM l WINDOW w AS (PARTITION BY run ORDER BY step ROWS 4 PRECEDING)), b AS (SELECT *, lag(ma, 5) OVER (PARTITION BY run ORDER BY step) AS before FROM m)
    SELECT run, CAST(min(CASE WHEN step >= 10 AND ma >= 0.9*1.15 AND ma >= 0.99*before THEN step END) AS INT) AS epoch FROM b GROUP BY run""")
def collapse(spark, sf):
    """The first epoch of a training history at which it no longer gains on its anchor."""
    return ops.collapsed(losses(spark, sf), ["run"], "step", "loss", F.lit(1.15))


@query("f06_departure", f"""WITH {SAMPLES}, r AS (SELECT start, lead, sum(pred)/sum(truth) AS r FROM samples GROUP BY ALL), o AS (SELECT start, lead, sum(CASE WHEN r < 0.94 OR r > 0.97 THEN 1 ELSE 0 END) OVER (PARTITION BY start ORDER BY lead ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM r)
    SELECT start, min(CASE WHEN n = 3 THEN lead END) AS departs FROM o GROUP BY start""")
def departure(spark, sf):
    """The lead from which the ratio stays outside its band."""
    rows = samples(spark, sf).groupBy("start", "lead").agg((F.sum("pred") / F.sum("truth")).alias("r"))
    return ops.departure(rows, ["start"], "lead", F.col("r"), 0.94, 0.97)


@query("f07_plateau", f"""WITH RECURSIVE {LOSSES}, p AS (SELECT run, 0::BIGINT AS step, 'infinity'::DOUBLE AS best, 0 AS stale, 0 AS still, 0 AS decays, NULL::INT AS stopped FROM (SELECT DISTINCT run FROM l)
    UNION ALL SELECT p.run, l.step, CASE WHEN b THEN loss ELSE best END, CASE WHEN b THEN 0 WHEN stale + 1 >= 3 THEN 0 ELSE stale + 1 END, CASE WHEN b THEN 0 ELSE still + 1 END, decays + CASE WHEN NOT b AND stale + 1 >= 3 THEN 1 ELSE 0 END,
      CASE WHEN NOT b AND still + 1 >= 8 THEN l.step::INT END FROM p JOIN l ON l.run = p.run AND l.step = p.step + 1, LATERAL (SELECT loss < best*(1 - 0.01) AS b) WHERE stopped IS NULL)
    SELECT run, max_by(decays, step) AS decays, max(stopped) AS stopped, round(max_by(best, step), 6) AS best FROM p GROUP BY run""")
def plateau(spark, sf):
    """Decays and stops of a rate schedule."""
    return tidy(ops.plateau(losses(spark, sf), ["run"], "step", "loss", 0.01, 3, 8), 6)


@query("f08_day_spans", f"""WITH {DAYS}, i AS (SELECT cell, d, d - row_number() OVER (PARTITION BY cell ORDER BY d) AS island FROM days), r AS (SELECT cell, DATE '2024-01-01' + CAST(min(d) AS INT) AS a, DATE '2024-01-01' + CAST(max(d) AS INT) AS b FROM i GROUP BY cell, island)
    SELECT cell, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '..' || b END, ', ' ORDER BY a) AS spans FROM r GROUP BY cell""")
def day_spans(spark, sf):
    return ops.spans(daily(spark, sf).where("feature = 'view'"), ["cell"], "day")


@query("f09_lagged_band", f"WITH {SAMPLES}, t AS (SELECT start, lead, sum(truth) AS v FROM samples GROUP BY ALL), c AS (SELECT lead, v - lag(v, 3) OVER (PARTITION BY start ORDER BY lead) AS c FROM t) SELECT count(c) AS n, round(stddev_pop(c), 3) AS half_width FROM c")
def lagged_band(spark, sf):
    """Half-width of a band: the population std of the truth's own change over some leads, pooled over starts."""
    rows = samples(spark, sf).groupBy("start", "lead").agg(F.sum("truth").alias("v"))
    change = F.col("v") - F.lag("v", 3).over(Window.partitionBy("start").orderBy("lead"))
    return tidy(rows.select(change.alias("c")).agg(F.count("c").alias("n"), F.stddev_pop("c").alias("half_width")), 3)


LAYERS = "layers AS (SELECT l_orderkey AS col, l_linenumber AS level, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, l_quantity - 8 AS dp, CASE WHEN l_discount > 0.02 THEN l_quantity*0.9 ELSE 0 END AS prev, l_tax + 0.01 AS cv FROM lineitem)"


def layers(spark, sf):
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return spread(lines, "l_orderkey").select(
        F.col("l_orderkey").alias("col"), F.col("l_linenumber").alias("level"), k.alias("k"), (F.col("l_quantity") - 8).alias("dp"),
        F.when(F.col("l_discount") > 0.02, F.col("l_quantity") * 0.9).otherwise(0.0).alias("prev"), (F.col("l_tax") + 0.01).alias("cv"),
    )


@query("f10_projected_thickness", f"""WITH {LAYERS}, a AS (SELECT *, sum(greatest(prev, 0)) OVER (PARTITION BY col) AS total, sum(greatest(dp, 0)) OVER (PARTITION BY col ORDER BY k) AS s FROM layers), b AS (SELECT *, least(s, total) AS face FROM a),
    c AS (SELECT *, face - coalesce(lag(face) OVER (PARTITION BY col ORDER BY k), 0) AS got, CASE WHEN prev > 1 THEN cv ELSE 0 END AS w FROM b), d AS (SELECT *, total - max(face) OVER (PARTITION BY col) AS short, greatest(sum(w) OVER (PARTITION BY col), 1e-12) AS ws FROM c)
    SELECT col, k, round(got + short*w/ws, 6) AS projected FROM d""")
def projected(spark, sf):
    return tidy(ops.projected_thickness(layers(spark, sf), ["col"], "k", "dp", "prev", "cv", 1.0).select("col", F.col("k").cast("long"), "projected"), 6)


@query("f11_running_increments", f"WITH {DAILY} SELECT cell, feature, day, round(first_value(value) OVER w + coalesce(sum(value/10) OVER (PARTITION BY cell, feature ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS forecast FROM daily WINDOW w AS (PARTITION BY cell, feature ORDER BY day)")
def running_increments(spark, sf):
    """Initial state plus the running sum of increments."""
    w = Window.partitionBy("cell", "feature").orderBy("day")
    before = F.coalesce(F.sum(F.col("value") / 10).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return tidy(daily(spark, sf).select("cell", "feature", "day", (F.first("value").over(w) + before).alias("forecast")), 6)


@query("f12_padded_windows", f"""WITH {SAMPLES}, r AS (SELECT start, lead, sum(pred) AS v FROM samples GROUP BY ALL), e AS (SELECT start, max(lead) AS horizon FROM r GROUP BY start),
    g AS (SELECT start, unnest(range(1, 9)) AS lead FROM e) SELECT g.start, CAST(g.lead AS INT) AS lead, CAST((g.lead - 1)//4 AS INT) AS chunk, round(last_value(v IGNORE NULLS) OVER (PARTITION BY g.start ORDER BY g.lead ROWS UNBOUNDED PRECEDING), 4) AS v FROM g LEFT JOIN r ON r.start = g.start AND r.lead = g.lead""")
def padded_windows(spark, sf):
    """Leads in chunks of 4, short runs padded by their last step."""
    rows = samples(spark, sf).groupBy("start", "lead").agg(F.sum("pred").alias("v"))
    grid = rows.select("start").distinct().select("start", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("lead"))
    w = Window.partitionBy("start").orderBy("lead")
    out = grid.join(rows, ["start", "lead"], "left").select("start", "lead", F.expr("CAST((lead - 1) div 4 AS INT)").alias("chunk"), F.last("v", True).over(w).alias("v"))
    return tidy(out)


@query("f13_fill_from_above", f"WITH {LAYERS} SELECT col, k, round(last_value(CASE WHEN prev >= 1 THEN dp END IGNORE NULLS) OVER (PARTITION BY col ORDER BY k ROWS UNBOUNDED PRECEDING), 6) AS v FROM layers")
def fill_from_above(spark, sf):
    """Thin layers copy the one above, top to bottom."""
    return tidy(layers(spark, sf).select("col", F.col("k").cast("long"), ops.from_above(F.col("dp"), F.col("prev") < 1, ["col"], "k").alias("v")), 6)


@query("f15_interface_depths", f"WITH {LAYERS}, i AS (SELECT col, k, sum(greatest(prev, 0)) OVER (PARTITION BY col ORDER BY k) AS bottom, prev FROM layers) SELECT col, k, round(bottom, 6) AS bottom, round(bottom - greatest(prev, 0)/2, 6) AS middle FROM i")
def interface_depths(spark, sf):
    """Depths of interfaces by cumulative thickness, and the layers' middles."""
    dp = F.greatest(F.col("prev"), F.lit(0.0))
    rows = layers(spark, sf).select("col", F.col("k").cast("long"), "prev", F.sum(dp).over(Window.partitionBy("col").orderBy("k")).alias("bottom"))
    return tidy(rows.select("col", "k", "bottom", (F.col("bottom") - dp / 2).alias("middle")), 6)


@query("f16_guarded_mean_square_change", f"""WITH {DAILY}, c AS (SELECT feature, CASE WHEN datediff('day', lag(day) OVER w, day) = 1 AND value > 1 AND lag(value) OVER w > 1 THEN value - lag(value) OVER w END AS c FROM daily WINDOW w AS (PARTITION BY cell, feature ORDER BY day))
    SELECT feature, count(c) AS n, round(avg(c*c), 6) AS mean_square FROM c GROUP BY feature""")
def mean_square_change(spark, sf):
    """Mean square one-day change; a row that isn't used breaks the chain."""
    rows = mom.with_change(daily(spark, sf), ["cell", "feature"], "day", "value", F.col("value") > 1)
    return tidy(rows.groupBy("feature").agg(F.count("change").alias("n"), F.avg(F.col("change") ** 2).alias("mean_square")), 6)


@query("f17_stage_verdicts", f"""WITH {LOSSES}, a AS (SELECT run, avg(loss) AS l0 FROM l WHERE step <= 3 GROUP BY run), m AS (SELECT run, step, avg(loss) OVER (PARTITION BY run ORDER BY step ROWS 4 PRECEDING) AS ma FROM l), b AS (SELECT *, lag(ma, 5) OVER (PARTITION BY run ORDER BY step) AS before FROM m)
    SELECT run, n_name AS stage, min(CASE WHEN step >= 10 AND ma >= 0.9*l0 AND ma >= 0.99*before THEN step END) IS NOT NULL AS collapsed FROM b JOIN a USING (run) JOIN nation ON n_nationkey = run GROUP BY ALL""")
def stage_verdicts(spark, sf):
    """Each stage's history against its own anchor."""
    rows = losses(spark, sf)
    anchors = rows.where("step <= 3").groupBy("run").agg(F.avg("loss").alias("l0"))
    found = ops.collapsed(rows.join(anchors, "run"), ["run"], "step", "loss", F.col("l0"))
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("run"), F.col("n_name").alias("stage"))
    return found.join(names, "run").select("run", "stage", F.col("epoch").isNotNull().alias("collapsed"))


@query("f18_assembled_day", f"""WITH {LAYERS}, f AS (SELECT col, k, last_value(CASE WHEN prev >= 1 THEN dp END IGNORE NULLS) OVER (PARTITION BY col ORDER BY k ROWS UNBOUNDED PRECEDING) AS v, prev FROM layers)
    SELECT col, count(*) AS rows, count_if(prev < 1) AS lost, count_if(k = 1 AND prev < 1) > 0 OR count_if(prev < 1) > 0.5*count(*) AS refused, round(sum(coalesce(v, -1)), 6) AS total FROM f GROUP BY col""")
def assembled_day(spark, sf):
    """One column's rows: lost points filled from above, constants where nothing is; refused if the surface or too many are lost."""
    rows = layers(spark, sf).withColumn("v", ops.from_above(F.col("dp"), F.col("prev") < 1, ["col"], "k"))
    lost = F.count_if(F.col("prev") < 1)
    refused = (F.count_if((F.col("k") == 1) & (F.col("prev") < 1)) > 0) | (lost > 0.5 * F.count("*"))
    return tidy(rows.groupBy("col").agg(F.count("*").alias("rows"), lost.alias("lost"), refused.alias("refused"), F.sum(F.coalesce("v", F.lit(-1.0))).alias("total")), 6)


#: Days on which a source changes.
CHANGES = [datetime.date(1997, 6, 1), datetime.date(1999, 1, 1), datetime.date(1999, 1, 2), datetime.date(2000, 2, 1)]
CHANGE_LIST = ", ".join(f"DATE '{d}'" for d in CHANGES)


@query("c07_kept_windows", f"WITH o AS (SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 30 AS b FROM orders) SELECT key, a AS first FROM o WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest([{CHANGE_LIST}]) AS c) WHERE c > a AND c <= b)")
def kept_windows(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("first"))
    return ops.kept_windows(rows, F.col("first"), F.date_add("first", 30), CHANGES)


@query("d03_lagged_forcing", f"""WITH {DAILY}, l AS (SELECT cell, feature, day, 0.75*lag(value, 2) OVER w + 0.25*lag(value, 1) OVER w AS forcing, row_number() OVER w AS n FROM daily WINDOW w AS (PARTITION BY cell, feature ORDER BY day)) SELECT cell, feature, day, round(forcing, 6) AS forcing FROM l WHERE n > 2""")
def lagged_forcing(spark, sf):
    """Increments of the two rows before, weighted; the first two rows have none."""
    rows = daily(spark, sf).withColumn("forcing", ops.weighted_lags("value", {2: 0.75, 1: 0.25}, ["cell", "feature"], "day"))
    return tidy(rows.where("forcing IS NOT NULL").select("cell", "feature", "day", "forcing"), 6)


@query("f14_tracked_maximum", f"""WITH RECURSIVE {DAILY}, m AS (SELECT cell // 50 AS region, datediff('day', DATE '2024-01-01', day) AS d, cell FROM daily WHERE feature = 'view' AND value > 5),
    t AS (SELECT region, s.step, 15::BIGINT AS d, min(cell) AS cell FROM m, (VALUES (-1), (1)) s(step) WHERE d = 15 GROUP BY ALL
      UNION ALL SELECT t.region, t.step, t.d + t.step, n.cell FROM t, LATERAL (SELECT (SELECT arg_min(m.cell, struct_pack(a := abs(m.cell - t.cell), c := m.cell)) FROM m WHERE m.region = t.region AND m.d = t.d + t.step) AS cell) n WHERE abs(n.cell - t.cell) <= 6)
    SELECT DISTINCT region, d AS day, cell FROM t""")
def tracked(spark, sf):
    """A maximum followed day by day to the nearest within a radius, back and forth from an event."""
    from .topology import tracks

    return tracks(spark, sf)
