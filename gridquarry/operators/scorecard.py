"""A scorecard of free runs: the lead at which each diagnostic leaves its band."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import quantiles
from .series import departure
from .spectra import BANDS
from .statistics import MEANS, SCALES_KM, SPECTRA, TIES, VORTICITY

#: Bands of ratios, of the share of inversions, of counts and of the front's distance over persistence's;
#: leads outside in a row that make a departure, the lead over which the truth's own change is taken, the share of a
#: tie's side that its true residual may be for the tie to serve as a loss, leads that are reported.
RATIO, INVERSIONS, COUNTS, FRONTS = (0.9, 1.1), (0.5, 2.0), (0.67, 1.5), (0.0, 1.0)
RUN, OWN_CHANGE, MOST_RESIDUAL, REPORTED = 3, 7, 0.5, (1, 4, 7, 10, 14, 21, 30, 45, 60)


@dataclass(frozen=True)
class Diagnostic:
    """A row of a scorecard: a series made of statistics, the band it should stay in, and how starts are reduced."""

    name: str
    family: str
    series: Column
    band: tuple[float, float] = RATIO
    reduce: str = "median"


def over(a: str, b: str) -> Column:
    """A ratio of statistics: infinite over nothing, null for nothing over nothing."""
    return F.coalesce(F.try_divide(a, b), F.when(F.col(a) != 0, F.signum(a) * float("inf")))


def own_change(stats: DataFrame, names: list[str], leads: int = OWN_CHANGE) -> dict[str, float]:
    """The population standard deviation of each statistic's change over so many leads of a run, pooled."""
    w = Window.partitionBy("start").orderBy("lead")
    there = F.lag("lead", leads).over(w) == F.col("lead") - leads
    changes = stats.select(*(F.when(there, F.col(n) - F.lag(n, leads).over(w)).alias(n) for n in names))
    found = changes.agg(*(F.stddev_pop(n).alias(n) for n in names)).first()
    return {n: found[n] if found[n] is not None else 0.0 for n in names}


def diagnostics(stats: DataFrame) -> list[Diagnostic]:
    """All 32 diagnostics; the bands of means are the truth's own change."""
    of = lambda name, family, key, **how: Diagnostic(name, family, over(f"{key}_model", f"{key}_truth"), **how)
    change = own_change(stats, [f"mean_{c}_truth" for c in MEANS])
    out = [of("ke", "blur", "ke"), of("maxspeed", "blur", "maxspeed")]
    out += [Diagnostic(f"spec_{c}_{band}", "blur", F.col(f"spec_{c}_{band}_ratio")) for c in SPECTRA for band in BANDS]
    for c in MEANS:
        s = change[f"mean_{c}_truth"]
        out.append(Diagnostic(f"mean_{c}", "drift", F.col(f"mean_{c}_model") - F.col(f"mean_{c}_truth"), (-s, s)))
    out += [
        Diagnostic("front_vs_persistence", "eddies", over("front_mean_km_model", "front_mean_km_pers"), FRONTS),
        of("lc_area", "eddies", "lc_area"), of("lc_lce", "eddies", "lc_lce", band=COUNTS, reduce="mean"), of("inversions", "structure", "op_inversions", band=INVERSIONS),
    ]
    for s in SCALES_KM:
        out += [of(f"{k}_{s}", "blur", f"op_{k}_{s}") for k in (*(f"zeta_{z}m" for z in VORTICITY), "div_0m")]
        out += [of(f"{t}_{s}", "ties", f"op_{t}_{s}_residual") for t in TIES]
    return out


def curves(stats: DataFrame, rows: list[Diagnostic], used: Column) -> DataFrame:
    """(name, lead, value): each diagnostic's median or mean over the starts used; null where that is not finite."""
    asked = F.array(*(F.struct(F.lit(d.name).alias("name"), d.series.cast("double").alias("v"), F.lit(d.reduce).alias("how")) for d in rows))
    each = stats.where(used).select("lead", F.inline(asked))
    keys = each.select("name", "lead").distinct()
    middle = quantiles(each.where("how = 'median'"), ["name", "lead"], {"m": (F.col("v"), 0.5)})
    infinite = F.abs(F.col("v")) == float("inf")
    mean = each.where("how = 'mean' AND NOT isnan(v)").groupBy("name", "lead").agg(F.when(F.count_if(infinite) == 0, F.avg(F.when(~infinite, F.col("v")))).alias("m"))
    value = F.when(~F.isnan("m") & (F.abs("m") < float("inf")), F.col("m"))
    return keys.join(middle.unionByName(mean), ["name", "lead"], "left").select("name", "lead", value.alias("value"))


def residual_shares(stats: DataFrame, used: Column) -> DataFrame:
    """(name, truth_residual_share): the median over starts and leads of a tie's true residual over its left side."""
    names = [f"{t}_{s}" for s in SCALES_KM for t in TIES]
    asked = F.array(*(F.struct(F.lit(n).alias("name"), over(f"op_{n}_residual_truth", f"op_{n}_lhs_truth").alias("v")) for n in names))
    return quantiles(stats.where(used).select(F.inline(asked)), ["name"], {"truth_residual_share": (F.col("v"), 0.5)})


def scorecard(stats: DataFrame, rows: list[Diagnostic], test: Column, in_sample: Column, reported: tuple[int, ...] = REPORTED) -> DataFrame:
    """(diagnostic, family, low, high, departs_test, departs_in_sample, d<lead>..., n_test), by departure, never last, then name."""
    card = F.array(*(F.struct(F.lit(d.name).alias("name"), F.lit(d.family).alias("family"), F.lit(float(d.band[0])).alias("low"), F.lit(float(d.band[1])).alias("high"), F.lit(n).alias("__n")) for n, d in enumerate(rows)))
    names = stats.sparkSession.range(1).select(F.inline(card))
    out = names
    for which, used in (("test", test), ("in_sample", in_sample)):
        series = curves(stats, rows, used).join(names, "name")
        outside = F.when(F.col("value") < F.col("low"), -1.0).when(F.col("value") > F.col("high"), 1.0).otherwise(0.0)
        out = out.join(departure(series.withColumn("__at", outside), ["name"], "lead", F.col("__at"), -0.5, 0.5, RUN).withColumnRenamed("departs", f"departs_{which}"), "name", "left")
        if which == "test":
            at = series.groupBy("name").agg(*(F.max(F.when(F.col("lead") == k, F.col("value"))).alias(f"d{k}") for k in reported))
            out = out.join(at, "name", "left")
    n = stats.where(test).select("start").distinct().count()
    out = out.withColumn("n_test", F.lit(n).cast("long")).withColumnRenamed("name", "diagnostic")
    columns = ["diagnostic", "family", "low", "high", "departs_test", "departs_in_sample", *(f"d{k}" for k in reported), "n_test"]
    return out.orderBy(F.asc_nulls_last("departs_test"), "diagnostic").select(*columns)


def full_scorecard(stats: DataFrame, test: Column, in_sample: Column, reported: tuple[int, ...] = REPORTED) -> DataFrame:
    """The scorecard of all diagnostics, with each tie's true residual share and whether it may serve as a loss."""
    card = scorecard(stats, diagnostics(stats), test, in_sample, reported)
    shares = residual_shares(stats, in_sample).withColumnRenamed("name", "diagnostic")
    out = card.join(shares, "diagnostic", "left").withColumn("usable_as_loss", F.col("truth_residual_share") <= MOST_RESIDUAL)
    return out.orderBy(F.asc_nulls_last("departs_test"), "diagnostic")
