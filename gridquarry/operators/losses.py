"""Loss terms of forecast steps: weighted square errors, and what is added to them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics as phys
from . import spectra
from .moments import std_pop
from .statistics import KEYS, MEANS, Steps, state

#: Density that scales layers' errors and inversions, and inversions of levels, in kg/m³; pressure below which a layer is empty.
RHO_REF, INVERSION_SCALE, EMPTY = 0.01, 0.01, 1e-6


def channel_scales(steps: Steps, channels: list[str]) -> dict[str, float]:
    """The population standard deviation of each channel of the true states; 1 where it is 0. One row comes to the driver."""
    row = steps.cells.agg(*(std_pop(state("truth", c)).alias(c) for c in channels)).first()
    return {c: row[c] or 1.0 for c in channels}


def square_error(steps: Steps, channels: list[str], scales: dict[str, float]) -> DataFrame:
    """(start, lead, wmse): squared errors over the channels' variances, averaged over the region and summed over channels."""
    total = sum((((state("pred", c) - state("truth", c)) / scales[c]) ** 2 for c in channels), F.lit(0.0))
    return steps.cells.where("region").groupBy(*KEYS).agg(F.avg(total).alias("wmse"))


def mean_errors(steps: Steps, train: Column) -> DataFrame:
    """(start, lead, means): squared errors of the regional means in units of the std of their true change in a day, summed.

    train: the steps whose changes count.
    """
    mean = lambda who, c: F.sum(steps.weight(c) * state(who, c)) / F.sum(steps.weight(c))
    values = {f"{who}_{c}": mean(who, c) for who in ("pred", "truth", "truth_prev") for c in MEANS}
    rows = steps.cells.groupBy(*KEYS).agg(*(v.alias(n) for n, v in values.items()))
    days = rows.where(train).withColumn("day", F.col("start") + F.col("lead")).groupBy("day").agg(*(F.first(F.col(f"truth_{c}") - F.col(f"truth_prev_{c}")).alias(c) for c in MEANS))
    found = days.agg(*(std_pop(c).alias(c) for c in MEANS)).first()
    error = sum((((F.col(f"pred_{c}") - F.col(f"truth_{c}")) / (found[c] or 1.0)) ** 2 for c in MEANS), F.lit(0.0))
    return rows.select(*KEYS, error.alias("means"))


def spectral_excess(steps: Steps, channels: list[str], scales: dict[str, float]) -> DataFrame:
    """(start, lead, excess): how much more the adjusted square error is than the plain one, summed over channels."""
    mask = steps.image(steps.place.region)
    both = {f"{x}_{c}": (state(who, c) / scales[c]).alias(f"{x}_{c}") for x, who in (("p", "pred"), ("t", "truth")) for c in channels}
    cells = steps.cells.select(*KEYS, "y", "x", *both.values())
    whole = cells.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("y", "x", *both))).alias("v"))
    images = whole.select(*KEYS, F.inline(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"v.p_{c}").alias("p"), F.col(f"v.t_{c}").alias("t")) for c in channels))))
    each = spectra.adjusted_excess(images, "start long, lead int, channel string", mask.shape, "p", "t", 1.0, mask=mask)
    return each.groupBy(*KEYS).agg(F.sum("excess").alias("excess"))


def level_stability(steps: Steps) -> DataFrame:
    """(start, lead, stability): the mean over real pairs of levels of the squared loss of density downward, in its scale."""
    pairs = list(zip(steps.levels, steps.levels[1:], strict=False))
    rho = {z: phys.sigma2(state("pred", f"temp_{z}m"), state("pred", f"salin_{z}m")) for z in steps.levels}
    real = {a: F.col("region") & F.col(f"sea_{a}m") & F.col(f"sea_{b}m") for a, b in pairs}
    loss = sum((F.when(real[a], (F.greatest(rho[a] - rho[b], F.lit(0.0)) / INVERSION_SCALE) ** 2).otherwise(0.0) for a, b in pairs), F.lit(0.0))
    n = sum((r.cast("int") for r in real.values()), F.lit(0))
    return steps.cells.groupBy(*KEYS).agg(F.try_divide(F.sum(loss), F.sum(n)).alias("stability"))


def step_loss(steps: Steps, channels: list[str], weights: dict[str, float], train: Column) -> DataFrame:
    """(start, lead, wmse, means, excess, stability, loss): the terms of each step and their weighted sum with the square error.

    weights: of ``means``, ``excess`` and ``stability``; a term without weight is not computed.
    """
    scales = channel_scales(steps, channels)
    terms = {"means": lambda: mean_errors(steps, train), "excess": lambda: spectral_excess(steps, channels, scales), "stability": lambda: level_stability(steps)}
    parts = [square_error(steps, channels, scales)] + [make() for name, make in terms.items() if weights.get(name)]
    rows = functools.reduce(lambda a, b: a.join(b, KEYS), parts)
    used = [name for name in terms if weights.get(name)]
    return rows.withColumn("loss", F.col("wmse") + sum((weights[n] * F.coalesce(n, F.lit(0.0)) for n in used), F.lit(0.0)))


def layer_loss(df: DataFrame, column: str, layer: str, scales: dict[str, float], weights: dict[str, float], thickness_weighted: bool = True) -> DataFrame:
    """(column, wmse, density, stability, loss) of columns of layers: rows (column, layer, dp, and for each variable of ``scales`` v_pred and v_truth).

    Errors count by a layer's true thickness over the column's mean: not at all in empty layers. density: the squared error
    of density; stability: the squared loss of predicted density downward, by the thinner of the two layers.
    """
    whole, down = Window.partitionBy(column), Window.partitionBy(column).orderBy(layer)
    dp = F.greatest(F.col("dp"), F.lit(0.0))
    rows = df.withColumn("__rel", dp / F.greatest(F.avg(dp).over(whole), F.lit(EMPTY)))
    rows = rows.withColumns({f"__{w}": phys.sigma2(F.col(f"temp_{w}"), F.col(f"salin_{w}")) for w in ("pred", "truth")})
    below, rel = F.lead("__pred").over(down), F.col("__rel")
    rows = rows.withColumns({"__fall": F.greatest(F.col("__pred") - below, F.lit(0.0)) / RHO_REF, "__both": F.least(rel, F.lead("__rel").over(down)), "__pair": below.isNotNull()})
    error = sum((((F.col(f"{v}_pred") - F.col(f"{v}_truth")) / s) ** 2 for v, s in scales.items()), F.lit(0.0))
    out = rows.groupBy(column).agg(
        F.sum(error * (rel if thickness_weighted else F.lit(1.0))).alias("wmse"), F.avg(rel * ((F.col("__pred") - F.col("__truth")) / RHO_REF) ** 2).alias("density"),
        F.coalesce(F.avg(F.when(F.col("__pair"), F.col("__both") * F.col("__fall") ** 2)), F.lit(0.0)).alias("stability"),
    )
    return out.withColumn("loss", F.col("wmse") + weights.get("density", 0.0) * F.col("density") + weights.get("stability", 0.0) * F.col("stability"))
