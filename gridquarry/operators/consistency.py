"""Whether a forecast state is physically consistent: numbers of each step's model state and of the true one."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics as phys
from . import grids
from .statistics import KEYS, WHO, Steps, state

#: Metres below which a thickness is negative and above which a layer is real or counts for its density's
#: spread; the fall of density in kg/m³ that is an inversion; scales in cells between which a band lies.
NEGATIVE, REAL, SPREAD, FALL, BAND = -0.01, 1.0, 5.0, 0.02, {"fine": 0.5, "coarse": 2.5}


def layer_numbers(steps: Steps, thickness: Callable[[str, int], Column], least_cells: int) -> DataFrame:
    """(start, lead, who, neg_thk_frac, neg_thk_min, col_err_m, inversion_frac, iso_spread, baro_resid, ke) over the region's columns.

    iso_spread: the median over layers of the quartiles' distance of density, among layers that more than ``least_cells``
    cells hold thickly; null if there is none. A group of quantiles is a layer of one image.
    """
    layers = list(zip(steps.levels, steps.levels[1:], strict=False))
    parts = []
    for who, x in WHO.items():
        dp = {z: thickness(x, z) for z in steps.levels}
        rho = {z: phys.sigma2(state(x, f"temp_{z}m"), state(x, f"salin_{z}m")) for z in steps.levels}
        total = lambda of: functools.reduce(Column.__add__, of)
        w = {z: F.greatest(d, F.lit(0.0)) for z, d in dp.items()}
        whole = F.greatest(total(w.values()), F.lit(1e-6))
        flow = {v: total(state(x, f"{v}_{z}m") * w[z] for z in steps.levels) / whole for v in "uv"}
        thick = {a: (dp[a] > REAL) & (dp[b] > REAL) for a, b in layers}
        falls = total((thick[a] & (rho[b] < rho[a] - FALL)).cast("int") for a, b in layers)
        surface = total((state(x, f"{v}_0m") + state(x, f"{v}baro")) ** 2 for v in "uv")
        error = total(dp.values()) - total(thickness("truth", z) for z in steps.levels)
        spread = [F.when(F.count_if(dp[z] > SPREAD) > least_cells, F.percentile(F.when(dp[z] > SPREAD, rho[z]), 0.75) - F.percentile(F.when(dp[z] > SPREAD, rho[z]), 0.25)) for z in steps.levels]
        row = steps.cells.where("region").groupBy(*KEYS).agg(
            F.avg(total((d < NEGATIVE).cast("double") for d in dp.values()) / len(dp)).alias("neg_thk_frac"), F.min(F.least(*dp.values())).alias("neg_thk_min"), F.sqrt(F.avg(error * error)).alias("col_err_m"),
            (F.sum(falls) / F.greatest(F.sum(total(t.cast("int") for t in thick.values())), F.lit(1))).alias("inversion_frac"), F.sqrt(F.avg(flow["u"] ** 2 + flow["v"] ** 2)).alias("baro_resid"), F.avg(surface).alias("ke"), F.array_sort(F.array_compact(F.array(*spread))).alias("__spread"),
        )
        n, at = F.size("__spread"), lambda k: F.try_element_at("__spread", k.cast("int"))  # noqa: B023
        middle = (at(F.floor((n + 1) / 2)) + at(F.ceil((n + 1) / 2))) / 2
        parts.append(row.withColumn("iso_spread", F.when(n > 0, middle)).drop("__spread").withColumn("who", F.lit(who)))
    return functools.reduce(DataFrame.unionByName, parts)


def field_numbers(steps: Steps, fields: dict[str, Callable[[str], Column]], changes: list[str], slopes: list[str], bands: list[str]) -> DataFrame:
    """(start, lead, who, lap_<field>..., grad_<field>..., band_<field>...) over the cells whose four neighbours are in the region too.

    changes: fields whose change from the start has its Laplacian taken; slopes: those whose gradient is; bands: those
    whose change is taken between two scales. The region's outside stays out of everything.
    """
    size = steps.image(steps.place.region).shape
    inside = F.when(F.col("region"), True)
    states = F.array(*(F.struct(F.lit(who).alias("who"), *(fields[f](x).alias(f) for f in fields), *((fields[f](x) - fields[f]("x0")).alias(f"d_{f}") for f in dict.fromkeys((*changes, *bands)))) for who, x in WHO.items()))
    rows = steps.cells.select(*KEYS, "y", "x", "region", F.inline(states)).withColumn("inside", inside)
    by = [*KEYS, "who"]
    smooth = grids.smoothed_by(rows, by, {f"d_{f}": "region" for f in bands}, BAND, 4.0, 0.0, size)
    rows = rows.join(smooth, [*by, "y", "x"])
    rows = rows.withColumns({f: F.when(F.col("region"), F.col(f)) for f in (*(f"d_{c}" for c in changes), *slopes)})
    held = F.struct("y", "x", "inside", *dict.fromkeys((*(f"d_{c}" for c in changes), *slopes)))
    beside = {}
    for axis, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(*by, other).orderBy(axis)
        for name, there, step in ((f"before_{axis}", F.lag(held).over(w), -1), (f"after_{axis}", F.lead(held).over(w), 1)):
            rows = rows.withColumn(name, F.when(there[axis] == F.col(axis) + step, there))
            beside[name] = F.col(name)
    rows = rows.where(functools.reduce(Column.__and__, (b["inside"].isNotNull() for b in beside.values()), F.col("region")))
    lap = lambda f: sum((b[f] for b in beside.values()), F.lit(0.0)) - 4 * F.col(f)
    slope = lambda f: F.hypot(beside["after_x"][f] - beside["before_x"][f], beside["after_y"][f] - beside["before_y"][f]) / 2
    out = {f"lap_{f}": F.sqrt(F.avg(lap(f"d_{f}") ** 2)) for f in changes} | {f"grad_{f}": F.avg(slope(f)) for f in slopes}
    out |= {f"band_{f}": F.sqrt(F.avg((F.col(f"d_{f}_fine") - F.col(f"d_{f}_coarse")) ** 2)) for f in bands}
    return rows.groupBy(*by).agg(*(v.alias(n) for n, v in out.items()))
