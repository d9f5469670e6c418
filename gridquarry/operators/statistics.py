"""Statistics of forecast steps, in families that share what they compute.

A step is one lead of one start: an image with a struct of channels for each of the states ``pred``, ``truth``, ``x0``
(the truth at the start) and the states a day earlier, ``pred_prev`` and ``truth_prev``. Each statistic belongs to a
family, each family names the channels that it needs. The channels that the chosen statistics need are read
once and stored; what several statistics use (images, fronts, balances) is one plan each; families are joined on (start, lead).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import physics as phys
from ..shared import cut
from . import grids, spectra
from .topology import labels

#: Variables on levels, all fields, channels with means and with spectra, scales in km, depths of
#: vorticity and of shear, units.
LEVEL_VARS = ("temp", "salin", "u", "v")
FIELDS = (*LEVEL_VARS, "ssh")
MEANS = ("temp_0m", "temp_100m", "salin_0m", "ssh")
SPECTRA = ("ssh", "temp_100m")
SCALES_KM = {"s15": 15.0, "s50": 50.0}
VORTICITY = (0, 100)
SHEAR = ((100, 200), (200, 500))
TIES = ("geo", *(f"tw_{a}m_{b}m" for a, b in SHEAR), "cont")
UNITS = {"temp": "degC", "salin": "psu", "u": "m/s", "v": "m/s", "ssh": "m"}
#: The front's speed in m/s; the level in m, least depth in m and least area in km² of main piece and eddies;
#: density in kg/m³, seconds of a day, the density in kg/m³ that an inversion loses; metres to which columns reach.
FRONT_MS, PIECE_LEVEL, PIECE_DEPTH, EDDY_KM2, RHO0, DAY_S, INVERSION, BOTTOM = 0.7717, 0.17, 500.0, 1000.0, 1025.0, 86400.0, 0.01, 2000.0
#: What a state is called in names of statistics.
WHO = {"model": "pred", "truth": "truth"}
KEYS = ["start", "lead"]


@dataclass(frozen=True)
class Statistic:
    """One number for each start and lead: its family, its units, what it says."""

    family: str
    units: str
    meaning: str


@dataclass
class Steps:
    """Steps (start, lead, y, x, a struct of channels for each state) on a fixed grid.

    grid: for each (y, x) lon, lat, depth, area (the weight), region, whether it is sea at each level (``sea_<depth>m``),
    front and deep (regions of the front and of the main piece), strip (where the main piece is sought). It is of
    one image's size, so masks are taken to the driver and joins are left to Spark's size check. kept: the rows lie by
    start and are made of stored days, so each plan makes them anew and they are not stored cell by cell; their channels
    are columns <state>_<channel> in place of structs, so that a plan makes only those that it needs.
    """

    rows: DataFrame
    grid: DataFrame
    levels: tuple[int, ...]
    spacing: float  # degrees
    kept: bool = False
    shared: dict[str, DataFrame] = field(default_factory=dict)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A step that several statistics share, planned and stored once."""
        if name not in self.shared:
            self.shared[name] = cut(make())
        return self.shared[name]

    @functools.cached_property
    def place(self) -> pd.DataFrame:
        return self.grid.orderBy("y", "x").toPandas()

    def image(self, values: pd.Series) -> np.ndarray:
        """Of a value of the grid's cells, which are a whole rectangle."""
        return values.to_numpy().reshape(self.place.y.nunique(), -1)

    def weight(self, channel: str) -> Column:
        """Area where the channel is real and scored."""
        depth = channel.partition("_")[2]
        return F.when(F.col("region") & (F.col(f"sea_{depth}") if depth else F.lit(True)), F.col("area")).otherwise(0.0)

    def thickness(self) -> dict[int, float]:
        """Metres of the column that each level stands for."""
        edges = [0.0, *((a + b) / 2 for a, b in zip(self.levels, self.levels[1:], strict=False)), BOTTOM]
        return {z: b - a for z, a, b in zip(self.levels, edges[:-1], edges[1:], strict=True)}

    @property
    def cells(self) -> DataFrame:
        return self.shared["cells"]

    @property
    def sigmas(self) -> dict[str, float]:
        """The scales in cells: over the mean of the sides of the inner cells."""
        lat = np.radians(self.image(self.place.lat))[1:-1, 1:-1]
        side = float(np.mean(np.sqrt(np.cos(lat)))) * np.radians(self.spacing) * grids.RADIUS
        return {s: km * 1000 / side for s, km in SCALES_KM.items()}


def state(who: str, channel: str) -> Column:
    return F.col(f"{who}_{channel}")


# Fields: weighted sums that are combined before the shuffle


def _field_channels(steps: Steps) -> dict[str, list[tuple[str, Column]]]:
    """Each field's channels with their weights."""
    out = {v: [(f"{v}_{z}m", steps.weight(f"{v}_{z}m") * dz) for z, dz in steps.thickness().items()] for v in LEVEL_VARS}
    return out | {"ssh": [("ssh", steps.weight("ssh"))]}


def fields_family(steps: Steps, chosen: list[str]) -> DataFrame:
    """Errors and biases of model and persistence, and the correlation of the day's change, by field; means, energy and the largest speed."""
    values = {"e": ("pred", "truth"), "p": ("x0", "truth"), "a": ("pred", "pred_prev"), "b": ("truth", "truth_prev")}
    channels = [F.struct(F.lit(f).alias("field"), w.alias("w"), *((state(x, c) - state(y, c)).alias(n) for n, (x, y) in values.items())) for f, some in _field_channels(steps).items() for c, w in some]
    w, e, p, a, b = (F.col(c) for c in "wepab")
    sums = {"w": w, "e": w * e, "ee": w * e * e, "p": w * p, "pp": w * p * p, "a": w * a, "aa": w * a * a, "b": w * b, "bb": w * b * b, "ab": w * a * b}
    each = steps.cells.select(*KEYS, F.inline(F.array(*channels))).groupBy(*KEYS, "field").agg(*(F.sum(c).alias(f"s_{n}") for n, c in sums.items()))
    s = lambda n: F.col(f"s_{n}")
    about = lambda xy, x, y: s(xy) - s(x) * s(y) / s("w")
    spread = about("aa", "a", "a") * about("bb", "b", "b")
    made = {"rmse": F.sqrt(s("ee") / s("w")), "bias": s("e") / s("w"), "rmse_pers": F.sqrt(s("pp") / s("w")), "bias_pers": s("p") / s("w"), "corr_change": F.when(spread > 0, about("ab", "a", "b") / F.sqrt(spread))}
    by_field = each.groupBy(*KEYS).agg(*(F.max(F.when(F.col("field") == f, v)).alias(f"{n}_{f}") for (n, v), f in product(made.items(), FIELDS)))
    whole = {}
    for who, x in WHO.items():
        whole |= {f"mean_{c}_{who}": F.sum(steps.weight(c) * state(x, c)) / F.sum(steps.weight(c)) for c in MEANS}
        energy = sum((steps.weight(f"u_{z}m") * dz * (state(x, f"u_{z}m") ** 2 + state(x, f"v_{z}m") ** 2) / 2 for z, dz in steps.thickness().items()), F.lit(0.0))
        whole |= {f"ke_{who}": F.sum(energy) / F.sum(F.when(F.col("region"), F.col("area"))), f"maxspeed_{who}": F.max(F.when(F.col("region"), _speed(x)))}
    return by_field.join(steps.cells.groupBy(*KEYS).agg(*(v.alias(n) for n, v in whole.items())), KEYS).select(*KEYS, *chosen)


def _speed(who: str) -> Column:
    return F.sqrt(state(who, "u_0m") ** 2 + state(who, "v_0m") ** 2)


# Images held as arrays: spectra and the main piece


def _images(steps: Steps) -> DataFrame:
    """(start, lead, channel, who, v): the whole image of a channel as one array, by rows."""
    some = [F.struct(F.lit(c).alias("channel"), F.lit(who).alias("who"), state(x, c).alias("h")) for c in SPECTRA for who, x in WHO.items()]
    cells = steps.cells.select(*KEYS, "y", "x", F.inline(F.array(*some)))
    return cells.groupBy(*KEYS, "channel", "who").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "h"))), lambda c: c.h).alias("v"))


def spectra_family(steps: Steps, chosen: list[str]) -> DataFrame:
    """Variance by wavelength band within each channel's region, tapered over the regions' common box."""
    images, place = steps.once("images", lambda: _images(steps)), steps.place
    masks = {c: steps.image(place.region & (place[f"sea_{c.partition('_')[2]}"] if "_" in c else True)) for c in SPECTRA}
    either = np.logical_or.reduce(list(masks.values()))
    box = tuple(slice(int(k.min()), int(k.max()) + 1) for k in np.nonzero(either))
    side = float((steps.spacing * phys.KM_A_DEGREE * np.cos(np.radians(steps.image(place.lat))))[either].mean())
    parts = [spectra.band_variances(images.where(F.col("channel") == c), "start long, lead int, channel string, who string", either.shape, side, mask=masks[c], box=box) for c in SPECTRA]
    bands = functools.reduce(DataFrame.unionByName, parts)
    got = {(c, k, who): F.max(F.when((F.col("channel") == c) & (F.col("who") == who), F.col(f"b{k}"))) for c in SPECTRA for k in range(len(spectra.BANDS)) for who in WHO}
    names = {(c, k): f"spec_{c}_{band}" for c in SPECTRA for k, band in enumerate(spectra.BANDS)}
    values = {f"{n}_{who}": got[(*at, who)] for at, n in names.items() for who in WHO} | {f"{n}_ratio": F.try_divide(got[(*at, "model")], got[(*at, "truth")]) for at, n in names.items()}
    return bands.groupBy(*KEYS).agg(*(values[n].alias(n) for n in chosen))


def pieces(ssh: np.ndarray, deep: np.ndarray, strip: np.ndarray, lat: np.ndarray, km2: np.ndarray) -> tuple[float | None, int, float]:
    """(northern end, number of eddies, area) of what lies above the level over deep water: the piece most frequent on the strip, and the other large ones."""
    high = deep & (ssh - np.average(ssh[deep], weights=km2[deep]) >= PIECE_LEVEL)
    found = labels(high)
    area = np.bincount(found.ravel(), km2.ravel())
    area[0] = 0.0
    seeds = found[strip & high]
    main = int(np.bincount(seeds).argmax()) if seeds.size else 0
    eddies = int((area >= EDDY_KM2).sum() - (main > 0 and area[main] >= EDDY_KM2))
    return (float(lat[found == main].max()), eddies, float(area[main])) if main else (None, eddies, 0.0)


def piece_family(steps: Steps, chosen: list[str]) -> DataFrame:
    """Northern end, eddies and area of the main piece of the sea surface."""
    images, place = steps.once("images", lambda: _images(steps)), steps.place
    deep, strip, lat = (steps.image(place[c]) for c in ("deep", "strip", "lat"))
    km2 = (steps.spacing * phys.KM_A_DEGREE * np.cos(np.radians(lat))) ** 2

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [pieces(np.asarray(v, float).reshape(lat.shape), deep, strip, lat, km2) for v in p["v"]]
            yield pd.concat([p[[*KEYS, "who"]].reset_index(drop=True), pd.DataFrame(rows, columns=["north", "lce", "area"], dtype=float)], axis=1)

    found = images.where("channel = 'ssh'").select(*KEYS, "who", "v").mapInPandas(run, "start long, lead int, who string, north double, lce double, area double")
    items = {(k, who): F.max(F.when(F.col("who") == who, F.when(~F.isnan(k), F.col(k)))) for k in ("north", "lce", "area") for who in WHO}
    values = {f"lc_{k}_{who}": v for (k, who), v in items.items()} | {"lc_north_error": items["north", "model"] - items["north", "truth"]}
    return found.groupBy(*KEYS).agg(*(values[n].alias(n) for n in chosen))


# Fronts


def fronts_family(steps: Steps, chosen: list[str]) -> DataFrame:
    """Mean and largest distance of the model's and of persistence's front to the truth's; null where one has none."""
    speeds = {"model": "pred", "pers": "x0", "truth": "truth"}
    rows = steps.cells.select(*KEYS, "y", "x", "front", phys.cell_km(F.col("lat"), steps.spacing).alias("km"), *(_speed(x).alias(f"speed_{n}") for n, x in speeds.items()))
    for n in speeds:
        rows = grids.front_edges(rows, KEYS, f"speed_{n}", "front", FRONT_MS).withColumnRenamed("edge", n).drop(f"speed_{n}")
    rows = cut(rows).repartition(*KEYS)
    parts = [grids.front_distance(rows, KEYS, n, "truth", "km", tail=False).select(*KEYS, F.col("mean_km").alias(f"front_mean_km_{n}"), F.col("hausdorff_km").alias(f"front_hausdorff_km_{n}")) for n in ("model", "pers")]
    return parts[0].join(parts[1], KEYS).select(*KEYS, *chosen)


# Scale-space operators and balances


def _slopes() -> dict[str, str]:
    """The axes along which each smoothed value's derivative is taken."""
    out = {f"{v}{z}": "xy" if z == 0 else other for v, other in (("u", "y"), ("v", "x")) for z in VORTICITY}
    return out | {"ssh": "xy", "hu": "x", "hv": "y"} | {f"rho{a}": "xy" for a, _ in SHEAR}


def _balances(steps: Steps) -> DataFrame:
    """(start, lead, scale, region, ...): each cell's operators of the smoothed states, vorticity, divergence, and both sides of each tie; null where they don't hold."""
    values: dict[str, tuple[str, Column]] = {}
    for x in WHO.values():
        c, before = functools.partial(state, x), functools.partial(state, f"{x}_prev")
        flow = {f"{v}{z}": (f"sea_{z}m", c(f"{v}_{z}m")) for v, z in product("uv", VORTICITY)}
        surface = {"ssh": ("sea_0m", c("ssh")), "rise": ("sea_0m", (c("ssh") - before("ssh")) / DAY_S)}
        transport = {f"h{v}": ("sea_0m", F.col("depth") * (c(f"{v}baro") + before(f"{v}baro")) / 2) for v in "uv"}
        values |= {f"{x}_{n}": v for n, v in (flow | surface | transport).items()}
        for a, b in SHEAR:
            rho = (phys.sigma2(c(f"temp_{a}m"), c(f"salin_{a}m")) + phys.sigma2(c(f"temp_{b}m"), c(f"salin_{b}m"))) / 2
            shear = {f"{v}z{a}": (f"both_{a}", (c(f"{v}_{a}m") - c(f"{v}_{b}m")) / (b - a)) for v in "uv"}
            values |= {f"{x}_{n}": v for n, v in (shear | {f"rho{a}": (f"both_{a}", rho)}).items()}
    rows = steps.cells.withColumns({f"both_{a}": F.col(f"sea_{a}m") & F.col(f"sea_{b}m") for a, b in SHEAR})
    masks = sorted({m for m, _ in values.values()})
    slopes = {f"{x}_{n}": axes for x in WHO.values() for n, axes in _slopes().items()}
    smooth = grids.smoothed_images(rows.select(*KEYS, "y", "x", *masks, *(v.alias(n) for n, (_, v) in values.items())), KEYS, {n: m for n, (m, _) in values.items()}, steps.sigmas, slopes)
    place, by = steps.grid.select("y", "x", "lat", "region"), [*KEYS, "scale"]
    made = [*values, *(f"{n}_d{a}" for n, axes in slopes.items() for a in axes)]
    scales = F.array(*(F.struct(F.lit(s).alias("scale"), *(F.col(f"{n}_{s}").alias(n) for n in made)) for s in SCALES_KM))
    rows = smooth.select(*KEYS, "y", "x", F.inline(scales)).join(place, ["y", "x"])
    step = 2 * np.radians(steps.spacing) * grids.RADIUS
    sides = {"x": step * F.cos(F.radians("lat")), "y": F.lit(float(step))}

    def d(name: str, axis: str) -> Column:
        """The centred derivative; null unless the cell and both neighbours are valid."""
        return F.col(f"{name}_d{axis}") / sides[axis]

    f, tan_r = 2 * grids.OMEGA * F.sin(F.radians("lat")), F.tan(F.radians("lat")) / grids.RADIUS
    out = {}
    for x in WHO.values():
        n = lambda v: f"{x}_{v}"  # noqa: B023, E731
        divergence = lambda u, v: d(n(u), "x") + d(n(v), "y") - F.col(n(v)) * tan_r  # noqa: B023, E731
        for z in VORTICITY:
            out[n(f"zeta_{z}m")] = (d(n(f"v{z}"), "x") - d(n(f"u{z}"), "y") + F.col(n(f"u{z}")) * tan_r) / f
        out[n("div_0m")] = divergence("u0", "v0") / f
        pull = grids.GRAVITY / f
        sides_of = {"geo": ([F.col(n("u0")), F.col(n("v0"))], [-pull * d(n("ssh"), "y"), pull * d(n("ssh"), "x")])}
        for a, b in SHEAR:
            sides_of[f"tw_{a}m_{b}m"] = ([F.col(n(f"uz{a}")), F.col(n(f"vz{a}"))], [pull / RHO0 * d(n(f"rho{a}"), "y"), -pull / RHO0 * d(n(f"rho{a}"), "x")])
        sides_of["cont"] = ([F.col(n("rise"))], [-divergence("hu", "hv")])
        for tie, (left, right) in sides_of.items():
            rest = F.array(*(a - b for a, b in zip(left, right, strict=True)))
            whole = functools.reduce(Column.__and__, (a.isNotNull() & b.isNotNull() for a, b in zip(left, right, strict=True)))
            out[n(f"{tie}_lhs")], out[n(f"{tie}_residual")] = F.when(whole, F.array(*left)), F.when(whole, rest)
    return rows.select(*by, "region", *(v.alias(k) for k, v in out.items()))


def _rms(values: list[Column]) -> Column:
    """The root mean square length over the region's valid cells; 0 if there are none."""
    return F.sqrt(F.coalesce(F.avg(F.when(F.col("region"), sum((v * v for v in values[1:]), values[0] * values[0]))), F.lit(0.0)))


def operators_family(steps: Steps, chosen: list[str]) -> DataFrame:
    """Root mean squares of vorticity, divergence and of both sides of each tie; and of the model's minus the true residual."""
    parts = lambda name, tie: [F.col(name)[k] for k in range(1 if tie == "cont" else 2)]
    single = (*(f"zeta_{z}m" for z in VORTICITY), "div_0m")
    values = {}
    for who, x in WHO.items():
        values |= {(k, who): _rms([F.col(f"{x}_{k}")]) for k in single}
        values |= {(t, f"{part}_{who}"): _rms(parts(f"{x}_{t}_{part}", t)) for t in TIES for part in ("residual", "lhs")}
    for t in TIES:
        both = zip(*(parts(f"{x}_{t}_residual", t) for x in WHO.values()), strict=True)
        values[t, "error"] = _rms([a - b for a, b in both])
    each = _balances(steps).groupBy(*KEYS, "scale").agg(*(v.alias("_".join(k)) for k, v in values.items()))
    at = {f"op_{k}_{s}_{part}": F.max(F.when(F.col("scale") == s, F.col(f"{k}_{part}"))) for k, part in values for s in SCALES_KM}
    return each.groupBy(*KEYS).agg(*(at[n].alias(n) for n in chosen))


def inversions_family(steps: Steps, chosen: list[str]) -> DataFrame:
    """The share of neighbouring real levels at which density falls downward."""
    pairs = list(zip(steps.levels, steps.levels[1:], strict=False))
    real = {a: F.col("region") & F.col(f"sea_{a}m") & F.col(f"sea_{b}m") for a, b in pairs}
    n = F.sum(sum((r.cast("int") for r in real.values()), F.lit(0)))
    values = {}
    for who, x in WHO.items():
        rho = {z: phys.sigma2(state(x, f"temp_{z}m"), state(x, f"salin_{z}m")) for z in steps.levels}
        falls = sum(((real[a] & (rho[a] - rho[b] > INVERSION)).cast("int") for a, b in pairs), F.lit(0))
        values[f"op_inversions_{who}"] = F.try_divide(F.sum(falls), n)
    return steps.cells.groupBy(*KEYS).agg(*(values[k].alias(k) for k in chosen))


@dataclass(frozen=True)
class Family:
    """Statistics that are computed together, and the (state, channel) that they need."""

    plan: Callable[[Steps, list[str]], DataFrame]
    needs: Callable[[Steps], set[tuple[str, str]]]


def _of(states: tuple[str, ...], channels: tuple[str, ...]) -> set[tuple[str, str]]:
    return set(product(states, channels))


BOTH, EVERY = ("pred", "truth"), ("pred", "truth", "x0", "pred_prev", "truth_prev")
FAMILIES = {
    "fields": Family(fields_family, lambda s: _of(EVERY, ("ssh", *(f"{v}_{z}m" for v in LEVEL_VARS for z in s.levels)))),
    "spectra": Family(spectra_family, lambda s: _of(BOTH, SPECTRA)),
    "piece": Family(piece_family, lambda s: _of(BOTH, SPECTRA)),
    "fronts": Family(fronts_family, lambda s: _of((*BOTH, "x0"), ("u_0m", "v_0m"))),
    "operators": Family(
        operators_family,
        lambda s: _of(BOTH, tuple(f"{v}_{z}m" for v in "uv" for z in {*VORTICITY, *sum(SHEAR, ())})) | _of(BOTH, tuple(f"{v}_{z}m" for v in ("temp", "salin") for z in set(sum(SHEAR, ()))))
        | _of((*BOTH, "pred_prev", "truth_prev"), ("ssh", "ubaro", "vbaro")),
    ),
    "inversions": Family(inversions_family, lambda s: _of(BOTH, tuple(f"{v}_{z}m" for v in ("temp", "salin") for z in s.levels))),
}


def registry() -> dict[str, Statistic]:
    """All statistics by name; one more is one more entry, and a value in its family's plan."""
    out = {}
    for f in FIELDS:
        for tag, of in (("", "model"), ("_pers", "persistence")):
            out |= {f"{n}{tag}_{f}": Statistic("fields", UNITS[f], f"{meaning} of {f}, {of}") for n, meaning in (("rmse", "root mean square error"), ("bias", "mean error"))}
        out[f"corr_change_{f}"] = Statistic("fields", "1", f"correlation of the model's and the true change of {f} in a day")
    for who in WHO:
        out |= {f"mean_{c}_{who}": Statistic("fields", UNITS[c.partition("_")[0]], f"mean {c}, {who}") for c in MEANS}
        out[f"ke_{who}"] = Statistic("fields", "m3 s-2", f"kinetic energy of the column, {who}")
        out[f"maxspeed_{who}"] = Statistic("fields", "m/s", f"largest surface speed, {who}")
        out |= {f"lc_{k}_{who}": Statistic("piece", unit, f"main piece: {meaning}, {who}") for k, unit, meaning in (("north", "degrees_north", "northern end"), ("lce", "1", "number of eddies"), ("area", "km2", "area"))}
        out[f"op_inversions_{who}"] = Statistic("inversions", "1", f"share of level pairs whose density falls downward, {who}")
    for c, band, who in product(SPECTRA, spectra.BANDS, (*WHO, "ratio")):
        out[f"spec_{c}_{band}_{who}"] = Statistic("spectra", "1" if who == "ratio" else f"{UNITS[c.partition('_')[0]]}2", f"variance of {c}, wavelengths {band}, {who}")
    out["lc_north_error"] = Statistic("piece", "degrees_north", "main piece: northern end, model minus truth")
    for k, of in product(("mean", "hausdorff"), ("model", "pers")):
        out[f"front_{k}_km_{of}"] = Statistic("fronts", "km", f"{k} distance of the front to the true one, {of}")
    for s in SCALES_KM:
        for k, who in product((*(f"zeta_{z}m" for z in VORTICITY), "div_0m"), WHO):
            out[f"op_{k}_{s}_{who}"] = Statistic("operators", "1", f"root mean square of {k} over f at scale {s}, {who}")
        for t in TIES:
            unit = "1/s" if t.startswith("tw") else "m/s"
            out |= {f"op_{t}_{s}_{part}_{who}": Statistic("operators", unit, f"root mean square of the {part} of {t} at scale {s}, {who}") for part, who in product(("residual", "lhs"), WHO)}
            out[f"op_{t}_{s}_error"] = Statistic("operators", unit, f"root mean square of the model's minus the true residual of {t} at scale {s}")
    return out


def stored_cells(steps: Steps, needs: set[tuple[str, str]]) -> None:
    """The channels that are needed of each state beside the grid, as the step that all others share: read once and stored, unless the rows are."""
    channels = [F.col(f"{who}_{c}" if steps.kept else f"{who}.{c}").cast("double").alias(f"{who}_{c}") for who, c in sorted(needs)]
    rows = steps.rows.select(*KEYS, "y", "x", *channels).join(steps.grid, ["y", "x"])
    steps.shared["cells"] = rows if steps.kept else cut(rows)


def statistics(steps: Steps, chosen: list[str] | None = None, known: dict[str, Statistic] | None = None) -> DataFrame:
    """(start, lead, name...): the chosen statistics, or all, of every step.

    Only the families of the chosen ones are planned, and only the channels that these need are read.
    """
    known = known or registry()
    chosen = list(known) if chosen is None else chosen
    families = {f: [n for n in chosen if known[n].family == f] for f in FAMILIES}
    stored_cells(steps, set().union(*(FAMILIES[f].needs(steps) for f, names in families.items() if names)))
    parts = [FAMILIES[f].plan(steps, names) for f, names in families.items() if names]
    return functools.reduce(lambda a, b: a.join(b, KEYS, "left"), parts, steps.cells.select(*KEYS).distinct()).select(*KEYS, *chosen)
