"""Stencils, smoothing, fronts and distances on images in long form (by..., y, x, value); invalid is null.

Neighbours come from windows along a row or a column; smoothing takes rows, then columns, each once as arrays;
nothing is paired with every other cell.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .selection import quantiles

#: Earth's radius in m, its rotation in 1/s, gravity in m/s².
RADIUS, OMEGA, GRAVITY = 6371e3, 7.2921e-5, 9.81


def beside(value: Column, by: list[str], axis: str, other: str, step: int) -> Column:
    """The value ``step`` cells on along ``axis``; null outside the grid or where the cell is missing."""
    w = Window.partitionBy(*by, other).orderBy(axis)
    at = F.lead(axis, step).over(w) if step > 0 else F.lag(axis, -step).over(w)
    there = F.lead(value, step).over(w) if step > 0 else F.lag(value, -step).over(w)
    return F.when(at == F.col(axis) + step, there)


def centred(value: Column, by: list[str], axis: str, other: str, spacing: Column) -> Column:
    """Difference of the two neighbours over the distance between them; null unless the cell and both are valid."""
    d = beside(value, by, axis, other, 1) - beside(value, by, axis, other, -1)
    return F.when(value.isNotNull(), d / spacing)


def laplacian(value: str, by: list[str]) -> Column:
    """The five-point Laplacian; null unless all five are valid."""
    v = F.col(value)
    around = [beside(v, by, a, o, s) for a, o in (("x", "y"), ("y", "x")) for s in (1, -1)]
    return sum(around[1:], around[0]) - 4 * v


def kernel(sigma: float, truncate: float = 3.0) -> dict[int, float]:
    """Gaussian weights by offset, summing to 1."""
    r = max(1, math.ceil(truncate * sigma))
    w = {o: math.exp(-0.5 * (o / sigma) ** 2) for o in range(-r, r + 1)}
    total = sum(w.values())
    return {o: x / total for o, x in w.items()}


def _lines(lists: list[pa.ListArray], at: pa.ListArray, from_zero: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Lines of cells as rows of matrices: each cell's line, its column, and each list's values there, NaN where there is none.

    A line's first cell, or the cell at 0, is in column 0.
    """
    sizes = np.diff(at.offsets.to_numpy())
    line, place = np.repeat(np.arange(len(at)), sizes), at.flatten().to_numpy()
    column = place if from_zero else place - np.repeat(place[np.cumsum(sizes) - sizes], sizes)
    out = []
    for values in lists:
        grid = np.full((len(at), int(column.max()) + 1), np.nan)
        grid[line, column] = values.flatten().to_numpy(zero_copy_only=False).astype(float)
        out.append(grid)
    return line, column, out


def _convolved(a: np.ndarray, weights: dict[int, float], size: int | None) -> np.ndarray:
    """Each row's weighted sums; with ``size`` rows go on mirrored at their edges, else as zeros."""
    r, n = max(weights), a.shape[1]
    if size is not None:
        there = np.arange(-r, size + r) % (2 * size)
        padded = np.concatenate([a, np.zeros((len(a), size - n))], 1)[:, np.minimum(there, 2 * size - 1 - there)]
        n = size
    else:
        padded = np.pad(a, ((0, 0), (r, r)))
    return sum(w * padded[:, r + o : r + o + n] for o, w in weights.items())[:, : a.shape[1]]


def _along(df: DataFrame, by: list[str], axis: str, other: str, columns: list[str], made: dict[str, Callable[[dict], np.ndarray]], kept: list[str], from_zero: bool) -> DataFrame:
    """(by..., other, axis, kept..., made...): each line of an image once, as arrays; a line is the most that is held."""
    lines = df.groupBy(*by, other).agg(F.array_sort(F.collect_list(F.struct(axis, *columns))).alias("__line"))
    lines = lines.select(*by, other, *(F.col(f"__line.{c}").alias(f"__{k}") for k, c in enumerate([axis, *columns])))
    keys = [*by, other]
    out = StructType([*(lines.schema[k] for k in keys), StructField(axis, df.schema[axis].dataType), *(StructField(c, DoubleType()) for c in (*kept, *made))])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, *lists = (batch.column(len(keys) + k) for k in range(1 + len(columns)))
            if not len(at):
                continue
            line, column, grids = _lines(lists, at, from_zero)
            named = dict(zip(columns, grids, strict=True))
            index = pa.array(line)
            results = [named[c][line, column] for c in kept] + [f(named)[line, column] for f in made.values()]
            doubles = [pa.array(v, mask=np.isnan(v)) for v in results]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in range(len(keys))), at.flatten(), *doubles], schema=schema)

    return lines.mapInArrow(run, out)


def smoothed_by(df: DataFrame, by: list[str], values: dict[str, str], sigmas: dict[str, float], truncate: float = 3.0, least: float = 0.5, size: tuple[int, int] | None = None) -> DataFrame:
    """(by..., y, x, value_scale...): Gaussian means of many values at many scales, over the cells where the value's mask holds.

    values: each value's mask, the name of a boolean column. Null where the mask doesn't hold or the weight in reach is
    below ``least``. With ``size`` (rows, columns) fields are mirrored at their edges, else there is nothing beyond.
    Two shuffles of the data itself: rows as arrays, then columns as arrays.
    """
    masks, weights = sorted(set(values.values())), {s: kernel(sigma, truncate) for s, sigma in sigmas.items()}
    valid = {m: F.col(m).cast("double").alias(m) for m in masks}
    cells = df.select(*by, "y", "x", *(F.coalesce(F.when(F.col(m), F.col(v).cast("double")), F.lit(0.0)).alias(v) for v, m in values.items()), *valid.values())
    rows, columns = size if size else (None, None)

    def smooth(name: str, w: dict[int, float], n: int | None):
        return lambda grids: _convolved(np.nan_to_num(grids[name]), w, n)

    across = {f"{c}__{s}": smooth(c, w, columns) for c in (*values, *masks) for s, w in weights.items()}
    lines = _along(cells, by, "x", "y", [*values, *masks], across, masks, size is not None)

    def mean(value: str, mask: str, s: str):
        def f(grids: dict) -> np.ndarray:
            num = smooth(f"{value}__{s}", weights[s], rows)(grids)
            if (mask, s) not in grids:
                grids[mask, s] = smooth(f"{mask}__{s}", weights[s], rows)(grids)
            den = grids[mask, s]
            return np.where((grids[mask] > 0) & (den >= least) & (den > 0), num / np.where(den > 0, den, 1), np.nan)

        return f

    down = {f"{v}_{s}": mean(v, m, s) for v, m in values.items() for s in weights}
    return _along(lines, by, "y", "x", [*masks, *across], down, [], size is not None)


def smoothed(df: DataFrame, by: list[str], value: str, sigma: float, truncate: float = 3.0, least: float = 0.5, size: tuple[int, int] | None = None) -> DataFrame:
    """(by..., y, x, value): ``smoothed_by`` of one value at one scale, over its valid cells."""
    rows = df.select(*by, "y", "x", value, F.col(value).isNotNull().alias("__valid"))
    return smoothed_by(rows, by, {value: "__valid"}, {"s": sigma}, truncate, least, size).withColumnRenamed(f"{value}_s", value)


#: Cells times values that an image's smoothing takes at once.
AT_ONCE = 1 << 20


def smoothed_images(df: DataFrame, by: list[str], values: dict[str, str], sigmas: dict[str, float], slopes: dict[str, str], truncate: float = 3.0, least: float = 0.5) -> DataFrame:
    """``smoothed_by``, nothing being beyond the edges, with value_d<axis>_scale: the difference of a mean's two neighbours along each axis of ``slopes``; null unless the cell and both have one.

    An image is a group, and the most that is held, so rows that lie by (some of) ``by`` already aren't shuffled again.
    """
    masks, weights = sorted(set(values.values())), {s: kernel(sigma, truncate) for s, sigma in sigmas.items()}
    cells = df.select(*by, "y", "x", *(F.coalesce(F.when(F.col(m), F.col(v).cast("double")), F.lit(0.0)).alias(v) for v, m in values.items()), *(F.coalesce(m, F.lit(False)).cast("double").alias(m) for m in masks))
    names = [n for s in weights for v in values for n in (f"{v}_{s}", *(f"{v}_d{a}_{s}" for a in slopes.get(v, "")))]
    out = StructType([*(cells.schema[k] for k in (*by, "y", "x")), *(StructField(n, DoubleType()) for n in names)])
    schema, order = to_arrow_schema(out), list(values)

    def both(a: np.ndarray, w: dict[int, float]) -> np.ndarray:
        """Images' (n, y, x) weighted sums along rows, then along columns."""
        n, ny, nx = a.shape
        across = _convolved(a.reshape(n * ny, nx), w, None).reshape(n, ny, nx).transpose(0, 2, 1)
        return _convolved(across.reshape(n * nx, ny), w, None).reshape(n, nx, ny).transpose(0, 2, 1)

    def run(image: pa.Table) -> pa.Table:
        place = [image.column(c).to_numpy() for c in ("y", "x")]
        y, x = (p - p.min() for p in place)

        def grids_of(some: list[str]) -> np.ndarray:
            a = np.zeros((len(some), int(y.max()) + 1, int(x.max()) + 1))
            for k, c in enumerate(some):
                a[k, y, x] = image.column(c).to_numpy()
            return np.nan_to_num(a, copy=False)

        there, found = grids_of(masks), {}
        reach = {s: both(there, w) for s, w in weights.items()}
        many = max(1, AT_ONCE // there[0].size)
        for first in range(0, len(order), many):
            some = order[first : first + many]
            at, raw = [masks.index(values[v]) for v in some], grids_of(some)
            for s, w in weights.items():
                den = reach[s][at]
                mean = np.where((there[at] > 0) & (den >= least) & (den > 0), both(raw, w) / np.where(den > 0, den, 1), np.nan)
                found |= zip((f"{v}_{s}" for v in some), mean[:, y, x], strict=True)
                for axis in "xy":
                    sloped = [k for k, v in enumerate(some) if axis in slopes.get(v, "")]
                    m = mean[sloped] if axis == "x" else mean[sloped].transpose(0, 2, 1)
                    d = np.full(m.shape, np.nan)
                    d[:, :, 1:-1] = np.where(np.isnan(m[:, :, 1:-1]), np.nan, m[:, :, 2:] - m[:, :, :-2])
                    found |= zip((f"{some[k]}_d{axis}_{s}" for k in sloped), d[:, y, x] if axis == "x" else d[:, x, y], strict=True)
        doubles = [pa.array(found[n], mask=np.isnan(found[n])) for n in names]
        return pa.Table.from_arrays([*(image.column(c) for c in (*by, "y", "x")), *doubles], schema=schema)

    return cells.groupBy(*by).applyInArrow(run, out)


def front_edges(df: DataFrame, by: list[str], speed: str, region: str, threshold: float) -> DataFrame:
    """``df`` with ``edge``: fast, in the region and not surrounded by fast cells; null, NaN and outside are slow."""
    fast = F.coalesce((F.col(speed) >= threshold) & ~F.isnan(speed), F.lit(False))
    rows = df.withColumn("__fast", fast)
    near = [F.coalesce(beside(F.col("__fast"), by, a, o, s), F.lit(False)) for a, o in (("x", "y"), ("y", "x")) for s in (1, -1)]
    inner = near[0] & near[1] & near[2] & near[3]
    return rows.withColumn("edge", F.col("__fast") & ~inner & F.col(region)).drop("__fast")


def _along_rows(xs: list[np.ndarray], above: list[np.ndarray]) -> list[np.ndarray]:
    """For each row of an image (its columns, and each column's distance to a member within it): the distance to the nearest member.

    Rows of one extent are worked on together. A member dx columns off is at least dx away, so
    dx grows only up to the largest distance that is left.
    """
    out: list = [None] * len(xs)
    extents: dict[tuple[int, int], list[int]] = {}
    for k, x in enumerate(xs):
        extents.setdefault((int(x.min()), int(x.max())), []).append(k)
    for (first, last), rows in extents.items():
        d = np.full((len(rows), last - first + 1), np.inf)
        for r, k in enumerate(rows):
            d[r, xs[k] - first] = np.square(above[k])
        g = d.copy()
        some = np.isfinite(g).any(1)
        for dx in range(1, g.shape[1]):
            if not some.any() or dx * dx >= d[some].max():
                break
            np.minimum(d[:, dx:], g[:, :-dx] + dx * dx, out=d[:, dx:])
            np.minimum(d[:, :-dx], g[:, dx:] + dx * dx, out=d[:, :-dx])
        for r, k in enumerate(rows):
            out[k] = np.sqrt(d[r, xs[k] - first])
    return out


@F.pandas_udf(ArrayType(DoubleType()))
def _row_distances(xs: pd.Series, above: pd.Series) -> pd.Series:
    return pd.Series(_along_rows([np.asarray(x, int) for x in xs], [np.asarray(g, float) for g in above]), dtype=object)


def distance_to(df: DataFrame, by: list[str], member: str, none: float | None = None) -> DataFrame:
    """``df`` (by..., y, x, member; every row of a field has all its columns) with ``distance`` in cells to the nearest member of its field, exactly; ``none`` if it has none.

    First the nearest member within each column, by windows; then each row, held once as arrays, takes the least of
    sqrt(dx² + column distance²): a row or a column of an image is the most that is held, and there are three shuffles.
    """
    up, down = Window.partitionBy(*by, "x").orderBy("y"), Window.partitionBy(*by, "x").orderBy(F.desc("y"))
    at = F.when(F.col(member), F.col("y"))
    above, below = F.last(at, True).over(up), F.last(at, True).over(down)
    rest = [c for c in df.columns if c not in (*by, "y")]
    rows = df.withColumn("__g", F.coalesce(F.least(F.col("y") - above, below - F.col("y")).cast("double"), F.lit(math.inf)))
    lines = rows.groupBy(*by, "y").agg(F.collect_list(F.struct("__g", *rest)).alias("__line"))
    lines = lines.withColumn("__d", _row_distances(F.col("__line.x").cast("array<long>"), F.col("__line.__g")))
    cells = lines.select(*by, "y", F.explode(F.arrays_zip("__line", "__d")).alias("__cell"))
    far = F.col("__cell.__d") == math.inf
    return cells.select(*by, "y", *(F.col(f"__cell.__line.{c}").alias(c) for c in rest), F.when(far, F.lit(none).cast("double")).otherwise(F.col("__cell.__d")).alias("distance")).select(*df.columns, "distance")


def front_loss(df: DataFrame, by: list[str], pred: str, truth: str, region: str, cell_km: str, threshold: float, tau: float = 0.05, alpha: float = 2.0) -> DataFrame:
    """(by..., loss): the mean over the region of (p - q)² (d_q^alpha + d_p^alpha).

    q: whether the true speed reaches the threshold, p: the sigmoid of the predicted one's excess over ``tau``; d_q and
    d_p: km to the true and to the predicted front, 0 where there is no front.
    """
    slow = lambda c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(-math.inf))
    rows = df.select(*by, "y", "x", F.col(region).alias("region"), F.col(cell_km).alias("km"), F.col(pred).alias("s"), F.col(truth).alias("t"))
    for speed in ("t", "s"):
        rows = distance_to(front_edges(rows, by, speed, "region", threshold), by, "edge", 0.0).withColumn(f"d{speed}", F.col("distance") * F.col("km")).drop("edge", "distance")
    p, q = 1 / (1 + F.exp(-(F.col("s") - threshold) / tau)), (slow("t") >= threshold).cast("double")
    return rows.where("region").groupBy(*by).agg(F.avg((p - q) ** 2 * (F.col("dt") ** alpha + F.col("ds") ** alpha)).alias("loss"))


def directed_distances(df: DataFrame, by: list[str], a: str, b: str, cell_km: str) -> DataFrame:
    """(by..., km): from each cell of a to the nearest of b, in the cell size where it is measured from."""
    return distance_to(df, by, b).where(a).select(*by, (F.col("distance") * F.col(cell_km)).alias("km"))


def front_distance(df: DataFrame, by: list[str], a: str, b: str, cell_km: str, tail: bool = True) -> DataFrame:
    """(by..., status, mean_km, hausdorff_km, p95_km) of two sets of edges; both directions pooled. Without ``tail`` there is no p95_km."""
    both = directed_distances(df, by, a, b, cell_km).union(directed_distances(df, by, b, a, cell_km))
    got = both.groupBy(*by).agg(F.avg("km").alias("mean_km"), F.max("km").alias("hausdorff_km"))
    if tail:
        got = got.join(quantiles(both, by, {"p95_km": (F.col("km"), 0.95)}), by)
    n = df.groupBy(*by).agg(F.count_if(a).alias("na"), F.count_if(b).alias("nb"))
    status = F.when((F.col("na") == 0) & (F.col("nb") == 0), "both_empty").when(F.col("na") == 0, "pred_empty").when(F.col("nb") == 0, "true_empty").otherwise("ok")
    ok = lambda c: F.when(F.col("status") == "ok", F.col(c)).alias(c)
    return n.join(got, by, "left").withColumn("status", status).select(*by, "status", *(ok(c) for c in got.columns if c not in by))


def tiled(df: DataFrame, tile: int, halo: int) -> DataFrame:
    """Each cell in every tile whose square or halo holds it: (ty, tx, y, x, ..., inner); a tile is then one group of bounded size."""
    def tiles(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))

    rows = df.withColumn("ty", F.explode(tiles("y"))).withColumn("tx", F.explode(tiles("x")))
    return rows.withColumn("inner", (F.floor(F.col("y") / tile) == F.col("ty")) & (F.floor(F.col("x") / tile) == F.col("tx")))


def bilinear(points: DataFrame, grid: DataFrame, spacing: float, lat: str = "lat", lon: str = "lon", value: str = "v", outside: str = "raise") -> DataFrame:
    """``points`` with ``got``, the bilinear value of a regular global-longitude grid (i, j, value) whose node (i, j) lies at (i, j) * spacing.

    Longitudes wrap by 360. Each node goes to the four squares that it is a corner of, so a point joins its square once;
    points may repeat. A corner without weight doesn't matter; a null corner makes null; a missing one raises, or makes
    null with ``outside`` "null".
    """
    around = round(360 / spacing)
    fy, fx = F.col(lat) / spacing, F.pmod(F.col(lon), F.lit(360.0)) / spacing
    corners = F.array(*(F.struct((F.col("i") - dy).cast("long").alias("__y"), F.pmod(F.col("j") - dx, F.lit(around)).cast("long").alias("__x"), F.lit(2 * dy + dx).alias("__c")) for dy in (0, 1) for dx in (0, 1)))
    squares = grid.select(F.inline(corners), F.struct(F.col(value).alias("v")).alias("__v"))
    squares = squares.groupBy("__y", "__x").agg(*(F.first(F.when(F.col("__c") == k, F.col("__v")), True).alias(f"__v{k}") for k in range(4)))
    rows = points.withColumns({"__y": F.floor(fy), "__x": F.pmod(F.floor(fx), F.lit(around)).cast("long"), "__a": fy - F.floor(fy), "__b": fx - F.floor(fx)})
    a, b = F.col("__a"), F.col("__b")
    weights = [(a if dy else 1 - a) * (b if dx else 1 - b) for dy in (0, 1) for dx in (0, 1)]
    rows = rows.join(squares, ["__y", "__x"], "left")
    got = sum((F.when(w > 0, w * F.col(f"__v{k}.v")).otherwise(0.0) for k, w in enumerate(weights)), F.lit(0.0))
    missing = functools.reduce(operator.or_, ((w > 0) & F.col(f"__v{k}").isNull() for k, w in enumerate(weights)))
    if outside == "raise":
        got = F.when(missing, F.raise_error(F.concat(F.lit("outside the grid: "), F.col(lat).cast("string"), F.lit(", "), F.col(lon).cast("string"))).cast("double")).otherwise(got)
    return rows.select(*points.columns, got.alias("got"))
