"""Forecast scores: weighted sums first, then arithmetic on the sums."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .digests import heads
from .selection import placed

#: Sea water density and heat capacity.
RHO0, CP = 1025.0, 3990.0


def positive_root(x: Column) -> Column:
    return F.when(x > 0, F.sqrt(x))


def weighted_sums(df: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred", x0: str = "x0", w: str = "w") -> DataFrame:
    """Sums of w, we, we2 and of the changes a (truth - x0) and b (pred - x0): wa, wb, wa2, wb2, wab. They add up over any further grouping."""
    w, e = F.col(w), F.col(pred) - F.col(truth)
    a, b = F.col(truth) - F.col(x0), F.col(pred) - F.col(x0)
    terms = {"w": w, "we": w * e, "we2": w * e * e, "wp2": w * a * a, "wa": w * a, "wb": w * b, "wa2": w * a * a, "wb2": w * b * b, "wab": w * a * b}
    return df.groupBy(*by).agg(*(F.sum(t).alias(k) for k, t in terms.items()))


def change_correlation() -> Column:
    """Correlation of the two changes from weighted sums; null unless both vary."""
    w, wa, wb = F.col("w"), F.col("wa"), F.col("wb")
    spread = (F.col("wa2") - F.try_divide(wa * wa, w)) * (F.col("wb2") - F.try_divide(wb * wb, w))
    return F.try_divide(F.col("wab") - F.try_divide(wa * wb, w), positive_root(spread))


def scored(sums: DataFrame, by: list[str]) -> DataFrame:
    """rmse, rmse of persistence, bias and change correlation from ``weighted_sums``; null where no weight is."""
    w = F.col("w")
    return sums.select(*by, F.sqrt(F.try_divide("we2", w)).alias("rmse"), F.sqrt(F.try_divide("wp2", w)).alias("rmse_pers"), F.try_divide("we", w).alias("bias"), change_correlation().alias("corr_change"))


def combined(sums: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Weighted sums of levels combined into sums of their column: every sum, that of w too, times the level's weight."""
    names = ("w", "we", "we2", "wp2", "wa", "wb", "wa2", "wb2", "wab")
    return sums.groupBy(*by).agg(*(F.sum(F.col(k) * F.col(weight)).alias(k) for k in names))


def fair_crps(df: DataFrame, key: list[str], x: str = "x", y: str = "y", alpha: float | None = None, w: str | None = None) -> DataFrame:
    """Per key: members M, ensemble mean, sample variance and CRPS of the members against the truth; the sum of their weights if ``w`` names them.

    The pair term comes from the sorted members: sum (2 i - M + 1) x_i over M (M - 1); with ``alpha`` it is
    scaled by 1 - (1 - alpha) / M. A single member scores its absolute error.
    """
    m = F.size("xs").cast("double")
    pairs = F.aggregate(
        F.transform("xs", lambda v, i: (2 * i - F.size("xs") + 1) * v), F.lit(0.0), lambda a, v: a + v
    ) / (m * (m - 1))
    if alpha is not None:
        pairs = pairs * (1 - (1 - alpha) / m)
    away = F.aggregate("xs", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("y"))) / m
    rows = df.groupBy(*key).agg(F.sort_array(F.collect_list(x)).alias("xs"), F.first(y).alias("y"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), *([F.sum(w).alias(w)] if w else []))
    member = F.aggregate("xs", F.lit(0.0), lambda a, v: a + (v - F.col("y")) * (v - F.col("y"))) / m
    return rows.select(*key, F.size("xs").alias("members"), "y", "mean", "variance", member.alias("e2_member"), F.when(m > 1, away - pairs).otherwise(away).alias("crps"), *([w] if w else []))


def spread_skill(df: DataFrame, by: list[str], w: str = "w") -> DataFrame:
    """rmse of the mean, of a member, spread with (M + 1) / M, their ratio, and CRPS, from rows of ``fair_crps`` with weights."""
    w = F.col(w)
    total = F.sum(w)
    e2 = F.sum(w * (F.col("mean") - F.col("y")) ** 2) / total
    inflated = F.sum(w * F.col("variance") * (F.col("members") + 1) / F.col("members")) / total
    return df.groupBy(*by).agg(
        F.sqrt(e2).alias("rmse"), F.sqrt(F.sum(w * F.col("e2_member")) / total).alias("rmse_member"), F.sqrt(inflated).alias("spread"),
        F.sqrt(inflated / e2).alias("spread_skill"), (F.sum(w * F.col("crps")) / total).alias("crps"),
    )


def erf_of(x: np.ndarray) -> np.ndarray:
    """The error function of an array, to double accuracy: its power series within 3, beyond it the continued fraction of its complement."""
    a = np.minimum(np.abs(x), 6.0)  # beyond, it is 1 in double accuracy
    near, out = a < 3, np.ones_like(a)
    t = a[near]
    term, total = t.copy(), t.copy()
    for k in range(1, 60):
        term = term * 2 * t * t / (2 * k + 1)
        total += term
    out[near] = 2 / math.sqrt(math.pi) * np.exp(-t * t) * total
    t = a[~near]
    tail = t.copy()
    for k in range(60, 0, -1):
        tail = t + k / 2 / tail
    out[~near] = 1 - np.exp(-t * t) / math.sqrt(math.pi) / tail
    return np.where(np.isnan(x), np.nan, np.sign(x) * out)


@F.pandas_udf(DoubleType())
def erf(z: pd.Series) -> pd.Series:
    """The error function; Spark has none."""
    return pd.Series(erf_of(z.to_numpy(float)), index=z.index).where(z.notna())


def gaussian_crps(mean: Column, sigma: Column, y: Column) -> Column:
    """CRPS of a normal forecast: sigma (z (2 Phi(z) - 1) + 2 phi(z) - 1 / sqrt(pi))."""
    z = (y - mean) / sigma
    return sigma * (z * erf(z / math.sqrt(2)) + 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))


def covered(mean: Column, sigma: Column, y: Column, times: float) -> Column:
    """1 where the truth lies within ``times`` sigmas, ends included."""
    return (F.abs(mean - y) <= times * sigma).cast("double")


def calibration(df: DataFrame, by: list[str], mean: str, y: str, variance: str, w: str) -> DataFrame:
    """The factor rmse / sigma of each group, 1 where the variance is 0."""
    e2, s2 = F.sum(F.col(w) * (F.col(mean) - F.col(y)) ** 2), F.sum(F.col(w) * F.col(variance))
    return df.groupBy(*by).agg(F.when(s2 > 0, F.sqrt(e2 / s2)).otherwise(1.0).alias("factor"))


def functionals(state: DataFrame, weights: DataFrame, on: list[str], by: list[str], value: str = "x") -> DataFrame:
    """Linear functionals: per ``by`` and quantity the sum of weight times value. weights: (on..., quantity, weight)."""
    return state.join(weights, on).groupBy(*by, "quantity").agg(F.sum(F.col("weight") * F.col(value)).alias("total"))


def conservation(totals: DataFrame, by: list[str], start: str, lead: str, truth: str, pred: str, initial: str) -> DataFrame:
    """Per lead: mean and population std of the error, share of positive errors, mean step of truth and of model (the first from ``initial``)."""
    w = Window.partitionBy(*by, start).orderBy(lead)
    step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.col(initial))
    e = F.col(pred) - F.col(truth)
    rows = totals.select(*by, lead, e.alias("e"), step(truth).alias("ts"), step(pred).alias("ps"))
    return rows.groupBy(*by, lead).agg(F.avg("e").alias("error_mean"), F.stddev_pop("e").alias("error_std"), F.avg((F.col("e") > 0).cast("double")).alias("positive"), F.avg("ts").alias("truth_step"), F.avg("ps").alias("model_step"))


def offset_pattern(df: DataFrame, by: list[str], e: Column, w: Column) -> DataFrame:
    """rmse² split into the offset's and the pattern's part."""
    total = F.sum(w)
    mse, offset = F.sum(w * e * e) / total, F.sum(w * e) / total
    return df.groupBy(*by).agg(F.sqrt(mse).alias("rmse"), (offset * offset).alias("offset2"), (mse - offset * offset).alias("pattern2"))


def ranked(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the average rank of ``value`` within ``by``, ties sharing theirs; groups may be of any size."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__ties"))
    places = placed(counts, by, [value], "__value")  # values in order, each once
    upto = Window.partitionBy(*by, "__block").orderBy("__value")
    blocks = places.withColumn("__block", F.floor(F.col("__value") / BLOCK))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy(*by, "__block").agg(F.sum("__ties").alias("__all")).withColumn("__start", F.coalesce(F.sum("__all").over(before), F.lit(0))).drop("__all")
    ranks = blocks.withColumn("__here", F.sum("__ties").over(upto)).join(starts, [*by, "__block"])
    ranks = ranks.select(*by, value, (F.col("__start") + F.col("__here") - (F.col("__ties") - 1) / 2).alias(name))
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation per group; null with 2 rows or fewer."""
    rows = ranked(ranked(df, by, a, "__ra"), by, b, "__rb")
    return rows.groupBy(*by).agg(F.when(F.count("*") > 2, F.corr("__ra", "__rb")).alias("rank_corr"))


#: Distinct values whose ranks are summed up by one window.
BLOCK = 8192
#: Starts of a cell, and draws that are made of it at once.
CELL_STARTS, DRAWS_AT_ONCE = 4096, 64


#: Groups whose draws a task adds up before it gives them out.
GROUPS_HELD = 256


def poisson_sums(sums: DataFrame, by: str, start: str, columns: list[str], draws: int, steps: list[float]) -> DataFrame:
    """(by, draw, columns...): sums of ``sums`` (a row for each by and start) in which a start counts, in draw 1 to ``draws``, as often as its hashed share reaches one of ``steps``.

    The share is of the first 8 hex digits of md5("start:draw"). Rows are in order of starts, so that the groups of a start share its
    digests; a batch's draws are one matrix product, and a task gives out one row for each group and draw.
    """
    kind, bounds = sums.schema[by].dataType.simpleString(), [math.ceil(Fraction(p) * 2**32) for p in steps]

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            group = np.repeat(np.array([*held, None], object)[:-1], draws)
            return pd.DataFrame({by: group, "draw": np.tile(np.arange(1, draws + 1), len(held)), **dict(zip(columns, np.concatenate([*held.values()]).T, strict=True))})

        for p in parts:
            group, groups = pd.factorize(p[by], use_na_sentinel=False)
            at, starts = pd.factorize(p["__start"])  # -1: null, which has no digest and counts 0 times
            values = np.zeros((len(starts), len(groups), len(columns)))
            there = at >= 0
            np.add.at(values, (at[there], group[there]), p[columns].to_numpy(float)[there])
            texts = np.array([*(s.encode() for s in starts), None], object)[:-1]
            counts = np.zeros((draws, len(starts)))
            for n, head in zip(counts, heads(texts, [f":{d}" for d in range(1, draws + 1)]), strict=True):
                for b in bounds:
                    n += head >= b
            total = (counts @ values.reshape(len(starts), -1)).reshape(draws, len(groups), len(columns))
            for k, g in enumerate(groups):
                g = None if pd.isna(g) else g
                held[g] = held[g] + total[:, k] if g in held else total[:, k]
            if len(held) > GROUPS_HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    ordered = sums.select(by, F.col(start).cast("string").alias("__start"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns)).sortWithinPartitions("__start")
    each = ordered.mapInPandas(draw, f"{by} {kind}, draw int, " + ", ".join(f"{c} double" for c in columns))
    return each.groupBy(by, "draw").agg(*(F.sum(c).alias(c) for c in columns))


def picked(rng: np.random.Generator, size: int, n: int) -> np.ndarray:
    """How often each of so many starts is picked in n picks; quicker than a binomial number for each start, by the same law."""
    return np.bincount(rng.integers(0, size, n, np.uint32), minlength=size)


def bootstrap_sums(sums: DataFrame, by: str, start: str, columns: list[str], draws: int, seed: int) -> DataFrame:
    """(by, draw, columns...): sums of ``sums`` (one row for each by and start) over starts drawn with repetition, as many as there are, so often.

    Starts are dealt to cells by a digest. How many of a draw's picks fall into each cell follows from the cells' sizes,
    cell after cell: given what is left, a binomial number. Within a cell they are spread evenly over its starts. So the counts of
    a draw are exactly multinomial and sum to the number of starts; no task sees more than a cell, and a
    draw's random numbers depend on seed, group, cell and draw only. A cell's draws are one matrix product.
    """
    n = sums.groupBy(by).agg(F.count("*").alias("__n"))
    cells = sums.join(n, by).withColumn("__cells", F.ceil(F.col("__n") / CELL_STARTS).cast("int"))
    cells = cells.withColumn("__cell", F.pmod(F.conv(F.substring(F.md5(F.col(start).cast("string")), 1, 8), 16, 10).cast("long"), F.col("__cells")).cast("int"))
    sizes = cells.groupBy(by, "__cell").agg(F.count("*").alias("size")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__cell", "size"))).alias("__sizes"))
    kind = sums.schema[by].dataType.simpleString()

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for group, sizes, draw in zip(p[by], p["__sizes"], p["draw"], strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(str(group).encode()), int(draw)])
                counts = rng.multinomial(sum(s["size"] for s in sizes), np.array([s["size"] for s in sizes], float) / sum(s["size"] for s in sizes))
                yield pd.DataFrame({by: group, "__cell": [s["__cell"] for s in sizes], "draw": int(draw), "picks": counts})

    dealt = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).mapInPandas(split, f"{by} {kind}, __cell int, draw int, picks long")

    def draw_cell(key: tuple, p: pd.DataFrame, picks: pd.DataFrame) -> pd.DataFrame:
        values, group, cell = p.sort_values(start, kind="stable")[columns].to_numpy(float), zlib.crc32(str(key[0]).encode()), int(key[1])
        picks = picks.sort_values("draw")
        out = []
        for at in range(0, len(picks), DRAWS_AT_ONCE):
            some = picks.iloc[at : at + DRAWS_AT_ONCE]
            counts = np.stack([picked(np.random.default_rng([seed + 1, group, cell, d]), len(p), n) for d, n in zip(some["draw"].tolist(), some["picks"].tolist(), strict=True)])
            out.append(counts.astype(float) @ values)
        return pd.DataFrame({by: key[0], "draw": picks["draw"].to_numpy(), **dict(zip(columns, np.concatenate(out).T, strict=True))})

    schema = f"{by} {kind}, draw int, " + ", ".join(f"{c} double" for c in columns)
    whole = cells.select(by, "__cell", start, *columns).groupBy(by, "__cell").cogroup(dealt.groupBy(by, "__cell")).applyInPandas(draw_cell, schema)
    return whole.groupBy(by, "draw").agg(*(F.sum(c).alias(c) for c in columns))
