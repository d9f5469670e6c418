"""Forecast providers and rollouts: any provider gives rows (key..., start, lead, pred)."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def fitted(pairs: DataFrame, by: list[str], value: str, before: str) -> DataFrame:
    """(by..., slope, base) of the least squares line from one row to the next."""
    return pairs.groupBy(*by).agg(F.coalesce(F.regr_slope(value, before), F.lit(1.0)).alias("slope"), F.coalesce(F.regr_intercept(value, before), F.lit(0.0)).alias("base"))


def unrolled(starts: DataFrame, model: DataFrame, by: list[str], x0: str, horizon: Column, chunk: int | None = None) -> DataFrame:
    """(..., lead, pred): the model applied lead after lead from ``x0``, a run ending at its horizon.

    The steps of a run are folded inside its row, so there is one join and no loop of jobs. With ``chunk`` the
    fold runs over chunks of so many leads, the state carried from one to the next: the same numbers.
    """
    rows = starts.join(model, by)
    step = lambda x: F.col("base") + F.col("slope") * x

    def fold(state: Column, n: Column) -> Column:
        count = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(count, state, lambda a, _: F.struct(step(a["last"]).alias("last"), F.concat(a["all"], F.array(step(a["last"]))).alias("all")))

    n, empty = horizon.cast("int"), F.array().cast("array<double>")
    start = F.struct(F.col(x0).cast("double").alias("last"), empty.alias("all"))
    if chunk is None:
        rows = rows.withColumn("__all", fold(start, n)["all"])
    else:
        # the leads of each chunk, folded from the state that the chunk before it left; a chunk's leads join the others when it is done
        sizes = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / chunk).cast("int") - 1, F.lit(0))), lambda c: F.least(F.lit(chunk), n - c * chunk))

        def follow(a: Column, size: Column) -> Column:
            part = fold(F.struct(a["last"].alias("last"), empty.alias("all")), size)
            return F.struct(part["last"].alias("last"), F.concat(a["all"], part["all"]).alias("all"))

        rows = rows.withColumn("__all", F.aggregate(sizes, start, follow)["all"])
    return rows.select(*starts.columns, F.posexplode("__all").alias("lead", "pred")).withColumn("lead", F.col("lead") + 1)


#: The next value from the last one, the one before it and the lead's inputs.
Step = Callable[[Column, Column, Column], Column]


def unrolled_pairs(starts: DataFrame, inputs: DataFrame, on: list[str], day: str, step: Step, boundary: str, chunk: int) -> DataFrame:
    """(columns of starts..., lead, pred): runs that carry two states, with inputs at each lead and the truth on the boundary.

    starts: a row for each run, with ``on``, its day, ``horizon``, the values ``x0`` at its day and ``x1`` the day before,
    and whatever ``step`` uses. inputs: a row for each ``on`` and day, with what drives the model that day and
    ``boundary``, the truth where the run takes it, else null. Within a run no other truth is seen after its day.

    Leads go in chunks: the runs whose horizon reaches into a chunk meet its days' inputs, fold them within their
    row, and are stored with their last two states, from which the next chunk goes on. So a run's length and the number
    of runs are free, a chunk's inputs are the most that a row holds, and what is lost is a chunk at most.
    """
    columns = starts.columns
    driven = inputs.select(*on, F.col(day).alias("__day"), F.struct(*(c for c in inputs.columns if c not in (*on, day))).alias("__in"))
    most = starts.agg(F.max("horizon")).first()[0] or 0
    alive = starts.withColumns({"__last": F.col("x0").cast("double"), "__before": F.col("x1").cast("double")})
    done = []
    for first in range(0, max(most, 1), chunk):
        alive = alive.where(F.col("horizon") > first)
        leads = alive.select(*columns, "__last", "__before", F.explode(F.sequence(F.lit(first + 1), F.least(F.lit(first + chunk), F.col("horizon").cast("int")))).alias("lead"))
        met = leads.withColumn("__day", F.date_add(day, F.col("lead"))).join(driven, [*on, "__day"], "left")
        by = [*columns, "__last", "__before"]
        lines = met.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lead", "__in"))).alias("__ins"))

        def follow(state: Column, i: Column) -> Column:
            given = i["__in"]
            value = F.coalesce(given[boundary], step(state["last"], state["before"], given)).cast("double")
            return F.struct(value.alias("last"), state["last"].alias("before"), F.concat(state["all"], F.array(value)).alias("all"))

        state = F.struct(F.col("__last").alias("last"), F.col("__before").alias("before"), F.array().cast("array<double>").alias("all"))
        lines = cut(lines.withColumn("__out", F.aggregate("__ins", state, follow)).select(*columns, "__out"))
        done.append(lines.select(*columns, F.posexplode("__out.all").alias("__at", "pred")).select(*columns, (F.col("__at") + first + 1).alias("lead"), "pred"))
        alive = lines.select(*columns, F.col("__out.last").alias("__last"), F.col("__out.before").alias("__before"))
    return functools.reduce(DataFrame.unionByName, done)


def uniform(seed: int, *keys: Column, salt: int = 0) -> Column:
    """A number in (0, 1) that the seed and the keys alone decide, wherever and in whatever order rows are."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(salt)), *(k.cast("string") for k in keys)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number decided by the seed and the keys, from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys, salt=1))) * F.cos(2 * math.pi * uniform(seed, *keys, salt=2))


def ensemble(forecasts: DataFrame, keys: list[str], members: int, sigma: Column, seed: int, pred: str = "pred") -> DataFrame:
    """``forecasts`` once for each member, from 0, with ``member``, ``sigma`` and the mean forecast disturbed by as many sigmas as the keys' and member's number.

    The numbers are counted, not drawn: a member's forecast is the same however rows are partitioned, and a lost task makes the same again.
    """
    rows = forecasts.withColumn("sigma", sigma).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    return rows.withColumn(pred, F.col(pred) + F.col("sigma") * normal(seed, *(F.col(k) for k in keys), F.col("member")))


@dataclass(frozen=True)
class Statistic:
    """A number of a (start, lead) group, by its name in the registry."""

    units: str
    value: Column


def registry() -> dict[str, Statistic]:
    """Statistics of rows (truth, pred, x0, w); adding one is adding an entry."""
    w, e, p = F.col("w"), F.col("pred") - F.col("truth"), F.col("x0") - F.col("truth")
    mean = lambda c: F.sum(w * c) / F.sum(w)
    out = {"rmse": Statistic("1", F.sqrt(mean(e * e))), "rmse_pers": Statistic("1", F.sqrt(mean(p * p))), "bias": Statistic("1", mean(e)), "bias_pers": Statistic("1", mean(p))}
    for who in ("pred", "truth"):
        v = F.col(who)
        out |= {f"mean_{who}": Statistic("1", mean(v)), f"ke_{who}": Statistic("1", F.sum(w * v * v) / 2 / F.sum(w)), f"max_{who}": Statistic("1", F.max(F.abs(v)))}
    return out


def statistics(df: DataFrame, by: list[str], chosen: dict[str, Statistic]) -> DataFrame:
    """All statistics in one aggregation."""
    return df.groupBy(*by).agg(*(s.value.alias(name) for name, s in chosen.items()))


Provider = Callable[[DataFrame], DataFrame]
#: Forecast providers by name; others may be added.
PROVIDERS: dict[str, Provider] = {
    "persistence": lambda pairs: pairs.select("cell", "feature").distinct().withColumns({"slope": F.lit(1.0), "base": F.lit(0.0)}),
    "damped": lambda pairs: pairs.select("cell", "feature").distinct().withColumns({"slope": F.lit(0.8), "base": F.lit(0.0)}),
    "linear": lambda pairs: pairs.select("cell", "feature").distinct().join(fitted(pairs, ["feature"], "value", "x0"), "feature"),
}
