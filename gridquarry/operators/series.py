"""Windows and time series: runs, gaps, fills, lags, departures."""

from __future__ import annotations

import datetime
import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, by: list[str], at: str, flag: Column) -> DataFrame:
    """(by..., first, last, length) of each run of consecutive ``at`` (integers) at which ``flag`` holds."""
    w = Window.partitionBy(*by).orderBy(at)
    rows = df.where(flag).select(*by, at, (F.col(at) - F.row_number().over(w)).alias("__island"))
    return rows.groupBy(*by, "__island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length")).drop("__island")


def spans(df: DataFrame, by: list[str], day: str) -> DataFrame:
    """(by..., spans): the runs of consecutive days as text, "a..b, c"."""
    found = runs(df.select(*by, F.unix_date(day).alias("__d")).distinct(), by, "__d", F.lit(True))
    one = F.when(F.col("length") > 1, F.concat_ws("..", F.date_from_unix_date(F.col("first").cast("int")).cast("string"), F.date_from_unix_date(F.col("last").cast("int")).cast("string"))).otherwise(F.date_from_unix_date(F.col("first").cast("int")).cast("string"))
    rows = found.withColumn("one", one)
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "one"))), lambda x: x["one"]), ", ").alias("spans"))


def spine(df: DataFrame, by: list[str], day: str) -> DataFrame:
    """Every (by..., day) from the group's first to its last day, each once; without a join over the days."""
    ends = df.groupBy(*by).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return ends.select(*by, F.explode(F.sequence("a", "b")).alias(day))


def filled(df: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """Every day of the group's span with its value, or the linear interpolation between the nearest real rows, and ``real``."""
    rows = spine(df, by, day).join(df.select(*by, day, value), [*by, day], "left")
    w = Window.partitionBy(*by).orderBy(day)
    real = F.when(F.col(value).isNotNull(), F.struct(F.col(day).alias("d"), F.col(value).alias("v")))
    rows = rows.withColumn("__p", F.last(real, True).over(w)).withColumn("__q", F.first(real, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    share = F.datediff(day, F.col("__p.d")) / F.datediff(F.col("__q.d"), F.col("__p.d"))
    between = (1 - share) * F.col("__p.v") + share * F.col("__q.v")
    return rows.select(*by, day, F.coalesce(value, between).alias(value), F.col(value).isNotNull().alias("real"))


def departure(df: DataFrame, by: list[str], lead: str, value: Column, low: float, high: float, run: int = 3) -> DataFrame:
    """(by..., departs): the first lead from which the value lies outside [low, high] ``run`` leads in a row; NaN and null count as inside."""
    out = F.coalesce(((value < low) | (value > high)) & ~F.isnan(value), F.lit(False)).cast("int")
    w = Window.partitionBy(*by).orderBy(lead)
    rows = df.withColumn("__out", out).withColumn("__n", F.sum("__out").over(w.rowsBetween(0, run - 1)))
    return rows.groupBy(*by).agg(F.min(F.when(F.col("__n") == run, F.col(lead))).alias("departs"))


def collapsed(df: DataFrame, by: list[str], step: str, loss: str, anchor: Column, ratio: float = 0.9, gain: float = 0.01, window: int = 5, first: int = 10) -> DataFrame:
    """(by..., epoch): the first epoch at which the moving average is near the anchor and no better than ``window`` epochs before; null if none."""
    w = Window.partitionBy(*by).orderBy(step)
    rows = df.withColumn("__e", F.row_number().over(w)).withColumn("__ma", F.avg(loss).over(w.rowsBetween(1 - window, 0)))
    rows = rows.withColumn("__before", F.lag("__ma", window).over(w)).withColumn("__l0", anchor)
    bad = (F.col("__e") >= first) & (F.col("__ma") >= ratio * F.col("__l0")) & (F.col("__ma") >= (1 - gain) * F.col("__before"))
    return rows.groupBy(*by).agg(F.min(F.when(bad, F.col("__e"))).alias("epoch"))


def plateau(df: DataFrame, by: list[str], step: str, loss: str, threshold: float, patience: int, stop_after: int) -> DataFrame:
    """(by..., decays, stopped, best): a fold over the ordered losses of each group.

    A loss counts as better when it gains more than ``threshold`` of the best; after ``patience`` stale losses the
    rate decays, and that counter starts again; after ``stop_after`` stale losses it stops, and later ones are ignored.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(loss).cast("double").alias("l"))))
    zero = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("stale"), F.lit(0).alias("still"), F.lit(0).alias("decays"), F.lit(None).cast("int").alias("stopped"), F.lit(0).alias("n"))

    def fold(a: Column, x: Column) -> Column:
        better = x["l"] < a["best"] * (1 - threshold)
        stale, still = F.when(better, 0).otherwise(a["stale"] + 1), F.when(better, 0).otherwise(a["still"] + 1)
        decay = stale >= patience
        new = F.struct(
            F.when(better, x["l"]).otherwise(a["best"]).alias("best"), F.when(decay, 0).otherwise(stale).alias("stale"), still.alias("still"),
            (a["decays"] + decay.cast("int")).alias("decays"), F.when(still >= stop_after, a["n"] + 1).alias("stopped"), (a["n"] + 1).alias("n"),
        )
        return F.when(a["stopped"].isNotNull(), a).otherwise(new)

    return df.groupBy(*by).agg(F.aggregate(ordered, zero, fold).alias("f")).select(*by, F.col("f.decays").alias("decays"), F.col("f.stopped").alias("stopped"), F.col("f.best").alias("best"))


def weighted_lags(value: str, weights: dict[int, float], by: list[str], day: str) -> Column:
    """The sum of weight times the value so many rows before; null until all exist."""
    w = Window.partitionBy(*by).orderBy(day)
    return functools.reduce(operator.add, (F.lag(value, k).over(w) * share for k, share in weights.items()))


def from_above(value: Column, lost: Column, by: list[str], level: str) -> Column:
    """The value, or where it is lost that of the nearest kept level above; fills propagate down."""
    return F.last(F.when(~lost, value), True).over(Window.partitionBy(*by).orderBy(level))


def kept_windows(df: DataFrame, start: Column, end: Column, changes: list[datetime.date]) -> DataFrame:
    """The windows that hold none of a short, fixed list of days with start < day <= end."""
    days = F.array(*[F.lit(d) for d in changes])
    return df.where(~F.exists(days, lambda c: (c > start) & (c <= end)))


def projected_thickness(df: DataFrame, column: list[str], level: str, dp: str, prev: str, change_var: str, massless: float) -> DataFrame:
    """``df`` with ``projected``: layer thicknesses not below 0 whose column sums to the previous state's.

    Interfaces accumulated from the top stop at the total; what is missing then is spread over the layers that held
    mass before, in proportion to the variance of their change.
    """
    whole, down = Window.partitionBy(*column), Window.partitionBy(*column).orderBy(level)
    relu = lambda c: F.greatest(F.col(c), F.lit(0.0))
    rows = df.withColumn("__total", F.sum(relu(prev)).over(whole)).withColumn("__sum", F.sum(relu(dp)).over(down))
    rows = rows.withColumn("__face", F.least("__sum", "__total")).withColumn("__got", F.col("__face") - F.coalesce(F.lag("__face").over(down), F.lit(0.0)))
    rows = rows.withColumn("__w", F.when(relu(prev) > massless, F.col(change_var)).otherwise(0.0))
    rows = rows.withColumn("__short", F.col("__total") - F.max("__face").over(whole)).withColumn("__ws", F.greatest(F.sum("__w").over(whole), F.lit(1e-12)))
    return rows.withColumn("projected", F.col("__got") + F.col("__short") * F.col("__w") / F.col("__ws")).drop("__total", "__sum", "__face", "__got", "__w", "__short", "__ws")
