"""Moments, floors, standardization and fixed-point packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counts per standard deviation, clip in standard deviations, share of raw std that floors a change std.
COUNTS_PER_STD, CLIP_STD, CHANGE_FLOOR = 2000, 16, 0.05


def safe(std: Column) -> Column:
    """A standard deviation to divide by: 1 in place of 0."""
    return F.when(std > 0, std).otherwise(1.0)


def std_pop(value: str | Column) -> Column:
    """Population standard deviation, exactly 0 where all values are equal: there merged partial results may leave a rounding error."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(F.max(v) - F.min(v) == 0, 0.0).otherwise(F.stddev_pop(v))


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean and population std of the non-null values, std 0 made 1; partial sums merge before the shuffle."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), safe(std_pop(value)).alias("std"))


def with_change(df: DataFrame, chain: list[str], day: str, value: str, used: Column | None = None) -> DataFrame:
    """``df`` with ``change``: the step from the day before along a chain; null where that day is missing or either row isn't used."""
    w = Window.partitionBy(*chain).orderBy(day)
    used = F.lit(True) if used is None else used
    before = F.lag(F.when(used, F.struct(F.col(day).alias("d"), F.col(value).alias("v")))).over(w)
    next_day = used & (F.datediff(F.col(day), before["d"]) == 1)
    return df.withColumn("change", F.when(next_day, F.col(value) - before["v"]))


def train_statistics(df: DataFrame, by: list[str], chain: list[str], day: str, value: str, used: Column | None = None) -> DataFrame:
    """mean, std, diff_mean and diff_std of each group; a change std is floored by a share of the raw std before zeros become 1."""
    rows = with_change(df, chain, day, value, used)
    kept = rows if used is None else rows.where(used)
    s = kept.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), std_pop(value).alias("raw"),
        F.count("change").alias("n_diff"), F.avg("change").alias("diff_mean"), std_pop("change").alias("raw_diff"),
    )
    floored = F.greatest(F.coalesce("raw_diff", F.lit(0.0)), CHANGE_FLOOR * F.col("raw"))
    return s.select(*by, "n", "mean", safe(F.col("raw")).alias("std"), "n_diff", "diff_mean", safe(floored).alias("diff_std"))


def floored_std(df: DataFrame, column: str, std: str, minimum: Column, share: float = 0.1) -> DataFrame:
    """``df`` (one row a feature) with ``floor`` and ``floored``: at least a physical minimum and a share of the column's median std."""
    middle = F.expr(f"percentile({std}, 0.5)").over(Window.partitionBy(column))
    floor = F.greatest(minimum, share * middle)
    return df.withColumn("floor", floor).withColumn("floored", F.greatest(F.col(std), F.col("floor"))).withColumn("raised", F.col("floored") > F.col(std))


def quantized(value: Column, mean: Column, std: Column) -> Column:
    """Standard deviations in counts, rounded half to even and clipped, as a 16-bit integer; null and NaN give null."""
    most = COUNTS_PER_STD * CLIP_STD
    counts = F.least(F.greatest(F.rint((value - mean) / std * COUNTS_PER_STD), F.lit(-float(most))), F.lit(float(most))).cast("short")
    return F.when(value.isNotNull() & ~F.isnan(value), counts)


def unquantized(q: Column, mean: Column, std: Column) -> Column:
    return q * std / COUNTS_PER_STD + mean


def at_clip(q: Column) -> Column:
    """How many values lie at the clip."""
    return F.count_if(F.abs(q) >= COUNTS_PER_STD * CLIP_STD)
