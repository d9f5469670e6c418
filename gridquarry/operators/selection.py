"""Rows by rank, without sorting the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Stored, cut

#: Rows that are sorted at once when a bracket is narrow enough.
FEW = 10_000


def at_rank(df: DataFrame, value: str, key: str, rank: int, few: int = FEW) -> DataFrame:
    """The one row of ``df`` whose place in the order of (value, key), from 0, is ``rank``; none beyond the end.

    A bracket of values is narrowed by approximate quantiles and exact counts, each a pass that is combined
    before the shuffle, until few rows are left in it; if one value alone fills it, by the keys.
    """
    rows, column = df.where(F.col(value).isNotNull()), value
    while True:
        n = rows.count()
        if rank >= n or n <= few:
            break
        share = rank / n
        low, high = rows.approxQuantile(column, [max(0.0, share - 0.02), min(1.0, share + 0.02)], 0.005)
        below, within = rows.agg(F.count_if(F.col(column) < low), F.count_if(F.col(column).between(low, high))).first()
        if not below <= rank < below + within:
            low, high = (None, low) if rank < below else (high, None)
            rows = rows.where(F.col(column) < high) if low is None else rows.where(F.col(column) > low)
            rank -= 0 if low is None else below + within
            continue
        rank -= below
        rows = rows.where(F.col(column).between(low, high))
        if low == high:
            if column == key:
                break
            column = key
        elif within == n:
            break
    return rows.orderBy(value, key).limit(rank + 1).orderBy(F.desc(value), F.desc(key)).limit(1) if rank < n else rows.limit(0)


#: Bins into which a bracket is divided in one pass.
BINS = 1024


def quantiles(df: DataFrame, by: list[str], values: dict[str, tuple[Column, float]], few: int = FEW) -> DataFrame:
    """(by..., name...): for each name the exact quantile of its column at its fraction, between ranks by interpolation.

    All names and groups at once. Each wanted rank has a bracket of values, at first the group's least and most. A pass
    counts the values in equal bins of each bracket (equal in magnitude where it spans many), and their least and most,
    combined before the shuffle; the bin that holds the rank is the next bracket. Brackets with ``few`` values at most, or with one value alone, are
    done; what is left in them is counted by value and summed up to the rank. So no task holds a group, however large.
    Null and NaN values don't count; a group with none gives null.
    """
    asked = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, (v, _) in enumerate(values.values())))
    key = F.struct(*(F.col(b) for b in by)) if by else F.struct(F.lit(0).alias("one"))
    groups = df.select(key.alias("g"), F.inline(asked)).where("v IS NULL OR NOT isnan(v)")
    rows = groups.where("v IS NOT NULL").withColumn("v", F.col("v") + 0.0)
    at = F.element_at(F.array(*(F.lit(float(f)) for _, f in values.values())), F.col("k") + 1) * (F.col("n") - 1)
    ends = groups.groupBy("g", "k").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).withColumn("at", at)
    ranks = F.array_distinct(F.array(F.floor("at"), F.ceil("at")))
    stored = Stored(ends.select("g", "k", "at", F.explode(F.when(F.col("n") > 0, ranks).otherwise(F.array(F.lit(0).cast("long")))).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    while not (wide := stored.rows.where((F.col("inside") > few) & (F.col("low") < F.col("high")))).isEmpty():
        # halves, so that the distance of the largest doubles is a double; the ends, which may be infinite, have their own bins
        v, low, high = F.col("v"), F.col("low"), F.col("high")
        wide_apart = _scale(high) - _scale(low) > 8
        a, b, c = (F.when(wide_apart, _scale(x)).otherwise(x / 2) for x in (v, low, high))
        share = F.coalesce(F.try_divide(a - b, c - b), F.lit(0.0))
        bins = F.when(F.col("v") == F.col("low"), -1).when(F.col("v") == F.col("high"), BINS).otherwise(F.least(F.floor(F.nanvl(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)))
        in_bin = _within(rows, wide.select("g", "k", "rank", "low", "high")).groupBy("g", "k", "rank", bins.alias("bin"))
        counts = in_bin.agg(F.count("*").alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = Window.partitionBy("g", "k", "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("under", F.coalesce(F.sum("inside").over(upto), F.lit(0)))
        found = counts.join(wide.select("g", "k", "rank", "at", "below"), ["g", "k", "rank"]).withColumn("under", F.col("under") + F.col("below"))
        found = found.where((F.col("under") <= F.col("rank")) & (F.col("rank") < F.col("under") + F.col("inside"))).withColumnsRenamed({"below": "old", "under": "below"})
        rest = stored.rows.where((F.col("inside") <= few) | (F.col("low") >= F.col("high")) | F.col("low").isNull())
        before, stored = stored, Stored(rest.unionByName(found.select(rest.columns)))
        before.forget()
    state = stored.rows
    one = state.where("low = high OR low IS NULL").select("g", "k", "at", "rank", F.col("low").alias("v"))
    open_ = state.where("low < high")
    equal = _within(rows, open_.select("g", "k", "rank", "low", "high")).groupBy("g", "k", "rank", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("g", "k", "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = equal.withColumn("upto", F.sum("n").over(upto)).join(open_.select("g", "k", "rank", "at", "below"), ["g", "k", "rank"]).where(F.col("below") + F.col("upto") > F.col("rank"))
    picked = one.unionByName(ordered.groupBy("g", "k", "at", "rank").agg(F.min("v").alias("v")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    between = F.when(low == high, low).otherwise(low + (high - low) * (F.col("at") - F.floor("at")))
    each = picked.groupBy("g", "k", "at").agg(between.alias("q"))
    out = each.groupBy("g").agg(*(F.max(F.when(F.col("k") == k, F.col("q"))).alias(name) for k, name in enumerate(values)))
    return out.select(*(F.col(f"g.{b}").alias(b) for b in by), *values)


def _scale(v: Column) -> Column:
    """A double's place on a scale of powers of two, in order: brackets of many magnitudes are divided by it."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))


def _within(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """Each value of ``rows`` (g, k, v) with each bracket of its group that holds it."""
    b = brackets.alias("b")
    return rows.alias("r").join(b, (F.col("r.g") == F.col("b.g")) & (F.col("r.k") == F.col("b.k")) & F.col("r.v").between(F.col("b.low"), F.col("b.high"))).select("b.*", "r.v")


#: Bits of a row's number below its partition's.
PARTITION_BITS = 33


def placed(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place, from 0, in the order of some columns within its group.

    Rows are sorted in ranges of group and order, and stored; how many rows of its group lie in the ranges before says
    where each begins. So a group may be larger than a task holds, and no window has more than a row for each range.
    """
    n = max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
    keys = [*by, *order]
    rows = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__number", F.monotonically_increasing_id()))
    rows = rows.withColumn("__range", F.shiftright("__number", PARTITION_BITS))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "__range").agg(F.count("*").alias("__n"), F.min("__number").alias("__first"))
    starts = starts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return rows.join(starts, [*by, "__range"]).withColumn(name, F.col("__start") + F.col("__number") - F.col("__first")).drop("__number", "__range", "__n", "__first", "__start")
