"""Rows dealt to ranges of a global order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut

#: Bits of a row number below its split's number.
SPLIT_BITS = 33


def splits(df: DataFrame) -> int:
    """How many ranges to deal ``df`` to: as many as its scan has splits, or as there are cores."""
    return max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)


def in_ranges(keys: DataFrame, order: list[Column], n: int) -> DataFrame:
    """``keys`` in ``n`` ranges of ``order`` and stored, with the range's number (__cell) and the place in it (__place, from 0).

    The last column of ``order`` should tell all rows apart, so that a range may end within rows that are else alike.
    """
    number = F.monotonically_increasing_id()
    rows = cut(keys.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__number", number))
    return rows.withColumns({"__cell": F.shiftright("__number", SPLIT_BITS), "__place": F.col("__number").bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))}).drop("__number")


def ranked(keys: DataFrame, order: list[Column], n: int, name: str) -> DataFrame:
    """``keys`` with each row's place, from 1, in ``order`` over the whole table: the ranges' counts say where each starts."""
    rows = in_ranges(keys, order, n)
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = rows.groupBy("__cell").agg(F.count("*").alias("__n")).select("__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return rows.join(starts, "__cell").withColumn(name, F.col("__start") + F.col("__place") + 1).drop("__cell", "__place", "__start")
