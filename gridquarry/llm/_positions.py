"""Gapless positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut

#: Rows aimed at in a cell, and the most cells into which a group is dealt.
CELL_ROWS, MOST_CELLS = 8192, 4096


def cells(rows: int) -> int:
    """Into how many cells to deal groups of a table with so many rows."""
    return min(MOST_CELLS, 1 + rows // CELL_ROWS)


def dealt(rows: DataFrame, id: str, row: str, n: int) -> DataFrame:
    """``rows`` (checkpointed) with the cell, of n, of each: by a digest of its id, or of its row number where it has none or
    more rows than a cell is to hold have it."""
    often = cut(rows.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("__id")).agg(F.count("*").alias("__often")).where(F.col("__often") > CELL_ROWS))
    name = F.col(id).cast("string")
    if n > 1 and not often.isEmpty():
        rows = rows.join(often, F.col(id) == F.col("__id"), "left")  # at most one for every CELL_ROWS rows
        name = F.when(F.col("__often").isNull(), name)
    name = F.coalesce(name, F.concat(F.lit("row "), F.col(row).cast("string")))
    return rows.withColumn("cell", F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % n).drop("__id", "__often")


def positions(df: DataFrame, by: list[str], cell: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place, from 0, among the rows with its ``by``, in the order of ``cell`` and ``order``.

    ``cell`` divides each group, so no task holds more than a cell: the cells'
    counts are summed up to where each starts. by and cell must not be null.
    """
    here = Window.partitionBy(*by, *cell).orderBy(*order)
    before = Window.partitionBy(*by).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*by, *cell).agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return df.withColumn("__place", F.row_number().over(here)).join(starts, [*by, *cell]).withColumn(name, F.col("__start") + F.col("__place") - 1).drop("__start", "__place")
