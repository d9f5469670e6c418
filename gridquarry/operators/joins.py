"""Joins that are more than equality: as-of, radius, nearest, offsets, greedy matches."""

from __future__ import annotations

import math
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, name: str, block: Column | None = None) -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` whose ``at`` is not after its own; null if none.

    Both are stacked and sorted by group, then the last value is carried on: one shuffle, no range join.
    With ``block`` (an expression of ``at`` that never falls as ``at`` grows, such as its month) a task sorts
    one block of one group only, and the last value of each block is carried to the next: for hot groups.
    """
    if block is not None:
        return _as_of_blocks(left, right, by, at, value, name, block)
    columns = [c for c in left.columns if c not in (*by, at)]
    l = left.select(*by, at, F.struct(*columns, F.lit(1).alias("__l")).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"))  # noqa: E741
    r = right.select(*by, at, F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = l.unionByName(r).withColumn("__last", F.last(F.when(F.col("__side") == 0, F.struct("__v")), True).over(w))
    return rows.where("__side = 1").select(*by, at, *(F.col(f"__row.{c}").alias(c) for c in columns), F.col("__last.__v").alias(name))


def _as_of_blocks(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, name: str, block: Column) -> DataFrame:
    l, r = left.withColumn("__block", block), right.withColumn("__block", block)  # noqa: E741
    inside = as_of(l, r.withColumn("__v", F.struct(F.col(value).alias("v"))), [*by, "__block"], at, "__v", "__in")
    lasts = r.groupBy(*by, "__block").agg(F.max_by(F.struct(F.col(value).alias("v")), F.col(at)).alias("__v"))
    marks = l.select(*by, "__block").distinct().withColumn("__v", F.lit(None).cast(lasts.schema["__v"].dataType)).unionByName(lasts)
    marks = marks.groupBy(*by, "__block").agg(F.max("__v").alias("__v"))  # one row a block: the sums below are small
    w = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*by, "__block", F.last("__v", True).over(w).alias("__before"))
    return inside.join(carried, [*by, "__block"], "left").select(*left.columns, F.coalesce("__in", "__before")["v"].alias(name))


def within_radius(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(a, b, distance, dx, dy) of the points (id, x, y) within ``radius``, dx and dy from b to a: b is dealt to the squares around its own, a joins by square."""
    def square(c: str) -> Column:
        return F.floor(F.col(c) / radius)

    left = a.select("a", F.col("x").alias("ax"), F.col("y").alias("ay"), square("x").alias("sx"), square("y").alias("sy"))
    around = F.sequence(F.lit(-1), F.lit(1))
    right = b.select("b", F.col("x").alias("bx"), F.col("y").alias("by"), square("x").alias("qx"), square("y").alias("qy"))
    right = right.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select("b", "bx", "by", (F.col("qx") + F.col("dx")).alias("sx"), (F.col("qy") + F.col("dy")).alias("sy"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return left.join(right, ["sx", "sy"]).select("a", "b", F.sqrt(dx**2 + dy**2).alias("distance"), dx.alias("dx"), dy.alias("dy")).where(F.col("distance") <= radius)


def nearest(a: DataFrame, b: DataFrame, k: int, side: float) -> DataFrame:
    """(a, b, distance, dx, dy) of the ``k`` nearest points (id, x, y) of b to each of a, all of b if fewer, ties to the lesser id.

    b is counted in squares of a side, and these in squares of twice the side, and so on. From the largest squares down
    each point of a keeps those that may hold one of its k nearest: whose near edge is no farther than the far
    edge of enough others that hold k points between them. So near and far points alike come down to a few squares, and
    only their points are compared. Points without a finite place have none and are none; of points of b in one place the k least ids count.
    """
    placed = "abs(x) < double('infinity') AND abs(y) < double('infinity')"
    none = within_radius(a.limit(0), b.limit(0), side)
    alike = F.row_number().over(Window.partitionBy("x", "y").orderBy("b"))
    square = lambda c: F.floor(F.col(c) / side)
    b = cut(b.where(placed).withColumn("__n", alike).where(F.col("__n") <= k).select("b", F.col("x").alias("bx"), F.col("y").alias("by"), square("x").alias("cx"), square("y").alias("cy")))
    finest = cut(b.groupBy("cx", "cy").agg(F.count("*").alias("n")))
    ends = finest.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy"), F.sum("n")).first()
    if not min(k, ends[4] or 0):
        return none
    k, top = min(k, ends[4]), 0
    while max((ends[1] >> top) - (ends[0] >> top), (ends[3] >> top) - (ends[2] >> top)) > 1:
        top += 1

    def counted(level: int) -> DataFrame:
        return finest.groupBy(F.shiftright("cx", level).alias("cx"), F.shiftright("cy", level).alias("cy")).agg(F.sum("n").alias("n"))

    first = F.array(*(F.struct(F.lit(r["cx"]).alias("px"), F.lit(r["cy"]).alias("py")) for r in counted(top + 1).collect()))  # four at most
    front = a.where(placed).select("a", F.col("x").alias("ax"), F.col("y").alias("ay"), F.inline(first))
    for level in range(top, -1, -1):
        width = side * (1 << level)
        some = counted(level).withColumns({"px": F.shiftright("cx", 1), "py": F.shiftright("cy", 1)})
        near, far = [], []
        for axis, c in (("ax", "cx"), ("ay", "cy")):
            low, high = F.col(c) * width - F.col(axis), (F.col(c) + 1) * width - F.col(axis)
            near.append(F.greatest(low, -high, F.lit(0.0)))
            far.append(F.greatest(F.abs(low), F.abs(high)))
        rows = front.join(some, ["px", "py"]).withColumns({"near": F.hypot(*near), "far": F.hypot(*far)})
        held = F.sum("n").over(Window.partitionBy("a").orderBy("far", "cx", "cy"))
        rows = rows.withColumn("held", held).withColumn("reach", F.min(F.when(F.col("held") >= k, F.col("far"))).over(Window.partitionBy("a")))
        slack = 1e-9 * (F.abs("ax") + F.abs("ay") + width)  # edges are reckoned in doubles
        front = rows.where(F.col("near") <= F.col("reach") + slack).select("a", "ax", "ay", F.col("cx").alias("px"), F.col("cy").alias("py"))
        if level % 4 == 0 and level:
            front = cut(front)
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    rows = front.withColumnsRenamed({"px": "cx", "py": "cy"}).join(b, ["cx", "cy"]).select("a", "b", F.sqrt(dx**2 + dy**2).alias("distance"), dx.alias("dx"), dy.alias("dy"))
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("__k") <= k).drop("__k")


def nearest_on_axis(df: DataFrame, value: str, axis: list[float], name: str) -> DataFrame:
    """``df`` with the index of the nearest entry of a short axis, ties to the first; the axis is a literal."""
    entries = F.array(*(F.struct(F.abs(F.col(value) - F.lit(float(a))).alias("d"), F.lit(k).alias("i")) for k, a in enumerate(axis)))
    return df.withColumn(name, F.array_min(entries)["i"])


def at_offsets(spine: DataFrame, files: DataFrame, roles: dict[str, tuple[str, int]], day: str) -> DataFrame:
    """(day, role, path): per day and role, the file of the role's product at its offset in days, or null."""
    listed = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(p).alias("product"), F.lit(o).alias("offset")) for r, (p, o) in roles.items()))
    want = spine.select(day, F.inline(listed)).withColumn("__valid", F.date_add(day, F.col("offset")))
    have = files.select("product", F.col(day).alias("__valid"), "path")
    return want.join(have, ["product", "__valid"], "left").select(day, "role", "path")


def greedy_matches(df: DataFrame, by: list[str], at: str, true: str, most: int) -> DataFrame:
    """(by..., truth, model): each true event in order takes the nearest unused other within ``most``, ties to the earlier; unmatched ones of both stay.

    Which is unused depends on the order, so a group's events are folded together: an event list, never raw rows. From a
    true event's place in the sorted others both sides are looked at, past those that are used in one step.
    """
    key = by[0]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        truth, model = sorted(p.loc[p[true], at].tolist()), sorted(p.loc[~p[true], at].tolist())
        down, up = list(range(-1, len(model))), list(range(len(model) + 1))  # the next unused one at or below k - 1, at or above k

        def free(links: list[int], k: int, own: int) -> int:
            seen = []
            while links[k] != k - own:
                seen.append(k)
                k = links[k] + own
            for j in seen:
                links[j] = k - own
            return k - own

        rows, used = [], set()
        for t in truth:
            k = bisect_left(model, t)
            sides = [free(down, k, 1), free(up, k, 0)]
            near = min(((abs(model[j] - t), j) for j in sides if 0 <= j < len(model)), default=(math.inf, 0))
            if near[0] <= most:
                j = near[1]
                used.add(j)
                down[j + 1], up[j] = j - 1, j + 1
            rows.append((t, model[near[1]] if near[0] <= most else None))
        rows += [(None, m) for k, m in enumerate(model) if k not in used]
        out = pd.DataFrame(rows, columns=["truth", "model"], dtype="Int64")
        out.insert(0, key, p[key].iloc[0])
        return out

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, at, true).groupBy(key).applyInPandas(run, f"{key} {kind}, truth long, model long")
