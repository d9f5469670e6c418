"""Training packs: tables partitioned by day, built in steps that can be repeated."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import moments as mom


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@dataclass(frozen=True)
class Pack:
    """A folder of rows by day, statistics and the plan that owns it. Statistics are written last: with them it is complete."""

    spark: SparkSession
    folder: str

    @property
    def complete(self) -> bool:
        return exists(self.spark, f"{self.folder}/statistics/_SUCCESS")

    def rows(self, year: int | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/rows")
        return rows if year is None else rows.where(F.year("day") == year)

    def statistics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/statistics")

    def claim(self, plan: dict) -> None:
        """Writes the plan, or raises, naming the differing keys, if the folder has another."""
        path = f"{self.folder}/plan"
        if exists(self.spark, f"{path}/_SUCCESS"):
            held = json.loads(self.spark.read.text(path).first()[0])
            if differing := sorted(k for k in held.keys() | plan.keys() if held.get(k) != plan.get(k)):
                raise ValueError(f"{self.folder} belongs to another plan: {differing} differ")
        else:
            self.spark.createDataFrame([(json.dumps(plan, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def done(self) -> DataFrame:
        """The days written so far."""
        if not exists(self.spark, f"{self.folder}/rows"):
            return self.spark.createDataFrame([], "day date")
        return self.spark.read.schema("day date").parquet(f"{self.folder}/rows").select("day").distinct()

    def build(self, rows: DataFrame, plan: dict, days: DataFrame | None = None) -> Pack:
        """Writes the days of ``rows`` (day, cell, feature, value) that aren't there; run again it writes nothing."""
        self.claim(plan)
        todo = rows if days is None else rows.join(days, "day", "left_semi")
        todo = todo.join(self.done(), "day", "left_anti")
        todo.repartition("day").write.mode("append").partitionBy("day").parquet(f"{self.folder}/rows")
        return self

    def finish(self, chain: list[str], train_end: str) -> Pack:
        """Statistics over the training days."""
        rows = self.rows().where(F.col("day") <= F.lit(train_end).cast("date"))
        mom.train_statistics(rows, ["feature"], chain, "day", "value").write.mode("overwrite").parquet(f"{self.folder}/statistics")
        return self


def stacked(members: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Members' rows with their name; their coordinates must be equal."""
    frames = list(members.items())
    first = frames[0][1].select(*keys).distinct()
    for name, rows in frames[1:]:
        other = rows.select(*keys).distinct()
        if not first.exceptAll(other).isEmpty() or not other.exceptAll(first).isEmpty():
            raise ValueError(f"{name} has other {', '.join(keys)} than {frames[0][0]}")
    out = frames[0][1].withColumn("member", F.lit(frames[0][0]))
    for name, rows in frames[1:]:
        out = out.unionByName(rows.withColumn("member", F.lit(name)))
    return out


def overlaid(base: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """Base features and new ones side by side, where both exist."""
    return base.join(more, on)


def append_parts(spark: SparkSession, folder: str, rows: DataFrame, starts: DataFrame, horizon: int, digest: str) -> DataFrame:
    """Rollout rows whose (start) isn't there yet under the same horizon and checkpoint; others' parts are a clash."""
    path = f"{folder}/parts"
    if exists(spark, path):
        held = spark.read.parquet(path)
        if not held.where((F.col("horizon") != horizon) | (F.col("digest") != digest)).isEmpty():
            raise ValueError(f"{folder} holds parts of another horizon or checkpoint")
        rows = rows.join(held.select("start").distinct(), "start", "left_anti")
    rows.join(starts, "start", "left_semi").withColumns({"horizon": F.lit(horizon), "digest": F.lit(digest)}).write.mode("append").parquet(path)
    return spark.read.parquet(path)
