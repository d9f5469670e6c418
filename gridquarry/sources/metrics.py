"""Training metrics: runs joined to their values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histories(runs: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """(name, values): each run's values of one metric in step order."""
    rows = metrics.where(F.col("key") == key).join(runs, "run_uuid")
    ordered = F.array_sort(F.collect_list(F.struct("step", "value")))
    return rows.groupBy("name").agg(F.transform(ordered, lambda x: x["value"]).alias("values"))


def curves(metrics: DataFrame, by: list[str], chunks: int = 12) -> DataFrame:
    """(by..., n, bad, medians): how many values, how many not finite, and the medians of equal chunks in step order, larger chunks first."""
    w = Window.partitionBy(*by).orderBy("step")
    rows = metrics.withColumn("__chunk", F.ntile(chunks).over(w)).withColumn("__v", F.when(~F.isnan("value"), F.col("value")))
    parts = rows.groupBy(*by, "__chunk").agg(F.count("*").alias("n"), F.count_if(F.col("__v").isNull()).alias("bad"), F.expr("percentile(__v, 0.5)").alias("m"))
    medians = F.transform(F.array_sort(F.collect_list(F.struct("__chunk", "m"))), lambda x: x["m"])
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), medians.alias("medians"))


def latest(metrics: DataFrame, by: list[str]) -> DataFrame:
    """(by..., value) at the last step."""
    return metrics.groupBy(*by).agg(F.max_by("value", "step").alias("value"))
