"""What an archive holds, from file names alone."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a valid time stands in a name: year, day of year and hour, or year, month, day and hour.
BY_DAY, BY_MONTH = r"(\d{4}_\d{3}_\d{2})", r"(\d{10})"


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, modified) of the files a glob finds; contents aren't read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.col("modificationTime").alias("modified"))


def with_valid_time(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``valid``, parsed from the name; null if it has none."""
    name = F.element_at(F.split(path, "/"), -1)
    day, month = F.regexp_extract(name, BY_DAY, 1), F.regexp_extract(name, BY_MONTH, 1)
    valid = F.when(day != "", F.try_to_timestamp(day, F.lit("yyyy_DDD_HH"))).when(month != "", F.try_to_timestamp(month, F.lit("yyyyMMddHH")))
    return files.withColumn("valid", valid.cast("timestamp_ntz"))


def clashes(files: DataFrame, by: list[str], path: str = "path") -> DataFrame:
    """(by..., n) of times at which different files are valid; the same file seen twice is no clash."""
    return files.groupBy(*by).agg(F.count_distinct(path).alias("n")).where("n > 1")


def inventory(days: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    """(by..., year, days, missing): days present each year, and those missing between the kind's first and last."""
    got = days.select(*by, day).distinct()
    every = got.groupBy(*by).agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    rows = every.join(got.withColumn("__here", F.lit(1)), [*by, day], "left")
    return rows.groupBy(*by, F.year(day).alias("year")).agg(F.count("__here").alias("days"), F.count_if(F.col("__here").isNull()).alias("missing"))


def unreadable_dirs(pattern: str) -> list[str]:
    """Folders that a local glob would search but can't list; checked on the driver before a read."""
    folder, bad = os.path.dirname(pattern), []
    while glob.has_magic(folder):
        folder = os.path.dirname(folder)
    for top, dirs, _ in os.walk(folder or ".", onerror=lambda e: bad.append(e.filename)):
        bad += [p for d in dirs if not os.access(p := os.path.join(top, d), os.R_OK | os.X_OK)]
    return sorted(set(bad))
