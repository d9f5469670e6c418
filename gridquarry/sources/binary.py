"""Archives of big-endian 32-bit records, read whole file by whole file on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records are padded to so many 32-bit words; values from here on are fills.
PAD, FILL = 4096, 1e29


def record_words(shape: tuple[int, int]) -> int:
    cells = shape[0] * shape[1]
    return -(-cells // PAD) * PAD


def read_records(spark: SparkSession, pattern: str, shape: tuple[int, int], names: list[str], stride: int = 1) -> DataFrame:
    """(path, name, y, x, value) of the named records, in file order; fills are null; a file of another size is an error.

    Only every ``stride``-th row and column is kept. A file is the unit of work, so files should be of archive size.
    """
    return decoded(spark.read.format("binaryFile").load(pattern).select("path", "content"), shape, names, stride)


def decoded(files: DataFrame, shape: tuple[int, int], names: list[str], stride: int = 1) -> DataFrame:
    """The same of files (path, content) already read."""
    words = record_words(shape)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = (a.ravel() for a in np.meshgrid(*(np.arange(0, n, stride) for n in shape), indexing="ij"))
        for p in parts:
            for path, content in zip(p["path"], p["content"], strict=True):
                if len(content) != 4 * words * len(names):
                    raise ValueError(f"{path} has {len(content)} bytes, not {4 * words * len(names)}")
                for k, name in enumerate(names):
                    v = np.frombuffer(content, ">f4", shape[0] * shape[1], 4 * words * k).reshape(shape)[::stride, ::stride].ravel().astype(float)
                    yield pd.DataFrame({"path": path, "name": name, "y": y, "x": x, "value": np.where(np.abs(v) < FILL, v, np.nan)})

    rows = files.mapInPandas(run, "path string, name string, y long, x long, value double")
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def read_depths(spark: SparkSession, path: str, shape: tuple[int, int]) -> DataFrame:
    """(y, x, depth) of a bottom depth record; invalid is 0."""
    rows = read_records(spark, path, shape, ["depth"])
    return rows.select("y", "x", F.coalesce("value", F.lit(0.0)).alias("depth"))
