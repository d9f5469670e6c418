"""Builds that run as streams: append-only, windowed, and stateful. Every file is in a folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources.packs import exists


def stream_of(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """The files of a table, one file or a folder of them, as a stream, so many at a time."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and returns what it wrote; run again it goes on where it stopped."""
    spark = stream.sparkSession
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out") if exists(spark, f"{folder}/out") else spark.createDataFrame([], stream.schema)


def append_new(stream: DataFrame, folder: str, key: list[str], part: Column | None = None) -> DataFrame:
    """Appends rows whose key isn't there yet, batch by batch; a batch that comes twice changes nothing.

    Rows lie in folders by ``part``, a range or digest of the key (by default one of 64 digests). A batch reads the keys
    of the folders that it touches and no others, so what it reads doesn't grow with what is written where keys
    come in ranges. Its rows go to folders of its own number, which a second try overwrites and doesn't compare with.
    A folder's rows meet in one task before they are written (in several if they are many), so that a batch writes one file to it and not one of every task.
    """
    spark = stream.sparkSession
    path = f"{folder}/rows"
    place = F.pmod(F.xxhash64(*key), F.lit(64)) if part is None else part

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        new = rows.dropDuplicates(key).withColumn("__part", place.cast("long")).persist()
        held = [p for r in new.select("__part").distinct().collect() if exists(session, p := f"{path}/__part={r[0]}")]
        if held:
            there = session.read.option("basePath", path).schema(new.schema.add("__batch", "long")).parquet(*held)
            fresh = new.join(there.where(F.col("__batch") != number).select(*key), key, "left_anti")
        else:
            fresh = new
        whole = fresh.withColumn("__batch", F.lit(number).cast("long")).hint("rebalance", "__part")
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__part", "__batch").parquet(path)
        new.unpersist()

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not exists(spark, path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.option("basePath", path).schema(stream.schema).parquet(path)


def window_means(stream: DataFrame, ts: str, value: str, by: list[str], length: str, late: str) -> DataFrame:
    """(start, by..., n, mean) of tumbling windows, each given out once the watermark has passed it."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return rows.select(F.col("w.start").alias("start"), *by, "n", "mean")


def complete_days(stream: DataFrame, ts: str, value: str, late: str) -> DataFrame:
    """(day, hours, mean) of days all of whose 24 hours came; others have a null mean."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w")).agg(F.bit_count(F.bit_or(F.expr(f"shiftleft(1, hour({ts}))"))).alias("hours"), F.avg(value).alias("mean"))
    return rows.select(F.to_date("w.start").alias("day"), "hours", F.when(F.col("hours") == 24, F.col("mean")).alias("mean"))


def streaks(stream: DataFrame, key: str, ts: str, flag: str, late: str) -> DataFrame:
    """(key, first, last, n): runs of rows with the flag, kept open in state until a row without it ends them; the last run is given out when time passes it."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None, None, 0]
        out = []
        if state.hasTimedOut:
            out, held = [(k[0], *held)], [None, None, 0]
        else:
            rows = pd.concat(list(parts)).sort_values(ts)
            for at, on in zip(rows[ts], rows[flag], strict=True):
                if on:
                    held = [held[0] or at, at, held[2] + 1]
                elif held[2]:
                    out.append((k[0], *held))
                    held = [None, None, 0]
        if held[2]:
            state.update((pd.Timestamp(held[0]).to_pydatetime(), pd.Timestamp(held[1]).to_pydatetime(), held[2]))
            state.setTimeoutTimestamp(max(int(pd.Timestamp(held[1]).timestamp() * 1000) + 86_400_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "first", "last", "n"])

    rows = stream.withWatermark(ts, late).select(key, ts, flag)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, first timestamp, last timestamp, n long", "first timestamp, last timestamp, n long", "append", GroupStateTimeout.EventTimeTimeout)
