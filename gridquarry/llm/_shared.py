"""Small things the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import cut

#: ASCII white space, as in the class ``[\x20\x09-\x0D]``.
SPACE = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Name of the row number that operators give their input.
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steady(df: DataFrame) -> DataFrame:
    """``df`` such that each reading of it, of whatever columns, finds its rows at the same places: stored, unless it is but a scan."""
    plans, names = [df._jdf.queryExecution().optimizedPlan()], set()
    while plans:
        plan = plans.pop()
        names.add(plan.nodeName())
        plans += [plan.children().apply(k) for k in range(plan.children().size())]
    return df if names <= {"Project", "Filter", "LogicalRelation", "LogicalRDD"} else cut(df)


def forget(df: DataFrame) -> None:
    """Removes what ``cut`` wrote; nothing may read ``df`` any more."""
    file = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def pinned(df: DataFrame) -> DataFrame:
    """``df`` with a row number that the operators take over, so that what they say of a row can be joined to it."""
    return _counted(df).withMetadata(ROW, {"pinned": True})


def numbered(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of ``df`` with a row number: that of a pinned table, else its own."""
    if ROW in df.columns and df.schema[ROW].metadata.get("pinned"):
        return df.select(ROW, *columns)
    return _counted(df.select(*columns))


def _counted(df: DataFrame) -> DataFrame:
    """``df`` with the place of each row: its split's number and its place therein.

    Files are split alike in every scan, whatever executors come and go: the one thing
    in which splits depend on those at hand, the least number of splits, is fixed.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return df.withColumn(ROW, F.monotonically_increasing_id())


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def map_rows(df: DataFrame, schema: StructType | str, rows: Callable[[list[list]], list[list]]) -> DataFrame:
    """Apply ``rows`` (columns in, columns out, as lists) to each Arrow batch of ``df``.

    Arrow batches are bounded in rows and in bytes, and so is what a task holds.
    """
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def arrow_schema(kind: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)
