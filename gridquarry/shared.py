"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a local session gets a temporary one, and any other is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="shared-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that it outlives executors and isn't computed again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of files, as Spark estimates them for the columns read, whose rows a task takes when they are dealt by key.
PART_BYTES = 4 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, columns and filters over a scan, dealt by keys into parts whose number grows with the files, so that what a task sorts or holds doesn't; at least the session's number."""
    return df.repartition(parts_of(df), *keys)


def parts_of(df: DataFrame, each: int | None = None) -> int:
    """Into how many parts ``spread`` deals ``df``, or so many of ``each`` bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (each or PART_BYTES)))


class Stored:
    """Rows in a table of their own in the shared folder. Unlike a checkpoint it doesn't carry its plan's estimated size on, which joins in a loop multiply."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark).rstrip('/')}/{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def forget(self) -> None:
        """Removes the table; nothing may read its rows any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
