"""Tables in the folder that all executors share; they cut lineage and outlive any executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_ONE_MACHINE = re.compile(r"local(\[.*\])?$")  # local-cluster has executors of their own
_made: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or a local one if it is unset and driver and executors are one process."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if found:
        return found.rstrip("/")
    if not _ONE_MACHINE.match(spark.sparkContext.master):
        raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
    spark.conf.set(SETTING, found := "file://" + tempfile.mkdtemp(prefix="corvane-"))
    return found


def _path(spark: SparkSession, where: str):  # noqa: ANN202  a Hadoop FileSystem and Path
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


class Scratch:
    """Writes tables for one operator call.  What isn't dropped goes with release(), or when the driver's JVM ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.where, self.n = spark, f"{root(spark)}/corvane/{name}-{uuid.uuid4().hex}", 0
        fs, path = _path(spark, self.where)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _made.append(self.where)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        where = f"{self.where}/{self.n}"
        df.write.option("compression", "zstd").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._corvane_table = where
        return out

    def drop(self, table: DataFrame) -> None:
        """Call it only when no later plan reads the table."""
        if where := getattr(table, "_corvane_table", None):
            fs, path = _path(self.spark, where)
            fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes the tables of all operator calls so far; call it when their results are written or read."""
    while _made:
        fs, path = _path(spark, _made.pop())
        fs.delete(path, True)
