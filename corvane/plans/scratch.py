"""Lineage cuts for iterative plans: tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_ONE_MACHINE = re.compile(r"local(\[.*\])?$")  # local-cluster has executors of their own
_made: list[str] = []


def _at(spark: SparkSession, where: str):  # noqa: ANN202  a Hadoop FileSystem and Path
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


class Tables:
    """Tables for one query.  What isn't dropped goes with release(), or when the driver's JVM ends."""

    def __init__(self, spark: SparkSession) -> None:
        found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
        if not found and not _ONE_MACHINE.match(spark.sparkContext.master):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        if not found:
            spark.conf.set(SETTING, found := "file://" + tempfile.mkdtemp(prefix="corvane-"))
        self.spark, self.where, self.n = spark, f"{found.rstrip('/')}/corvane/{uuid.uuid4().hex}", 0
        fs, path = _at(spark, self.where)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _made.append(self.where)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(where := f"{self.where}/{self.n}")
        out = self.spark.read.schema(df.schema).parquet(where)
        out._corvane_table = where
        return out

    def drop(self, table: DataFrame) -> None:
        """Call it only when no later plan reads the table; one that is no table is left alone."""
        if where := getattr(table, "_corvane_table", None):
            fs, path = _at(self.spark, where)
            fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes the tables of all queries so far; call it when their results are written or read."""
    while _made:
        fs, path = _at(spark, _made.pop())
        fs.delete(path, True)
