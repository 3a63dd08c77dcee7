"""Readers with explicit schemas: event logs, history, occurrences, bundles.  None of them infers a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_json, digest
from ..operators.events import LOG


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """An event log of one JSON object a line; blank and broken lines are left out."""
    rows = spark.read.schema(LOG + ", _broken string").option("columnNameOfCorruptRecord", "_broken").option("mode", "PERMISSIVE").json(path)
    return rows.where("_broken is null and id is not null").drop("_broken")


def write_jsonl(log: DataFrame, path: str) -> None:
    log.select(F.to_json(F.struct(*log.columns)).alias("value")).write.text(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """commit, author, is_fix, path from NUL-ended records `commit \\x1f author \\x1f subject \\n file \\n file ...`."""
    rows = spark.read.option("lineSep", "\x00").text(path).where(F.length(F.trim("value")) > 0)
    lines = F.filter(F.split(F.regexp_replace("value", r"^\n+", ""), "\n"), lambda x: x != "")
    head = F.split(F.element_at(lines, 1), "\x1f")
    return rows.select(
        F.get(head, 0).alias("commit"), F.get(head, 1).alias("author"), F.coalesce(F.get(head, 2).rlike("(?i)^fix"), F.lit(False)).alias("is_fix"),
        F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("path"),
    )


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """path, parent_path, depth, content of all files below a folder, with the directories above them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rest = F.regexp_replace(F.expr(f"substring(path, instr(path, '{folder.rstrip('/')}') + {len(folder.rstrip('/')) + 1})"), "^/+", "")
    leaves = files.select(F.concat(F.lit("repo/"), rest).alias("path"), F.decode("content", "UTF-8").alias("content"))
    parts = F.split("path", "/")
    folders = leaves.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    nodes = leaves.unionByName(folders.withColumn("content", F.lit(None).cast("string")))
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", ""))
    return nodes.select("path", parent.alias("parent_path"), (F.size(parts) - 1).alias("depth"), "content")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """hash, body of a content store (JSON lines hash, body) whose bodies have the digest that they are kept under."""
    rows = spark.read.schema("hash string, body string").json(path)
    return rows.where(digest(canonical_json(F.col("body"))) == F.col("hash"))


def merge_occurrences(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
