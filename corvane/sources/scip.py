"""Symbol indexes in the public SCIP protobuf format, and which indexer a language has.

Only the fields that occurrences need are read: Index.metadata (1) and .documents (2), a document's
path (1) and occurrences (2), an occurrence's symbol (2) and roles (3), the tool's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFINITION = 1  # the role bit
# Extensions of languages, the languages that have an indexer, and what stands for none.
EXTENSIONS = {"ts": "ts", "tsx": "ts", "py": "py", "rs": "rs", "go": "go", "java": "java"}
INDEXERS = {"ts": "scip-typescript", "py": "scip-python"}
HOLE = "honest-hole"


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a number of more than 64 bits")


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(field number, value) of one message: numbers as they are, texts and messages as their bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise ValueError("a field is cut off")
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def occurrences(data: bytes) -> Iterator[tuple[str, int, str, str]]:
    """(path, ord, symbol, role) of every occurrence in an index, in the documents' order."""
    for field, document in fields(memoryview(data)):
        if field != 2:
            continue
        path, some = "", []
        for f, value in fields(document):
            if f == 1:
                path = bytes(value).decode()
            elif f == 2:
                told = dict(fields(value))
                some.append((bytes(told.get(2, b"")).decode(), int(told.get(3, 0))))
        for i, (symbol, roles) in enumerate(some):
            yield path, i, symbol, "definition" if roles & DEFINITION else "reference"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0).to_pylist():
            try:
                rows = list(occurrences(content))
            except (ValueError, IndexError, TypeError, UnicodeDecodeError):
                continue  # a corrupt index is an empty one
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["path", "ord", "symbol", "role"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, ord, symbol, role of all index files under a path (a folder or a glob); missing or corrupt ones give no rows."""
    schema = "path string, ord int, symbol string, role string"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(where)
    if not found or not len(found):
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_decode, schema)


def indexer(data: bytes) -> str | None:
    """The name of the tool that wrote an index; null if it doesn't say or can't be read."""
    try:
        meta = next(v for f, v in fields(memoryview(data)) if f == 1)
        tool = next(v for f, v in fields(meta) if f == 2)
        return bytes(next(v for f, v in fields(tool) if f == 1)).decode()
    except (StopIteration, ValueError, IndexError, TypeError, UnicodeDecodeError):
        return None


def index_plan(paths: DataFrame) -> DataFrame:
    """lang, files, tool of the languages of some paths: an indexer, or the hole that stands for none."""
    ext = F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), -1)
    table = lambda of: F.create_map(*(F.lit(x) for kv in of.items() for x in kv))
    rows = paths.where(F.contains(F.element_at(F.split("path", "/"), -1), F.lit("."))).select(F.try_element_at(table(EXTENSIONS), ext).alias("lang"))
    rows = rows.where("lang is not null").groupBy("lang").agg(F.count("*").alias("files"))
    return rows.withColumn("tool", F.coalesce(F.try_element_at(table(INDEXERS), F.col("lang")), F.lit(HOLE)))
