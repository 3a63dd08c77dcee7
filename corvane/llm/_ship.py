"""Python stages whose code reaches the executors however the driver found it."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once for each context, as --py-files would.

    Bounds Arrow batches by BATCH_BYTES in a session that has no bound of its own: 10,000 rows of long
    texts would otherwise be one batch, on both sides.
    """
    context = spark.sparkContext
    if not spark._jsparkSession.sessionState().conf().contains(BATCH):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    package = Path(__file__).resolve().parent.parent
    if getattr(context, "_corvane_shipped", False) or not package.is_dir():
        return
    made = Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane-code.zip"  # Spark's own file server takes it from the driver
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(made))
    context._corvane_shipped = True


#: What a worker keeps from task to task of one stage; the first task of another kind of stage drops it.
kept: dict[Any, Any] = {}


def trim() -> None:
    """Gives free memory of this Python process back: it lives on for other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it keeps
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow(df: DataFrame, run: Any, schema: Any, keeps: bool = False) -> DataFrame:
    """df.mapInArrow(run, schema) with this package on the executors; for df.transform(arrow, run, schema).

    keeps: run uses `kept`.
    """
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corvane.llm import _ship  # the worker's own module, not a copy that came with the task

        if not keeps:
            _ship.kept.clear()
        yield from run(batches)
        _ship.trim()

    return df.mapInArrow(task, schema)
