"""Snapshots of tables by generation, with optimistic commits."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TRIES = 64


class Conflict(RuntimeError):
    pass


class Generations:
    """`root/gen=N` is a file that names the folder of a whole snapshot.

    A writer reads the newest generation, writes a folder of its own, and then a file with that
    folder's name, which it links or renames to N + 1.  Neither overwrites a file, on a local disk
    (a link) or on a store with an atomic rename, so that of two writers exactly one gets the number;
    the other reads again.  A generation is whole from the moment it has its name, and a folder that a
    lost writer leaves is never read.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._path(self.root))

    def numbers(self) -> list[int]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[4:]) for n in found if n.startswith("gen="))

    def _folder(self, number: int) -> str:
        stream = self._fs.open(self._path(f"{self.root}/gen={number}"))
        try:
            return f"{self.root}/{stream.readUTF()}"
        finally:
            stream.close()

    def read(self, number: int | None = None) -> DataFrame:
        """A generation, by default the newest; an empty table if there is none."""
        if number is None:
            number = max(self.numbers(), default=None)
        if number is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(number))

    def _publish(self, folder: str, number: int) -> bool:
        """Gives a folder the number, if no other has it."""
        note, target = self._path(f"{self.root}/_note-{uuid.uuid4().hex}"), self._path(f"{self.root}/gen={number}")
        stream = self._fs.create(note, False)
        try:
            stream.writeUTF(folder)
        finally:
            stream.close()
        try:
            if self._fs.getScheme() != "file":
                return not self._fs.exists(target) and self._fs.rename(note, target)
            files, local = self.spark._jvm.java.nio.file.Files, lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                files.createLink(local(target), local(note))
            except Exception as e:  # py4j wraps what Java throws
                if "FileAlreadyExistsException" not in str(e):
                    raise
                return False
            return True
        finally:
            self._fs.delete(note, False)

    def commit(self, decide: Callable[[DataFrame], DataFrame]) -> int:
        """Publishes decide(newest) as the next generation; tries again if another writer was first."""
        for _ in range(TRIES):
            newest = max(self.numbers(), default=0)
            folder = f"data-{uuid.uuid4().hex}"
            decide(self.read(newest or None)).write.parquet(f"{self.root}/{folder}")
            if self._publish(folder, newest + 1):
                return newest + 1
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
        raise Conflict(f"{self.root}: no generation was free in {TRIES} tries")
