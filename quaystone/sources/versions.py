"""Versioned tables: a keyed update that loses no other writer's rows, by whole versions and an atomic commit.

A table is a folder. ``data/<id>`` holds a version's rows as Parquet; ``versions/<20 digits>`` is a file that names the data of that version,
created without overwriting, which file systems do atomically: of two writers that started from one version, the second finds
its number taken and gets Conflict. Readers take the highest number, so they see whole versions only, and a failed write leaves no trace but
a folder that nothing names.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaystone.sources.sinks import update_rows


#: Seconds after which a version's file that is still empty is taken for a dead writer's.
STALE_SECONDS = 600


class Conflict(RuntimeError):
    """Another writer has committed since the version that this write started from."""


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, rest: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{rest}" if rest else self.folder)

    def _marks(self) -> dict[int, tuple[int, float]]:
        """Of each version's file its length and its age in seconds."""
        folder = self._path("versions")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return {int(s.getPath().getName()): (s.getLen(), time.time() - s.getModificationTime() / 1000) for s in found}

    def versions(self) -> list[int]:
        """Committed versions, oldest first. A file that is still empty is being written."""
        return sorted(v for v, (length, _) in self._marks().items() if length)

    def latest(self) -> int:
        """The highest version; 0 of a table without any."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.latest() if version is None else version
        if version < 1:
            raise FileNotFoundError(f"{self.folder} has no version")
        source = self._fs.open(self._path(f"versions/{version:020d}"))
        try:
            name = source.readUTF()
        finally:
            source.close()
        return self.spark.read.parquet(f"{self.folder}/data/{name}")

    def commit(self, rows: DataFrame, base: int) -> int:
        """Write ``rows`` as version ``base`` + 1; Conflict if that version is there or being written."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}")
        mark = self._path(f"versions/{base + 1:020d}")
        self._fs.mkdirs(mark.getParent())
        try:
            marks = self._marks()
            if any(v > base and length for v, (length, _) in marks.items()):
                raise Conflict(f"{self.folder} has moved on from version {base}")
            length, age = marks.get(base + 1, (1, 0.0))
            if not length and age > STALE_SECONDS:  # its writer died before it wrote the name
                self._fs.delete(mark, False)
            try:
                out = self._fs.create(mark, False)  # fails if it exists
            except Exception as e:
                raise Conflict(f"{self.folder}: version {base + 1} is taken") from e
            out.writeUTF(name)
            out.close()
        except Conflict:
            self._fs.delete(self._path(f"data/{name}"), True)
            raise
        return base + 1

    def update(self, changes: DataFrame, key: str, attempts: int = 5) -> int:
        """Rows of equal key get the columns of ``changes``; the new version. On a conflict it is done again on what is there by then."""
        return self.retry(lambda rows: update_rows(rows, changes, key), attempts)

    def retry(self, change: Callable[[DataFrame], DataFrame], attempts: int = 5) -> int:
        for left in range(attempts, 0, -1):
            base = self.latest()
            try:
                return self.commit(change(self.read(base)), base)
            except Conflict:
                if left == 1:
                    raise
        raise ValueError("no attempt was allowed")
