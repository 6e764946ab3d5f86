"""File operations through the cluster's own file systems, with locks that expire."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Store:
    """Paths of any scheme that the session's Hadoop configuration knows."""

    UNLOCK_AFTER = 30.0
    DELETE_AFTER = 3600.0

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):  # noqa: ANN202
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def delete(self, path: str, recursive: bool = False) -> bool:
        fs, where = self._at(path)
        return fs.delete(where, recursive)

    def move(self, source: str, target: str) -> bool:
        """A rename; on one file system it is atomic."""
        fs, where = self._at(source)
        return fs.rename(where, self._at(target)[1])

    def copy(self, source: str, target: str) -> bool:
        fs, where = self._at(source)
        other, to = self._at(target)
        return self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, where, other, to, False, self._conf)

    def create_new(self, path: str) -> bool:
        """False if the path exists."""
        fs, where = self._at(path)
        return fs.createNewFile(where)

    def age(self, path: str) -> float:
        fs, where = self._at(path)
        return time.time() - fs.getFileStatus(where).getModificationTime() / 1000

    @contextmanager
    def lock(self, path: str, wait: float = 10.0, step: float = 0.2) -> Iterator[None]:
        """Holds ``path.lock``; a lock older than ``UNLOCK_AFTER`` belongs to a dead process and is taken over."""
        name, until = path + ".lock", time.time() + wait
        while not self.create_new(name):
            if self.age(name) > self.UNLOCK_AFTER:
                self.delete(name)
            elif time.time() > until:
                raise TimeoutError(f"locked: {path}")
            else:
                time.sleep(step)
        try:
            yield
        finally:
            self.delete(name)
