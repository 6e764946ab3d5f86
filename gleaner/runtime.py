"""Things around a job: clean-up, clocks, guards, jobs on single partitions or on every executor."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from contextlib import contextmanager
from functools import reduce
from typing import Any

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Temporary:
    """Persisted tables, views and broadcasts of a piece of work, released together, last first."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._undo = spark, []

    def persist(self, df: DataFrame) -> DataFrame:
        df.persist()
        self._undo.append(df.unpersist)
        return df

    def view(self, df: DataFrame, name: str) -> str:
        df.createOrReplaceTempView(name)
        self._undo.append(lambda: self.spark.catalog.dropTempView(name))
        return name

    def broadcast(self, value: Any) -> Any:
        shared = self.spark.sparkContext.broadcast(value)
        self._undo.append(shared.destroy)
        return shared

    def __len__(self) -> int:
        return len(self._undo)

    def release(self) -> None:
        while self._undo:
            self._undo.pop()()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Temporary]:
    held = Temporary(spark)
    try:
        yield held
    finally:
        held.release()


class Stopwatch:
    """Seconds by name; splits add up."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def split(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began


def with_heartbeat(run: Callable[[], Any], timeout: float, beat: Callable[[float], None], every: float = 1.0) -> Any:
    """The result of ``run`` within ``timeout`` seconds; ``beat`` hears now and then how long it has taken."""
    pool = ThreadPoolExecutor(1)
    began, work = time.monotonic(), pool.submit(run)
    try:
        while True:
            left = timeout - (time.monotonic() - began)
            if left <= 0:
                raise TimeoutError(f"no result after {timeout} s")
            try:
                return work.result(min(every, left))
            except Late:
                if work.done():  # the work's own timeout
                    raise
                beat(time.monotonic() - began)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


class DriverOnly:
    """A value that must not travel to an executor."""

    def __init__(self, value: Any) -> None:
        self.value = value

    def __reduce__(self) -> Any:
        raise TypeError("a value of the driver was about to be shipped")


class Session:
    """What an agent remembers of one trace: when it began, what it has done, what it opened."""

    def __init__(self, clock: Callable[[], float] = time.time) -> None:
        self.clock, self.started, self.backtrace, self._opened = clock, clock(), [], []

    def did(self, action: dict) -> None:
        self.backtrace.append(action)

    def open(self, make: Callable[[], Any]) -> Any:
        made = make()
        self._opened.append(made)
        return made

    @property
    def seconds(self) -> float:
        return self.clock() - self.started

    def close(self) -> None:
        while self._opened:
            self._opened.pop().close()


class Progress:
    """A file that counts what is read from and written to it."""

    def __init__(self, raw: Any, told: Callable[[int, int], None] | None = None) -> None:
        self._raw, self._told, self.n_read, self.n_written = raw, told, 0, 0

    def read(self, size: int = -1) -> Any:
        got = self._raw.read(size)
        self.n_read += len(got)
        self._tell()
        return got

    def write(self, data: Any) -> int:
        n = self._raw.write(data)
        self.n_written += len(data)
        self._tell()
        return n

    def _tell(self) -> None:
        if self._told:
            self._told(self.n_read, self.n_written)

    def __getattr__(self, name: str) -> Any:
        return getattr(self._raw, name)


def partition_later(df: DataFrame, partition: int, pool: ThreadPoolExecutor) -> Future:
    """The rows of one partition, by a job of its own beside others."""
    return pool.submit(lambda: df.filter(F.spark_partition_id() == partition).collect())


def disperse(df: DataFrame, n: int) -> DataFrame:
    """Into n times as many partitions without a shuffle: each reads its parent again and keeps a pseudo-random share of the rows."""
    share = F.pmod(F.xxhash64(*df.columns), F.lit(n))
    return reduce(DataFrame.unionAll, [df.filter(share == i) for i in range(n)])


def everywhere(spark: SparkSession, run: Callable[[], str], slots: int | None = None) -> DataFrame:
    """(slot, result): run once in each of as many tasks as there are cores."""
    n = slots or spark.sparkContext.defaultParallelism

    def go(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            yield pdf.assign(result=[run() for _ in range(len(pdf))])

    return spark.range(0, n, 1, n).withColumnRenamed("id", "slot").mapInPandas(go, "slot long, result string")


def deploy(spark: SparkSession, path: str) -> Callable[[], str]:
    """Sends a file to all executors; the function gives its place there: where it was if that exists, else the copy."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda: path if os.path.exists(path) else SparkFiles.get(name)


def conflicts(used: DataFrame, resource: str, user: str) -> DataFrame:
    """(resource, users): what several users hold at a time."""
    counted = used.groupBy(resource).agg(F.count_distinct(user).alias("users"))
    return counted.filter("users > 1")
