"""Tables written to the folder that all executors share (``spark.checkpoint.dir``).

They cut lineage in a way that survives the loss of an executor. A table lives until ``release`` or the end of the process.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import give_back

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []
_kept: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset in local mode, as in tests, a folder that is then set for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df as a table written once and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gleaner-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _written.append((spark, path))
    # shuffles of a query that ended are of no use; left to the driver's garbage collection they pile up
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """The same for a result that outlives ``release``; deleted at the end of the process."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gleaner-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone; nothing is left to ask
            pass


def trim_heaps(spark: SparkSession) -> None:
    """Has the JVMs of executors and driver collect their garbage, and so return heap to the system.

    A heap stays as large as the largest query made it, while the workers beside it grow in later ones. On a busy cluster an
    executor may get no task; its heap then stays as it is.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete every table written so far, and return freed memory; for callers whose results no longer depend on them."""
    _delete(_written)
    give_back()
    trim_heaps(spark)


atexit.register(lambda: _delete(_written + _kept))
