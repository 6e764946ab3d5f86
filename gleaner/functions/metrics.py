"""Named counters of fetches as one aggregate row, and their rendering as a tree."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fetch_metrics(fetched: DataFrame) -> DataFrame:
    """Counts over a fetched table: rows, distinct traces, documents, failures."""
    kind = F.col("kind")
    return fetched.agg(
        F.count("*").alias("rows"),
        F.count_distinct("_trace_key").alias("traces"),
        F.count_if(kind == "doc").alias("docs"),
        F.count_if(kind == "error").alias("failures"),
        F.count_if(kind == "nodoc").alias("nodocs"),
        F.count_distinct(F.when(kind == "doc", F.col("_trace_key"))).alias("traces_with_doc"),
        F.count_distinct(F.when(kind == "error", F.col("_trace_key"))).alias("traces_failed"),
        F.avg((kind == "error").cast("double")).alias("failure_rate"),
    )


def as_tree(metrics: dict[str, object], sep: str = ".") -> str:
    """Dotted names as nested JSON."""
    out: dict = {}
    for name, value in sorted(metrics.items()):
        at, *rest = [out, *name.split(sep)]
        for part in rest[:-1]:
            at = at.setdefault(part, {})
        at[rest[-1]] = value
    return json.dumps(out, indent=2)
