"""The versioned document cache: a table of (trace_key, ts, …), read as of a time.

The newest version with ``earliest <= ts < latest`` counts, where latest is the wayback time (or none) and earliest is the later of
``ignore_before`` and latest less the life span. Versions with an error are never written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_range(now: Column, life_seconds: int | None, wayback: Column | None = None, ignore_before: Column | None = None) -> tuple[Column | None, Column | None]:
    latest = wayback
    base = wayback if wayback is not None else now
    bounds = [b for b in ((base - F.make_interval(secs=F.lit(life_seconds))) if life_seconds is not None else None, ignore_before) if b is not None]
    return (F.greatest(*bounds) if len(bounds) > 1 else bounds[0] if bounds else None), latest


def as_of(versions: DataFrame, key: str, ts: str, earliest: Column | None = None, latest: Column | None = None) -> DataFrame:
    """One row per key: its newest version in the range. A partial aggregate, so a key with many versions is combined before the shuffle."""
    ok = F.lit(True)
    if earliest is not None:
        ok = ok & (F.col(ts) >= earliest)
    if latest is not None:
        ok = ok & (F.col(ts) < latest)
    rest = [c for c in versions.columns if c not in (key,)]
    newest = versions.filter(ok).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), F.xxhash64(*rest))).alias("v"))
    return newest.select(key, "v.*")


def check_wayback(wayback: Column, ignore_before: Column) -> Column:
    """The wayback time, or an error where it is not later than what is ignored."""
    return F.when(wayback > ignore_before, wayback).otherwise(F.raise_error(F.lit("wayback is not later than ignore_before")))


def storable(docs: DataFrame, key: str = "_trace_key", kind: str = "kind") -> DataFrame:
    """Documents of traces none of whose observations is an error."""
    bad = docs.filter(F.col(kind) == "error").select(key).distinct()
    return docs.join(bad, key, "left_anti")


def append(docs: DataFrame, path: str, key: str = "_trace_key") -> None:
    storable(docs, key).write.mode("append").parquet(path)
