"""Operators by key: merges, cogroups, reductions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = TypeVar("K")
V = TypeVar("V")


def union_by_key(left: DataFrame, right: DataFrame, key: str, **reduce: Column) -> DataFrame:
    """Full outer merge: all rows of both, reduced by key with partial aggregation."""
    return left.unionByName(right).groupBy(key).agg(*[c.alias(n) for n, c in reduce.items()])


def intersect_by_key(left: DataFrame, right: DataFrame, key: str, **reduce: Column) -> DataFrame:
    """Only keys that both sides have."""
    both = left.join(right, key, "left_semi").unionByName(right.join(left, key, "left_semi"))
    return both.groupBy(key).agg(*[c.alias(n) for n, c in reduce.items()])


def cogroup_left(left: DataFrame, right: DataFrame, key: str, **reduce: Column) -> DataFrame:
    """Each row of left with the reductions of its key's rows on the right, which are combined before the join."""
    return left.join(right.groupBy(key).agg(*[c.alias(n) for n, c in reduce.items()]), key, "left")


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", most_rows: int = 100_000) -> DataFrame:
    """Broadcasts the right side if a count of at most ``most_rows + 1`` rows shows it small, else leaves the choice to the planner."""
    small = right.limit(most_rows + 1).count() <= most_rows
    return left.join(F.broadcast(right) if small else right, on, how)


def reduce_together(df: DataFrame, key: str, **reduce: Column) -> DataFrame:
    """Reduced after rows of a key have been brought together, so that later steps by that key need no exchange."""
    return df.repartition(key).groupBy(key).agg(*[c.alias(n) for n, c in reduce.items()])


def reduce_local(rows: Iterable[tuple[K, V]], reduce: Callable[[V, V], V]) -> dict[K, V]:
    """Rows of one task by key, each key's values folded as they come."""
    out: dict[K, V] = {}
    for k, v in rows:
        out[k] = reduce(out[k], v) if k in out else v
    return out


def join_in_order(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join whose rows come in the order of the left table."""
    out = left.withColumn("_at", F.monotonically_increasing_id()).join(right, on, how)
    return out.orderBy("_at").drop("_at")


def reduce_latest(df: DataFrame, key: str, ts: str, *tie: str) -> DataFrame:
    """The row with the greatest time of each key; ties go to the greatest tie columns."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, *tie)).alias("v")).select(key, "v.*")


def batch_reduce(frames: list[DataFrame], reduce: Callable[[str], Column], column: str) -> DataFrame:
    """Many frames reduced in one job: (batch, value), one row for each frame with rows."""
    tagged = [f.select(F.lit(i).alias("batch"), F.col(column)) for i, f in enumerate(frames)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionAll(t)
    return whole.groupBy("batch").agg(reduce(column).alias("value"))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Callable[[], dict[str, object]]]:
    """df that counts while it runs, and a function that tells the counts afterwards."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), lambda: seen.get
