"""Record algebra: merges, products and updates of typed rows, with an explicit policy for columns of the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Conflict(ValueError):
    """Two records define the same field and the policy forbids it."""


def merge_columns(left: list[str], right: list[str], policy: str) -> list[tuple[str, str]]:
    """(name, side) in the order of left, then what right adds. policy: right, left or error."""
    both = set(left) & set(right)
    if policy == "error" and both:
        raise Conflict(f"fields in both records: {sorted(both)}")
    if policy not in ("right", "left", "error"):
        raise ValueError(f"unknown policy {policy}")
    return [(c, "right" if c in both and policy == "right" else "left") for c in left] + [(c, "right") for c in right if c not in both]


def merge(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], policy: str = "right", how: str = "inner") -> DataFrame:
    """Rows joined on pairs of columns, with the fields of both."""
    a, b = left.alias("l"), right.alias("r")
    cond = [F.col(f"l.`{x}`") == F.col(f"r.`{y}`") for x, y in on]
    joined = a.join(b, cond, how)
    return joined.select(*[F.col(f"{'l' if s == 'left' else 'r'}.`{n}`").alias(n) for n, s in merge_columns(left.columns, right.columns, policy)])


def cartesian(left: DataFrame, right: DataFrame, policy: str = "right", most_right: int = 1_000_000) -> DataFrame:
    """All pairs of rows. The right side is counted and goes out in blocks of about ``most_right`` rows, one after the other."""
    names = merge_columns(left.columns, right.columns, policy)
    blocks = max(1, -(-right.count() // most_right))
    out = None
    for i in range(blocks):
        part = right.filter(F.pmod(F.xxhash64(*right.columns), F.lit(blocks)) == i) if blocks > 1 else right
        joined = left.alias("l").join(F.broadcast(part.alias("r")), how="cross")
        joined = joined.select(*[F.col(f"{'l' if s == 'left' else 'r'}.`{n}`").alias(n) for n, s in names])
        out = joined if out is None else out.unionAll(joined)
    return out


def lift(df: DataFrame) -> DataFrame:
    """A single unnamed column becomes the field ``value``."""
    return df.toDF("value") if len(df.columns) == 1 else df


def update(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Set a field; its place stays, and its type may change."""
    return df.withColumn(name, value)


def update_if_missing(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, value)


def append(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise Conflict(f"field exists: {name}")
    return df.withColumn(name, value)


def replace_if_not_null(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, F.coalesce(value, F.col(name)))


def append_to_array(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds to an array field; a plain field becomes an array first."""
    is_array = dict(df.dtypes)[name].startswith("array")
    old = F.col(name) if is_array else F.when(F.col(name).isNull(), F.expr("array()")).otherwise(F.array(name))
    return df.withColumn(name, F.concat(old, F.array(value)))


def explode_field(df: DataFrame, name: str) -> DataFrame:
    """One record for each element of a field, in its place."""
    return df.select(*[F.explode(c).alias(c) if c == name else F.col(c) for c in df.columns])


def sort_by_marked(df: DataFrame, marked: list[str], ascending: bool = True) -> DataFrame:
    """Only marked fields take part in the order."""
    return df.orderBy(*[F.col(c).asc() if ascending else F.col(c).desc() for c in df.columns if c in marked])


def runtime_map(df: DataFrame) -> DataFrame:
    """The record as a map of text."""
    return df.select(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))]).alias("fields"))
