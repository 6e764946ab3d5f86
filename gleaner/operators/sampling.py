"""Down-sampling of arrays and groups; random choices are functions of a seed and the row, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(array: Column, seed: int = 0) -> Column:
    """Elements in an order given by the seed and their value and place."""
    keyed = F.transform(array, lambda x, i: F.struct(F.xxhash64(x, i, F.lit(seed)).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def first_n(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)


def by_ratio(array: Column, ratio: float, seed: int = 0) -> Column:
    return F.slice(shuffled(array, seed), F.lit(1), F.floor(F.size(array) * ratio).cast("int"))


def to_size(array: Column, n: int, seed: int = 0) -> Column:
    return F.slice(shuffled(array, seed), 1, n)


def any_one(array: Column, seed: int = 0) -> Column:
    return F.when(F.size(array) > 0, F.try_element_at(array, (F.pmod(F.xxhash64(array, F.lit(seed)), F.size(array)) + 1).cast("int")))


def sample_groups(df: DataFrame, by: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each group. The planner turns the filter on the rank into a limit per group ahead of the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def shuffled_rows(df: DataFrame, seed: int = 0) -> DataFrame:
    """All rows in an order given by the seed and the row."""
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed)), *df.columns)


def sample_rows(df: DataFrame, key: list[str], ratio: float, seed: int = 0) -> DataFrame:
    """Each row stays or goes by a hash of its key."""
    return df.filter(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) < int(ratio * 1_000_000))
