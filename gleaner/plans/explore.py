"""Breadth-first exploration: a driver loop of joins, one level at a time, with visited keys pruned by an anti-join."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut in the folder that all executors share, so that the loss of one costs nothing."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix=f"gleaner-{uuid.uuid4().hex[:8]}-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def explore(
    roots: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    key: str,
    min_depth: int = 0,
    max_depth: int = 2**31 - 1,
    checkpoint_interval: int = 4,
    per_root: bool = False,
    all_ways: bool = False,
) -> DataFrame:
    """Rows of all levels with ``depth`` and ``lineage`` (an id of their own for each row of ``roots``).

    ``step`` maps a frontier (columns key, lineage, depth, pos) to rows (key, lineage, pos) of the next level. A key counts at its smallest depth; of
    several ways at one depth, the smallest (pos, lineage) wins. Depths run from ``min_depth`` to ``max_depth - 1``: an upper bound is exclusive.
    Roots are visited even if they repeat a key. ``per_root`` keeps the visited keys of each root apart. ``all_ways`` tells every row by which the
    winning lineage reaches a key, not only the one of the smallest place.
    """
    same = [key, "lineage"] if per_root else [key]
    cols = [key, "lineage", "pos"]
    base = roots.select(key, F.monotonically_increasing_id().alias("lineage"), F.lit(0).cast("long").alias("pos"))
    frontier = cut(base.withColumn("depth", F.lit(0)))
    if max_depth <= 0:
        return frontier.limit(0).select(key, "lineage", "pos", "depth")
    levels, visited, depth = [frontier], frontier.select(*same).distinct(), 0
    while depth + 1 < max_depth:
        depth += 1
        ways = step(frontier).select(*cols).filter(F.col(key).isNotNull())
        best = F.row_number().over(Window.partitionBy(*same).orderBy("pos", "lineage"))
        # combined per key before the window, so a key reached by very many ways is small when it is ranked
        nxt = ways.groupBy(key, "lineage").agg(F.min("pos").alias("pos")).join(visited, same, "left_anti")
        nxt = nxt.withColumn("_r", best).filter("_r = 1").drop("_r").withColumn("depth", F.lit(depth))
        frontier = cut(nxt.select(key, "lineage", "pos", "depth"))
        if frontier.isEmpty():
            break
        levels.append(cut(ways.join(frontier.select(key, "lineage", "depth"), [key, "lineage"]).select(key, "lineage", "pos", "depth")) if all_ways else frontier)
        visited = visited.unionAll(frontier.select(*same))
        if depth % checkpoint_interval == 0:
            visited = cut(visited)
    out = levels[0].select(key, "lineage", "pos", "depth")
    for level in levels[1:]:
        out = out.unionAll(level.select(key, "lineage", "pos", "depth"))
    return out.filter(F.col("depth") >= min_depth)


def edges_step(edges: DataFrame, key: str, source: str, target: str, pos: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A step along a table of edges; ``pos`` orders the edges of a node."""
    steps = edges.select(F.col(source).alias("_from"), F.col(target).alias("_to"), (F.col(pos).cast("long") if pos else F.lit(0).cast("long")).alias("pos"))

    def step(frontier: DataFrame) -> DataFrame:
        return frontier.select(key, "lineage").join(steps, F.col(key) == F.col("_from")).select(F.col("_to").alias(key), "lineage", "pos")

    return step


def cheapest_paths(edges: DataFrame, source: str, target: str, cost: str, root: object) -> DataFrame:
    """(node, cost): least costs from a root by relaxation; only nodes that improved are relaxed again. A negative cycle is an error."""
    spark = edges.sparkSession
    best = cut(spark.range(1).select(F.lit(root).alias("node"), F.lit(0.0).alias("cost")))
    active = best
    for done in itertools.count():
        if done and done % 100 == 0 and done > edges.select(F.col(target)).distinct().count():
            raise ValueError("costs do not settle: there is a negative cycle")
        offers = active.join(edges, F.col("node") == F.col(source)).select(F.col(target).alias("node"), (F.col("cost") + F.col(cost)).alias("offer"))
        offers = offers.groupBy("node").agg(F.min("offer").alias("offer"))
        active = cut(offers.join(best, "node", "left").filter(F.col("cost").isNull() | (F.col("offer") < F.col("cost"))).select("node", F.col("offer").alias("cost")))
        if active.isEmpty():
            return best
        best = cut(best.join(active.select("node"), "node", "left_anti").unionByName(active))
