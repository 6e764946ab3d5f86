"""Property graphs as two tables, vertices (id, …) and edges (src, dst, …)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import cartesian


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def union(self, other: Graph) -> Graph:
        """Vertices by id (ours win), all edges."""
        more = other.vertices.join(self.vertices.select("id"), "id", "left_anti")
        return Graph(self.vertices.unionByName(more), self.edges.unionByName(other.edges))

    def evict(self, ids: DataFrame) -> Graph:
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(self.vertices.join(gone, "id", "left_anti"), edges.select(*self.edges.columns))

    def connect(self, edges: DataFrame) -> Graph:
        return Graph(self.vertices, self.edges.unionByName(edges))

    def dangling(self) -> DataFrame:
        """Edges with an end that is no vertex."""
        ids = self.vertices.select("id")
        known = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return self.edges.exceptAll(known.select(*self.edges.columns))

    def then(self, other: Graph) -> Graph:
        """Ours with our ends (no edge out) tied to the other's starts (no edge in), each to each."""
        ends = self.vertices.select("id").join(self.edges.select(F.col("src").alias("id")), "id", "left_anti")
        starts = other.vertices.select("id").join(other.edges.select(F.col("dst").alias("id")), "id", "left_anti")
        ties = cartesian(ends.select(F.col("id").alias("src")), starts.select(F.col("id").alias("dst")))
        return self.union(other).connect(ties)
