"""Columns worked out when data come in: of points, paths, trees and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.operators import graph, neighbours, paths, trees


def points(rows: DataFrame, k: int, size: float) -> DataFrame:
    """``rows`` with ``knn_distance``: the mean distance to the k nearest others."""
    near = neighbours.knn_distance(rows, k, size).withColumnRenamed("distance", "knn_distance")
    return rows.join(near, "vertex_id", "left")


def objects(rows: DataFrame) -> DataFrame:
    """object_id, n: vertices of each object."""
    return rows.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


def path_objects(path: DataFrame) -> DataFrame:
    """object_id, n, length and both ends (ax, ay, az, bx, by, bz)."""
    ends = paths.endpoints(path).withColumnsRenamed({f"{a}{k}": f"{p}{a}" for k, p in enumerate("ab") for a in "xyz"})
    return paths.lengths(path).join(ends, "object_id")


def within_length(path: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """The paths whose length is in the closed range; None is no bound."""
    long = paths.lengths(path)
    if low is not None:
        long = long.where(F.col("length") >= low)
    if high is not None:
        long = long.where(F.col("length") <= high)
    return path.join(long.select("object_id"), "object_id", "left_semi")


def tree(rows: DataFrame) -> DataFrame:
    """Trees (vertex_id, parent, ...) with depth, strahler and kind (0 root, 1 branch, 2
    continuation, 3 end)."""
    return rows.join(trees.depths(rows), "vertex_id").join(trees.strahler(rows), "vertex_id").join(trees.kinds(rows), "vertex_id")


def network(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with degree (loops and repeats not counted), component and clustering
    coefficient; a vertex without edges has 0, itself and 0."""
    out = vertices.join(graph.degrees(edges, simple=True), "vertex_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    out = out.join(graph.connected_components(edges, vertices), "vertex_id")
    near = graph.clustering(edges).select("vertex_id", F.col("coefficient").alias("clustering"))
    return out.join(near, "vertex_id", "left").withColumn("clustering", F.coalesce("clustering", F.lit(0.0)))
