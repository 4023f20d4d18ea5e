"""Coarsening by regular bins: points, graphs and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.vec3 import cells
from terravane.plans.numbering import number_rows

BIN = ["gx", "gy", "gz"]

#: How an attribute of a bin's members becomes the bin's own.
AGGREGATES = {
    "mean": lambda c, order: F.avg(c),
    "sum": lambda c, order: F.sum(c),
    "first": lambda c, order: F.min_by(c, order),
    "count": lambda c, order: F.count(c),
    "max": lambda c, order: F.max(c),
    "min": lambda c, order: F.min(c),
}


def binned(points: DataFrame, shape: tuple) -> DataFrame:
    """Points with their bin's gx, gy, gz."""
    return points.withColumns(cells(shape))


def metanodes(points: DataFrame, shape: tuple, attributes: tuple[str, ...] = (), mode: str = "mean", id_col: str = "vertex_id", children: bool = False) -> DataFrame:
    """One row per occupied bin: its centroid, member count and aggregated attributes."""
    rule = AGGREGATES[mode]
    made = [F.count(F.lit(1)).alias("n")]
    made += [(F.sum(a) / F.count(F.lit(1)).cast("double")).alias(a) for a in "xyz"]
    made += [rule(c, id_col).alias(c) for c in attributes]
    if children:
        made.append(F.sort_array(F.collect_list(id_col)).alias("children"))
    return binned(points, shape).groupBy(*BIN).agg(*made)


def medoids(points: DataFrame, shape: tuple, id_col: str = "vertex_id") -> DataFrame:
    """gx, gy, gz and the member nearest to the bin's centroid (the lowest id among equals)."""
    placed = binned(points, shape)
    centre = placed.groupBy(*BIN).agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s{a}") for a in "xyz"])
    # n times the offset from the centroid: exact for integer coordinates
    apart = [F.col(a) * F.col("n") - F.col(f"s{a}") for a in "xyz"]
    square = sum(d.cast("double") * d.cast("double") for d in apart)
    return placed.join(centre, BIN).groupBy(*BIN).agg(F.min_by(id_col, F.struct(square.alias("d"), id_col)).alias(id_col))


def majority(points: DataFrame, shape: tuple, value: str = "object_id") -> DataFrame:
    """gx, gy, gz and the most frequent value (the smallest among equals)."""
    counted = binned(points, shape).groupBy(*BIN, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*BIN).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value), F.max("n").alias("votes"))


def coarsen_points(points: DataFrame, shape: tuple, medoid: bool = False) -> DataFrame:
    """Centroid or medoid of each bin with its count and majority object."""
    base = metanodes(points, shape) if not medoid else medoids(points, shape).join(points.drop("object_id"), "vertex_id")
    return base.join(majority(points, shape), BIN)


def metavertices(points: DataFrame, shape: tuple) -> DataFrame:
    """vertex_id and its metavertex: occupied bins numbered from 0 in cell order."""
    placed = binned(points, shape)
    numbered = number_rows(placed.select(*BIN).distinct(), BIN, "metavertex")
    return placed.join(numbered, BIN).select("vertex_id", "metavertex")


def contract_edges(edges: DataFrame, mapping: DataFrame, weight: str | None = None) -> DataFrame:
    """v0 < v1 and summed weight of the edges between different mapped ends
    (mapping: vertex_id, to); edges without a weight count 1."""
    for end in ("v0", "v1"):
        edges = edges.join(mapping.select(F.col("vertex_id").alias(end), F.col("to").alias(f"m{end}")), end)
    value = F.lit(1).cast("long") if weight is None else F.col(weight)
    return (
        edges.where("mv0 <> mv1")
        .groupBy(F.least("mv0", "mv1").alias("v0"), F.greatest("mv0", "mv1").alias("v1"))
        .agg(F.sum(value).alias("weight"))
    )


def coarsen_graph(points: DataFrame, edges: DataFrame, shape: tuple, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Bins as nodes, and the contracted edges between them (ends are cell strings)."""
    key = F.concat_ws(",", *[F.col(b).cast("string") for b in BIN])
    mapping = binned(points, shape).select("vertex_id", key.alias("to"))
    return metanodes(points, shape), contract_edges(edges, mapping, weight)


def cluster_faces(faces: DataFrame, mapping: DataFrame) -> DataFrame:
    """Faces over mapped corners, without degenerate ones and with the first (by face_id)
    of those that share a corner set, in its own winding."""
    for k in range(3):
        faces = faces.join(mapping.select(F.col("vertex_id").alias(f"v{k}"), F.col("to").alias(f"m{k}")), f"v{k}")
    whole = faces.where("m0 <> m1 AND m1 <> m2 AND m0 <> m2").withColumn("corners", F.sort_array(F.array("m0", "m1", "m2")))
    best = whole.groupBy("corners").agg(F.min_by(F.struct("face_id", "m0", "m1", "m2"), "face_id").alias("f"))
    return best.select("f.face_id", F.col("f.m0").alias("v0"), F.col("f.m1").alias("v1"), F.col("f.m2").alias("v2"))


def coarsen_mesh(vertices: DataFrame, faces: DataFrame, shape: tuple) -> tuple[DataFrame, DataFrame]:
    """Bin centroids as vertices, and the clustered faces (corners are cell strings)."""
    key = F.concat_ws(",", *[F.col(b).cast("string") for b in BIN])
    return metanodes(vertices, shape), cluster_faces(faces, binned(vertices, shape).select("vertex_id", key.alias("to")))


def coarsen_mesh_to(vertices: DataFrame, faces: DataFrame, target_faces: int) -> tuple[DataFrame, DataFrame]:
    """Clustering with a bin edge chosen for about ``target_faces`` faces."""
    size = vertices.agg(F.count(F.lit(1)).alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in "xyz"]).first()
    have = faces.count()
    reduction = max(1.0, have / max(1, target_faces))
    edge = max(1e-9, (size["x"] + size["y"] + size["z"]) / 3 * reduction ** (1 / 3) / max(1, size["n"]) ** (1 / 3) * 2)
    return coarsen_mesh(vertices, faces, (edge, edge, edge))
