"""Skeleton cutouts: blocks of segments cut into pieces per chunk, joined again by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.vec3 import cells
from terravane.operators import pyramid
from terravane.plans import components
from terravane.plans.numbering import number_rows

CHUNK = ["cx", "cy", "cz"]


def assign_chunks(vertices: DataFrame, shape: tuple, origin: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """Vertices moved by the origin, with their chunk."""
    moved = vertices.withColumns({a: F.col(a) - F.lit(float(o)) for a, o in zip("xyz", origin, strict=True)})
    return moved.withColumns(cells(shape, "c"))


def split_edges(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges within one chunk, edges across two), of chunked vertices and (v0, v1) edges."""
    at = F.struct(*CHUNK)
    both = edges
    for end in ("v0", "v1"):
        both = both.join(vertices.select(F.col("vertex_id").alias(end), at.alias(f"{end}_chunk")), end)
    same = F.col("v0_chunk") == F.col("v1_chunk")
    return both.where(same).drop("v0_chunk", "v1_chunk"), both.where(~same)


def pieces(vertices: DataFrame, edges: DataFrame, shape: tuple, origin: tuple = (0.0, 0.0, 0.0)) -> tuple[DataFrame, DataFrame]:
    """(vertices with chunk and piece, cross edges): a piece is what hangs together inside
    one chunk, named by its least vertex."""
    placed = assign_chunks(vertices, shape, origin)
    inside, across = split_edges(placed, edges)
    found = components.connected_components(inside, "v0", "v1").select(F.col("node").alias("vertex_id"), "component")
    named = placed.join(found, "vertex_id", "left").withColumn("piece", F.coalesce("component", "vertex_id")).drop("component")
    return named, across.select("v0", "v1")


def ingest(vertices: DataFrame, edges: DataFrame, shape: tuple, align: bool = True) -> dict[str, DataFrame]:
    """vertices (with chunk, piece, object_id), cross (links between pieces, from edges and
    from equal positions on chunk faces) and objects (manifest per segment), of vertices
    (vertex_id, segment_id, block, x, y, z) and edges (v0, v1) read block by block.
    With ``align`` the least corner becomes the origin."""
    low = vertices.agg(*[F.min(a).alias(a) for a in "xyz"]).first() if align else None
    origin = tuple(float(low[a] or 0.0) for a in "xyz") if align else (0.0, 0.0, 0.0)
    named, across = pieces(vertices, edges, shape, origin)
    chunk = F.concat_ws(".", *CHUNK)
    touching = pyramid.coincident_links(named.withColumn("chunk", F.concat_ws("/", chunk, F.col("block"))), shape)
    each = named.groupBy("segment_id", *CHUNK, "piece").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    place = Window.partitionBy(*CHUNK).orderBy("segment_id", "piece")
    fragments = each.withColumn("fragment", (F.row_number().over(place) - 1).cast("long"))
    objects = pyramid.object_index(fragments.select("segment_id", *CHUNK, "fragment"))
    return {
        "vertices": named.join(objects.select("segment_id", "object_id"), "segment_id"),
        "cross": across.union(touching.select("v0", "v1")),
        "objects": objects,
    }


def affine_4x4(transform: list[float]) -> list[float]:
    """A row-major 3x4 transform as 4x4."""
    if len(transform) != 12:
        raise ValueError("a transform has 12 numbers")
    return [float(v) for v in transform] + [0.0, 0.0, 0.0, 1.0]


def attach_properties(objects: DataFrame, properties: DataFrame) -> DataFrame:
    """Objects with their segment's properties: numbers 0 and texts empty where missing;
    properties of unknown segments are left out."""
    out = objects.join(properties, "segment_id", "left")
    rules = {"double": F.lit(0.0), "string": F.lit("")}
    for f in properties.schema:
        kind = f.dataType.simpleString()
        if f.name != "segment_id" and kind in rules:
            out = out.withColumn(f.name, F.coalesce(f.name, rules[kind]))
    return out


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a global vertex_id in the order of ``keys``."""
    return number_rows(rows, keys, "vertex_id")
