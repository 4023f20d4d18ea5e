"""Predicates over vertices, objects and links; all are AND-ed where-clauses or semi-joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.vec3 import cell

#: Explicit id lists longer than this become a semi-join.
_INLINE = 1000


def by_bbox(df: DataFrame, low: tuple, high: tuple, chunk: tuple | None = None) -> DataFrame:
    """Rows inside the closed box.  With ``chunk`` (and stored cx, cy, cz columns) the
    implied cell ranges are added, which prune files and row groups."""
    out = df
    for k, a in enumerate("xyz"):
        out = out.where(F.col(a).between(low[k], high[k]))
        if chunk:
            out = out.where(F.col(f"c{a}").between(int(low[k] // chunk[k]), int(high[k] // chunk[k])))
    return out


def by_ids(df: DataFrame, column: str, ids: Iterable[int] | DataFrame) -> DataFrame:
    """Rows whose ``column`` is among ``ids`` (a short list, or a table with that column)."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(column).distinct(), column, "left_semi")
    ids = list(ids)
    if len(ids) <= _INLINE:
        return df.where(F.col(column).isin(ids))
    return df.join(df.sparkSession.createDataFrame([(i,) for i in ids], f"{column} long").distinct(), column, "left_semi")


def by_groups(df: DataFrame, members: DataFrame, groups: Iterable[int]) -> DataFrame:
    """Rows of objects that belong to one of the groups (members: group_id, object_id)."""
    return df.join(by_ids(members, "group_id", groups).select("object_id").distinct(), "object_id", "left_semi")


def by_chunks(df: DataFrame, chunks: Iterable[tuple[int, int, int]], shape: tuple) -> DataFrame:
    """Rows in the listed chunks."""
    key = F.struct(*[cell(a, s).alias(a) for a, s in zip("xyz", shape, strict=True)])
    return df.where(key.isin([F.struct(*[F.lit(int(v)).cast("long").alias(a) for a, v in zip("xyz", c, strict=True)]) for c in chunks]))


def drop_na(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Without rows that have null or NaN in one of the columns."""
    out = df
    for c in columns:
        out = out.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return out


def drop_duplicates(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row (by ``order``) of each distinct tuple."""
    first = df.groupBy(*columns).agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")


def normalise(points: DataFrame, axes: str = "xyz") -> tuple[DataFrame, dict]:
    """(points moved to their mean and divided by the largest distance from it along an
    axis, {offset, scale}); the scale of points without extent is 1."""
    centre = points.agg(*[(F.sum(a) / F.count(F.lit(1)).cast("double")).alias(a) for a in axes]).first()
    offset = [centre[a] or 0.0 for a in axes]
    reach = points.agg(*[F.max(F.abs(F.col(a) - o)).alias(a) for a, o in zip(axes, offset, strict=True)]).first()
    scale = max((reach[a] or 0.0 for a in axes), default=0.0) or 1.0
    moved = {a: (F.col(a) - F.lit(o)) / F.lit(scale) for a, o in zip(axes, offset, strict=True)}
    return points.withColumns(moved), {"offset": offset, "scale": scale}


def by_length(objects: DataFrame, low: float, high: float, column: str = "length") -> DataFrame:
    """Objects with low <= length <= high."""
    return objects.where(F.col(column).between(low, high))


def edges_within(edges: DataFrame, vertices: DataFrame, ends: Iterable[str] = ("v0", "v1")) -> DataFrame:
    """Edges or faces all of whose ends are among the vertices."""
    for end in ends:
        edges = edges.join(vertices.select(F.col("vertex_id").alias(end)), end, "left_semi")
    return edges


def neighbour_chunks(chunks: DataFrame, halo: int = 1, include_self: bool = False) -> DataFrame:
    """cx, cy, cz, nx, ny, nz: occupied cells within ``halo`` of each occupied cell."""
    steps = F.array(*[F.lit(i).cast("long") for i in range(-halo, halo + 1)])
    around = chunks.select("cx", "cy", "cz")
    for a in "xyz":
        around = around.withColumn(f"d{a}", F.explode(steps))
    if not include_self:
        around = around.where("NOT (dx = 0 AND dy = 0 AND dz = 0)")
    around = around.select("cx", "cy", "cz", *[(F.col(f"c{a}") + F.col(f"d{a}")).alias(f"n{a}") for a in "xyz"])
    there = chunks.select(*[F.col(f"c{a}").alias(f"n{a}") for a in "xyz"])
    return around.join(there, ["nx", "ny", "nz"]).select("cx", "cy", "cz", "nx", "ny", "nz")
