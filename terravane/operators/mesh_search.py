"""Nearest points and first hits on a mesh for whole tables of queries, by a grid of several levels.

A face lies in the cells that its box touches, at the level whose cells are as wide as
the box or wider (level k: ``size`` times 2^k), so in eight cells at most, however
large it is.  Rays walk through the cells of every level that has faces; points look into
the 27 cells around them, at levels that rise until the nearest face found is no
farther than those cells are sure to cover.  Queries and faces meet by equi-joins.
Ties go to the least face_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.vec3 import cross, dot, sub, vec
from terravane.operators.mesh import EPS, corner, nearest_on_triangle, with_corners
from terravane.plans import numbering, runtime

CELL = ["level", "gx", "gy", "gz"]
#: Rays of a task, and cells of a batch of walked ones.
WALKED = 1 << 14, 1 << 14


def gridded(vertices: DataFrame, faces: DataFrame, size: float, least: int = 0) -> DataFrame:
    """face_id, its corners and level, gx, gy, gz: a row for each cell a face lies in, at its
    own level or at ``least`` if that is higher."""
    solid = with_corners(vertices, faces)
    low, high = ({a: f(*[F.col(f"{a}{k}").cast("double") for k in range(3)]) for a in "xyz"} for f in (F.least, F.greatest))
    wide = F.greatest(*[high[a] - low[a] for a in "xyz"])
    own = F.greatest(F.lit(least), F.ceil(F.log2(F.greatest(wide, F.lit(size)) / F.lit(float(size)))).cast("int"))
    out = solid.select("face_id", *[f"{a}{k}" for a in "xyz" for k in range(3)], own.alias("level"))
    edge = F.lit(float(size)) * F.pow(F.lit(2.0), "level")
    for a in "xyz":  # a little wider than the box, so that rounding leaves no gap at a cell's face
        first, last = (F.floor((f(*[F.col(f"{a}{k}").cast("double") for k in range(3)])) / edge + s).cast("long") for f, s in ((F.least, -1e-9), (F.greatest, 1e-9)))
        out = out.withColumn(f"g{a}", F.explode(F.sequence(first, last)))
    return out


def in_box(origin: np.ndarray, way: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which rays do not certainly miss a box: an axis along which one does not move, or moves
    away, has its origin inside.  Slanted ones are left to ``ray_cells``."""
    outside = ((way <= 0) & (origin < low)) | ((way >= 0) & (origin > high))
    return ~outside.any(axis=1)


def ray_cells(origin: np.ndarray, unit: np.ndarray, low: np.ndarray, high: np.ndarray, edge: float, most: float = np.inf) -> np.ndarray:
    """The cells of one level that a ray passes inside a box, in order."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (low - origin) / unit, (high - origin) / unit
    level = unit == 0
    if ((origin < low) | (origin > high))[level].any():
        return np.zeros((0, 3), np.int64)
    begin = max(0.0, np.where(level, -np.inf, np.minimum(a, b)).max())
    end = min(most, np.where(level, np.inf, np.maximum(a, b)).min())
    if not begin <= end:
        return np.zeros((0, 3), np.int64)
    cuts = [np.array([begin, end])]
    for k in np.flatnonzero(~level):
        u, v = sorted(((origin[k] + unit[k] * begin) / edge, (origin[k] + unit[k] * end) / edge))
        cuts.append((np.arange(np.ceil(u), np.floor(v) + 1) * edge - origin[k]) / unit[k])
    t = np.unique(np.clip(np.concatenate(cuts), begin, end))
    # the middle of each stretch, and the crossings themselves for what touches only there
    at = np.unique(np.concatenate([t, (t[1:] + t[:-1]) / 2]))
    return np.unique(np.floor((origin + at[:, None] * unit) / edge).astype(np.int64), axis=0)


def cast_rays(vertices: DataFrame, faces: DataFrame, rays: DataFrame, size: float, max_distance: float | None = None) -> DataFrame:
    """ray_id, face_id, t, px, py, pz: the first face each ray (ray_id, ox, oy, oz, dx, dy,
    dz) hits, t units from its origin; rays that hit none, or have no direction, have no row."""
    grid = runtime.materialize(gridded(vertices, faces, size), "ray-grid")
    corners = [F.col(f"{a}{k}") for a in "xyz" for k in range(3)]
    box = grid.agg(*[f(g(*corners[3 * i : 3 * i + 3])).cast("double").alias(f"{n}{a}") for i, a in enumerate("xyz") for n, f, g in (("l", F.min, F.least), ("h", F.max, F.greatest))]).first()
    levels = sorted(r["level"] for r in grid.select("level").distinct().collect())  # some sixty at most
    low, high = (np.array([box[f"{n}{a}"] if box[f"{n}{a}"] is not None else 0.0 for a in "xyz"]) for n in "lh")
    most = np.inf if max_distance is None else float(max_distance)

    schema = "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, level int, gx long, gy long, gz long"
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(held: list[tuple]) -> pa.RecordBatch:
        n = np.array([len(cells) for *_, cells in held])
        ids, numbers = np.array([h[0] for h in held], np.int64), np.array([[*h[1], *h[2]] for h in held])
        cells = np.concatenate([h[4] for h in held])
        columns = [np.repeat(ids, n), *np.repeat(numbers, n, axis=0).T, np.repeat(np.array([h[3] for h in held], np.int32), n), *cells.T]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for batch in batches:
            ids, *numbers = (batch.column(k) for k in range(7))
            table = np.column_stack([c.to_numpy() for c in numbers]) if batch.num_rows else np.zeros((0, 6))
            meets = in_box(table[:, :3], table[:, 3:], low, high)
            for ray_id, row in zip(ids.to_numpy()[meets].tolist(), table[meets], strict=True):
                long = np.sqrt((row[3:] ** 2).sum())
                if not long > 0 or not np.isfinite(row).all():
                    continue
                unit = row[3:] / long
                for level in levels:
                    cells = ray_cells(row[:3], unit, low, high, size * 2.0**level, most)
                    if len(cells):
                        held.append((ray_id, row[:3], unit, level, cells))
                        size_held += len(cells)
                    if size_held >= WALKED[1]:
                        yield rows(held)
                        held, size_held = [], 0
        if held:
            yield rows(held)

    plain = rays.select(F.col("ray_id").cast("long").alias("ray_id"), *[F.col(f"{p}{a}").cast("double").alias(f"{p}{a}") for p in "od" for a in "xyz"])
    walked = plain.repartition(numbering.range_parts(plain, WALKED[0])).mapInArrow(walk, schema)
    met = walked.join(grid, CELL)
    # each level of terms is a column of its own, and the test follows an explode, or the
    # condition of the join would repeat them all
    o, d = vec("o"), vec("d")
    put = lambda df, name, terms: df.withColumns({f"{name}{a}": c for a, c in zip("xyz", terms, strict=True)})
    made = put(put(put(met, "e", sub(corner(1), corner(0))), "g_", sub(corner(2), corner(0))), "s", sub(o, corner(0)))
    e1, e2, s = vec("e"), vec("g_"), vec("s")
    made = put(put(made, "h", cross(d, e2)), "q", cross(s, e1)).withColumn("det", dot(e1, vec("h")))
    f = 1.0 / F.when(F.abs("det") < EPS, None).otherwise(F.col("det"))
    values = F.struct((f * dot(s, vec("h"))).alias("u"), (f * dot(d, vec("q"))).alias("v"), (f * dot(e2, vec("q"))).alias("t"))
    tested = made.select("ray_id", "face_id", *[f"{p}{a}" for p in "od" for a in "xyz"], F.explode(F.array(values)).alias("at")).select("*", "at.*").drop("at")
    hit = tested.where("u >= 0 AND v >= 0 AND u <= 1 AND u + v <= 1").where(F.col("t") > EPS)
    if max_distance is not None:
        hit = hit.where(F.col("t") <= max_distance)
    point = [(F.col(f"o{a}") + F.col("t") * F.col(f"d{a}")).alias(f"p{a}") for a in "xyz"]
    best = hit.groupBy("ray_id").agg(F.min(F.struct("t", "face_id", *point)).alias("b"))
    return best.select("ray_id", "b.face_id", "b.t", "b.px", "b.py", "b.pz")


def closest_points(vertices: DataFrame, faces: DataFrame, points: DataFrame, size: float, max_distance: float | None = None) -> DataFrame:
    """point_id, face_id, distance, px, py, pz: the nearest point of the mesh to each point
    (point_id, x, y, z), within ``max_distance`` if that is given.  Points with a missing
    or infinite coordinate have no row.  A point is compared with all faces in cells some
    twice as wide as its distance."""
    finite = F.lit(True)
    for a in "xyz":
        finite = finite & (F.abs(F.col(a).cast("double")) < float("inf"))
    left = runtime.materialize(points.where(finite).select("point_id", *[F.col(a).cast("double").alias(f"q{a}") for a in "xyz"]), "closest-open")
    done, level = None, 0
    if faces.isEmpty():
        return left.where("false").select("point_id", *[F.lit(None).cast(t).alias(n) for n, t in [("face_id", "long"), *[(c, "double") for c in ("distance", "px", "py", "pz")]]])
    while not left.isEmpty():
        grid = runtime.materialize(gridded(vertices, faces, size, level), "closest-grid")
        levels = [r["level"] for r in grid.select("level").distinct().collect()]  # some sixty at most
        near = left.withColumn("level", F.explode(F.array(*[F.lit(k) for k in sorted(levels)])))
        edge = F.lit(float(size)) * F.pow(F.lit(2.0), "level")
        for a in "xyz":
            at = F.floor(F.col(f"q{a}") / edge).cast("long")
            near = near.withColumn(f"g{a}", F.explode(F.sequence(at - 1, at + 1)))
        placed = nearest_on_triangle(near.join(grid, CELL), vec("q"))
        placed = placed.withColumn("far", dot(sub(vec("p"), vec("q")), sub(vec("p"), vec("q"))))
        best = placed.groupBy("point_id").agg(F.min(F.struct("far", "face_id", "px", "py", "pz")).alias("b"))
        sure = size * 2.0**level  # the cells around a point cover at least so much on every side
        last = max_distance is not None and sure >= max_distance
        found = best if last else best.where(F.sqrt("b.far") <= sure)
        found = runtime.materialize(found.select("point_id", "b.face_id", F.sqrt("b.far").alias("distance"), "b.px", "b.py", "b.pz"), "closest-found")
        done = found if done is None else done.union(found)
        runtime.forget(grid)
        if last:
            break
        past, left = left, runtime.materialize(left.join(found.select("point_id"), "point_id", "left_anti"), "closest-open")
        runtime.forget(past)
        level += 1
    if done is None:
        return closest_points(vertices, faces.where("false"), points, size)
    return done if max_distance is None else done.where(F.col("distance") <= max_distance)
