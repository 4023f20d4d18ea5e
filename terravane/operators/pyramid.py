"""Levels of decreasing detail: coarsening, links between levels, object tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions.vec3 import cell, cells, norm, sub, vec
from terravane.operators import binning, paths, selection, trees
from terravane.plans import runtime
from terravane.plans.numbering import number_rows



class CoarseningError(RuntimeError):
    """No coarsener is registered under a name, or a level cannot be made."""


@dataclass
class Level:
    """One level: vertices (object_id, seq, vertex_id, x, y, z), parents (vertex_id,
    parent: the level above's vertex), and the figures it was made with."""

    number: int
    vertices: DataFrame
    parents: DataFrame | None = None
    settings: dict = field(default_factory=dict)


_registry: dict[str, Callable] = {}


def register_coarsener(name: str, function: Callable) -> None:
    _registry[name] = function


def get_coarsener(name: str) -> Callable:
    if name not in _registry:
        raise CoarseningError(f"no coarsener named {name!r}")
    return _registry[name]


def objects_of(vertices: DataFrame) -> DataFrame:
    """object_id with its vertex count and length."""
    return paths.lengths(vertices)


def survivors(level: DataFrame, factor: float, strategy: str, seed: int, shape: tuple | None = None) -> DataFrame:
    """Objects kept when one in ``factor`` stays; "coverage" and "thinning" need the bin shape."""
    if factor <= 1:
        return level.select("object_id").distinct()
    column = {"length": "length", "attribute": "n"}.get(strategy)
    points = paths.representatives(level) if strategy in ("coverage", "thinning") else None
    return selection.apply_sparsity(objects_of(level), 1.0 / factor, strategy, column, points, shape, seed)


def per_object(level: DataFrame, shape: tuple, factor: float = 1.0, strategy: str = "random", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Surviving objects over shared bin centroids: (vertices, parents).

    Bins are formed over the survivors only.  Each object visits its bins in order,
    repeats in a row once.  Parents maps each vertex of the level below to its bin's
    vertex, or to -1 if the bin does not survive.
    """
    alive = runtime.materialize(level.join(survivors(level, factor, strategy, seed, shape), "object_id", "left_semi"), "level-alive")
    nodes = number_rows(binning.metanodes(alive, shape), binning.BIN, "vertex_id")
    nodes = runtime.materialize(nodes, "level-nodes")
    placed = alive.withColumns(cells(shape)).join(nodes.select(*binning.BIN, "vertex_id").withColumnRenamed("vertex_id", "m"), binning.BIN)
    new = F.coalesce(F.col("m") != F.lag("m").over(paths.ordered()), F.lit(True))
    kept = placed.withColumn("new", new).where("new").withColumn("place", (F.row_number().over(paths.ordered()) - 1).cast("long"))
    out = kept.select("object_id", F.col("place").alias("seq"), F.col("m").alias("vertex_id")).join(nodes.select("vertex_id", "x", "y", "z"), "vertex_id")
    below = level.withColumns(cells(shape)).join(nodes.select(*binning.BIN, F.col("vertex_id").alias("parent")), binning.BIN, "left")
    return out.select("object_id", "seq", "vertex_id", "x", "y", "z"), below.select("vertex_id", F.coalesce("parent", F.lit(-1)).alias("parent")).distinct()


def polyline(level: DataFrame, shape: tuple, factor: float = 1.0, strategy: str = "length", seed: int = 0, epsilon: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Surviving paths simplified by Douglas-Peucker (epsilon: half the least bin edge)."""
    alive = runtime.materialize(level.join(survivors(level, factor, strategy, seed, shape), "object_id", "left_semi"), "level-alive")
    thin = paths.simplify(alive, epsilon if epsilon is not None else min(shape) * 0.5)
    # a vertex belongs to the last kept one at or before it on its path
    kept = runtime.materialize(thin.select("object_id", "seq", "vertex_id", "x", "y", "z"), "level-paths")
    own = alive.join(kept.select("object_id", "seq", F.col("vertex_id").alias("k")), ["object_id", "seq"], "left")
    parents = own.withColumn("parent", F.last("k", ignorenulls=True).over(paths.ordered().rowsBetween(Window.unboundedPreceding, 0)))
    every = level.select("vertex_id").distinct().join(parents.select("vertex_id", "parent"), "vertex_id", "left")
    return kept, every.select("vertex_id", F.coalesce("parent", F.lit(-1)).alias("parent"))


def tree_objects(level: DataFrame) -> DataFrame:
    """object_id, n, length of forests (vertex_id, parent, x, y, z): summed edge lengths."""
    up = level.select(F.col("vertex_id").alias("parent"), *[F.col(a).alias(f"p{a}") for a in "xyz"])
    long = level.join(up, "parent", "left").withColumn("step", F.coalesce(norm(sub(vec(), vec("p"))), F.lit(0.0)))
    return long.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("length"))


def skeleton(level: DataFrame, shape: tuple, factor: float = 1.0, strategy: str = "length", seed: int = 0, stride: int = 8, least: int = 0, attributes: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Surviving trees (object_id, vertex_id, parent, x, y, z) thinned along their paths.

    Kept are roots, ends and branching vertices, both ends of edges that cross from one
    target chunk (``shape``) to another, and every ``stride``-th vertex below a kept
    anchor.  Vertices keep their numbers; ``attributes`` (name -> rule) are taken over
    the vertices that a kept one stands for.  Objects with at most ``least`` vertices
    inside a chunk, none of them on its faces, are left out there.  Parents maps each
    vertex to the nearest kept one at or above it, or to -1.
    """
    if factor <= 1:
        alive_ids = level.select("object_id").distinct()
    elif strategy in ("coverage", "thinning"):
        tops = level.groupBy("object_id").agg(F.min_by(F.struct("x", "y", "z"), "vertex_id").alias("p")).select("object_id", "p.*")
        alive_ids = selection.apply_sparsity(tree_objects(level), 1.0 / factor, strategy, None, tops, shape, seed)
    else:
        alive_ids = selection.apply_sparsity(tree_objects(level), 1.0 / factor, strategy, {"length": "length", "attribute": "n"}.get(strategy), None, None, seed)
    alive = runtime.materialize(level.join(alive_ids, "object_id", "left_semi"), "level-alive")
    tree = alive.select("object_id", "vertex_id", "parent")
    at = alive.select("vertex_id", F.struct(*cells(shape).values()).alias("chunk"))
    ends = tree.where("parent >= 0").join(at, "vertex_id").join(at.select(F.col("vertex_id").alias("parent"), F.col("chunk").alias("up")), "parent")
    crossing = ends.where("chunk <> up").select(F.explode(F.array("vertex_id", "parent")).alias("vertex_id")).distinct()
    kept = runtime.materialize(trees.decimated(tree, stride, crossing), "level-kept")
    thin = trees.collapse(tree, kept, attributes, alive if attributes else None)
    rest = [c for c in alive.columns if c not in ("parent", *(attributes or {}))]
    out = alive.select(*rest).join(thin, "vertex_id")
    if least:
        out = drop_interior(out, shape, least)
    out = runtime.materialize(out, "level-trees")
    own = out.select("vertex_id", F.lit(True).alias("own"))
    up = trees.nearest_marked(tree, out.select("vertex_id")).join(own, "vertex_id", "left")
    owner = up.select("vertex_id", F.when(F.col("own"), F.col("vertex_id")).otherwise(F.col("anchor")).alias("to"))
    parents = level.select("vertex_id").join(owner, "vertex_id", "left").select("vertex_id", F.coalesce("to", F.lit(-1)).alias("parent"))
    return out, parents


register_coarsener("per_object", per_object)
register_coarsener("polyline", polyline)
register_coarsener("skeleton", skeleton)


def select_coarsener_key(columns: list[str], geometry: str = "points") -> str:
    """The coarsener for a level: trees (with a parent column) are thinned along their
    paths, streamlines simplified, everything else binned object by object."""
    if "parent" in columns:
        return "skeleton"
    return "polyline" if geometry == "streamline" else "per_object"


def coarsen_level(
    level: Level, shape: tuple, factor: float = 1.0, mode: str = "per_object", strategy: str = "random", seed: int = 0, bins: float | None = None, chunk_shape: tuple | None = None, **options
) -> Level:
    """The next level, with all it was made with as its settings.  ``shape`` is the bins';
    ``bins`` how many base bins they are wide.  Skeletons have no bins: their stride is the
    bin factor, rounded and at least 1, their shape that of the level's chunks, and
    random selection is by length."""
    if mode == "skeleton":
        if bins is not None:
            options.setdefault("stride", max(1, round(bins)))
        strategy = "length" if strategy == "random" else strategy
    used = chunk_shape if mode == "skeleton" and chunk_shape else shape
    vertices, parents = get_coarsener(mode)(level.vertices, used, factor, strategy, seed, **options)
    settings = {"shape": list(shape), "factor": factor, "mode": mode, "strategy": strategy, "seed": seed, "bins": bins, "chunk_shape": list(chunk_shape) if chunk_shape else None, **options}
    n = level.number + 1
    return Level(n, runtime.materialize(vertices, f"level-{n}"), runtime.materialize(parents, f"parents-{n}"), settings)


def build_pyramid(
    vertices: DataFrame,
    base_shape: tuple,
    factors: list[tuple[float, float]],
    mode: str = "per_object",
    strategy: str = "random",
    seed: int = 0,
    chunk_shape: tuple | None = None,
    chunk_scales: list[int | tuple] | None = None,
    **options,
) -> list[Level]:
    """Level 0 and one level for each (bin factor, object factor); a level's bins are the
    base bins times its own bin factor.  Its chunks are the chunks of the level below
    times its chunk scale, of all axes or of each (1 without scales; 2 for skeletons)."""
    if not factors:
        raise ValueError("no levels asked for")
    if chunk_scales is not None and len(chunk_scales) != len(factors):
        raise ValueError("a chunk scale is needed for every level")
    levels, chunks = [Level(0, vertices)], tuple(chunk_shape or base_shape)
    for i, (bins, objects) in enumerate(factors):
        scale = chunk_scales[i] if chunk_scales else 1
        if mode == "skeleton" and scale == 1:
            scale = 2
        by = scale if isinstance(scale, (tuple, list)) else (scale,) * len(chunks)
        chunks = tuple(float(c * k) for c, k in zip(chunks, by, strict=True))
        levels.append(coarsen_level(levels[-1], tuple(s * bins for s in base_shape), objects, mode, strategy, seed + i, bins, chunks, **options))
    return levels


def build_skeleton_pyramid(vertices: DataFrame, chunk_shape: tuple, strides: list[int], factors: list[float] | None = None, scale: int = 2, strategy: str = "length", seed: int = 0, attributes: dict[str, str] | None = None, least: int = 0) -> list[Level]:
    """Level 0 and one level for each stride; chunks grow by ``scale`` along each axis a level."""
    pairs = [(stride, factors[i] if factors else 1.0) for i, stride in enumerate(strides)]
    levels, chunks = [Level(0, vertices)], tuple(chunk_shape)
    for i, (stride, factor) in enumerate(pairs):
        chunks = tuple(float(c * scale) for c in chunks)
        levels.append(coarsen_level(levels[-1], chunk_shape, factor, "skeleton", strategy, seed + i, stride, chunks, least=least, attributes=attributes))
    return levels


def rebuild_from(levels: list[Level], source: int) -> list[Level]:
    """The levels above ``source``, made again with the settings they were made with."""
    out = levels[: source + 1]
    for old in levels[source + 1 :]:
        out.append(coarsen_level(out[-1], **old.settings))
    return out


def cross_level(levels: list[Level], depth: int = 1, storage: str = "explicit") -> DataFrame:
    """level, delta, v0, v1: links from a level's vertices to their ancestors up to
    ``depth`` levels above (-1: all); with ``explicit`` storage also the mirrored ones.
    Vertices without a parent (-1) have no link."""
    if storage not in ("explicit", "implicit"):
        raise ValueError(f"unknown storage {storage!r}")
    made, steps = [], {k: levels[k + 1].parents for k in range(len(levels) - 1)}
    reach = len(levels) if depth < 0 else depth
    for k in steps:
        link = steps[k].where("parent >= 0").select(F.col("vertex_id").alias("v0"), F.col("parent").alias("v1"))
        for d in range(1, reach + 1):
            made.append(link.select(F.lit(k).alias("level"), F.lit(d).alias("delta"), "v0", "v1"))
            if storage == "explicit":
                made.append(link.select(F.lit(k + d).alias("level"), F.lit(-d).alias("delta"), F.col("v1").alias("v0"), F.col("v0").alias("v1")))
            if k + d not in steps:
                break
            up = steps[k + d].where("parent >= 0").select(F.col("vertex_id").alias("v1"), F.col("parent").alias("up"))
            link = link.join(up, "v1").select("v0", F.col("up").alias("v1"))
    out = made[0]
    for x in made[1:]:
        out = out.union(x)
    return out


def object_index(records: DataFrame) -> DataFrame:
    """object_id (0, 1, ... by segment_id), segment_id and manifest, the ordered list of
    (cx, cy, cz, fragment), of (segment_id, cx, cy, cz, fragment) records."""
    item = F.struct("cx", "cy", "cz", "fragment")
    listed = records.groupBy("segment_id").agg(F.sort_array(F.collect_list(item)).alias("manifest"))
    return number_rows(listed, ["segment_id"], "object_id")


def coincident_links(vertices: DataFrame, shape: tuple, owner: str = "segment_id", chunk: str = "chunk") -> DataFrame:
    """Links between equal positions on a chunk face that several chunks of one owner hold:
    from the least vertex of the first chunk to that of each other chunk."""
    on_face = F.lit(False)
    for a, s in zip("xyz", shape, strict=True):
        on_face = on_face | (F.pmod(F.rint(a).cast("long"), F.lit(int(s))) == 0)
    per = vertices.where(on_face).groupBy(owner, "x", "y", "z", chunk).agg(F.min("vertex_id").alias("v"))
    ends = per.groupBy(owner, "x", "y", "z").agg(F.sort_array(F.collect_list(F.struct(chunk, "v"))).alias("c")).where(F.size("c") > 1)
    return ends.select(owner, F.get("c", F.lit(0))["v"].alias("v0"), F.explode(F.slice("c", 2, F.size("c") - 1)).alias("o")).select(owner, "v0", F.col("o.v").alias("v1"))


def rechunk(objects: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Objects with ``bin``: how many of the ascending ``edges`` are at or below the value."""
    return objects.withColumn("bin", sum((F.col(column) >= e).cast("long") for e in edges))


def target_chunks(vertices: DataFrame, shape: tuple, scale: int) -> DataFrame:
    """Occupied chunks with the coarser chunk (``scale`` of them along each axis) they fall in."""
    base = vertices.select(*[cell(a, s).alias(f"c{a}") for a, s in zip("xyz", shape, strict=True)]).distinct()
    return base.withColumns({f"t{a}": F.floor(F.col(f"c{a}") / F.lit(float(scale))).cast("long") for a in "xyz"})


def drop_interior(level: DataFrame, shape: tuple, least: int) -> DataFrame:
    """Vertices without those of objects that, in a chunk, have at most ``least`` vertices
    and none on the chunk's outer faces."""
    face = F.lit(False)
    for a, s in zip("xyz", shape, strict=True):
        face = face | (F.pmod(F.rint(a).cast("long"), F.lit(int(s))) == 0)
    placed = level.withColumns(cells(shape, "c"))
    keys = ["object_id", "cx", "cy", "cz"]
    kept = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(face).alias("f")).where((F.col("n") > least) | F.col("f"))
    return placed.join(kept.select(*keys), keys, "left_semi").select(*level.columns)


def attach(objects: DataFrame, alive: DataFrame) -> DataFrame:
    """Object attributes carried to a coarser level: a row for every object, present or
    not, with null attributes where it is absent."""
    flag = alive.select("object_id").distinct().withColumn("present", F.lit(True))
    out = objects.join(flag, "object_id", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    return out.select("object_id", "present", *[F.when(F.col("present"), F.col(c)).alias(c) for c in objects.columns if c != "object_id"])
