"""python -m terravane.cli convert|pyramid|validate|info ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators import enrich, pyramid
from terravane.plans.numbering import number_rows
from terravane.sources import binary, formats, precomputed, ranged, store

#: Format by file ending; others (lines, edgelist) need --format.
ENDINGS = {
    ".csv": "points", ".xyz": "points", ".las": "las", ".ply": "ply", ".swc": "swc", ".obj": "obj", ".stl": "stl", ".trk": "trk", ".tck": "tck", ".trx": "trx", ".graphml": "graphml"
}
FORMATS = [*dict.fromkeys(ENDINGS.values()), "lines", "edgelist"]


def numbers(text: str) -> tuple[float, ...]:
    return tuple(float(v) for v in text.split(","))


def build_factors(bins: str | None, objects: str | None) -> list[tuple[float, float]] | None:
    """Pairs of bin and object factors; None if neither is given, an error if their
    numbers differ."""
    if bins is None and objects is None:
        return None
    b, o = (list(numbers(x)) if x else None for x in (bins, objects))
    b, o = b or [1.0] * len(o), o or [1.0] * len(b)
    if len(b) != len(o):
        raise SystemExit("--bin-factors and --object-factors differ in length")
    return list(zip(b, o, strict=True))


def _single(rows: DataFrame) -> DataFrame:
    """All vertices as one object, in their order."""
    return rows.withColumns({"object_id": F.lit(0).cast("long"), "seq": F.col("vertex_id")})


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    return number_rows(rows, keys, "vertex_id")


def _mesh(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Meshes of several files with vertices and faces numbered throughout."""
    named = number_rows(vertices.withColumnRenamed("vertex_id", "own"), ["file", "own"], "vertex_id")
    for k in range(3):
        end = named.select("file", F.col("own").alias(f"v{k}"), F.col("vertex_id").alias(f"n{k}"))
        faces = faces.join(end, ["file", f"v{k}"]).drop(f"v{k}")
    faces = number_rows(faces.withColumnRenamed("face_id", "own"), ["file", "own"], "face_id").drop("own", "file")
    return _single(named.drop("own", "file")), faces.withColumnsRenamed({f"n{k}": f"v{k}" for k in range(3)})


def convert(
    spark: SparkSession, kind: str, path: str, to: str, shape: tuple, nodes: str | None = None, added: bool = False, object_column: str | None = None, knn: int = 0, length_range: tuple | None = None
) -> None:
    """One file or folder of a format to level 0 of a store, with its edges, faces or parents.
    With ``added`` also what ``operators.enrich`` works out: columns of trees and graphs,
    and the table of objects of points and paths."""
    if kind == "points" or kind in ("las", "ply"):
        if kind == "points":
            rows = formats.read_csv_points(spark, path, auto=True, object_column=object_column)
        else:
            rows = ranged.read_las_parts(spark, path) if kind == "las" else formats.read_ply(spark, path)
            rows = _numbered(rows.withColumnRenamed("vertex_id", "own"), ["file", "own"]).drop("own", "file")
        rows = rows.withColumn("seq", F.col("vertex_id")) if "object_id" in rows.columns else _single(rows)
        rows = enrich.points(rows, knn, min(shape)) if knn else rows
        store.write_level(rows, to, 0, shape)
        if added:
            store.write_objects(enrich.objects(rows), to)
    elif kind in ("trk", "tck", "trx"):
        if kind == "trk":
            rows = ranged.read_tracks(spark, path, attributes=True)
        else:
            rows = binary.read_trx(spark, path)[0] if kind == "trx" else formats.read_tck(spark, path)
        objects = number_rows(rows.select("file", F.col("object_id").alias("own")).distinct(), ["file", "own"], "object_id")
        rows = _numbered(rows.withColumnRenamed("object_id", "own").join(objects, ["file", "own"]).drop("own", "file"), ["object_id", "seq"])
        if length_range:
            rows = enrich.within_length(rows, *length_range)
        store.write_level(rows, to, 0, shape)
        if added:
            store.write_objects(enrich.path_objects(rows), to)
    elif kind == "swc":
        rows = number_rows(formats.read_swc(spark, path), ["file", "node"], "vertex_id")
        up = rows.select("file", F.col("node").alias("parent"), F.col("vertex_id").alias("up"))
        trees = rows.withColumnRenamed("kind", "type").join(up, ["file", "parent"], "left").withColumn("parent", F.coalesce("up", F.lit(-1))).drop("up", "node")
        files = number_rows(trees.select("file").distinct(), ["file"], "object_id")
        trees = trees.join(files, "file").drop("file").withColumn("seq", F.col("vertex_id"))
        store.write_tree(enrich.tree(trees) if added else trees, to, 0, shape)
    elif kind in ("obj", "stl"):
        store.write_mesh(*_mesh(*(formats.read_obj if kind == "obj" else formats.read_stl)(spark, path)), to, 0, shape)
    elif kind == "lines":
        store.write_lines(formats.read_lines_csv(spark, path).withColumn("vertex_id", F.col("line_id")), to, 0, shape)
    elif kind in ("edgelist", "graphml"):
        if kind == "edgelist" and nodes is None:
            raise SystemExit("--format edgelist needs --nodes")
        vertices, edges = formats.read_edge_list(spark, path, nodes) if kind == "edgelist" else formats.read_graphml_typed(spark, path)
        at = {a: F.col(a).cast("double") if a in vertices.columns else F.lit(0.0) for a in "xyz"}
        vertices = _single(vertices.withColumns(at))
        store.write_graph(enrich.network(vertices, edges) if added else vertices, edges, to, 0, shape)
    else:
        raise SystemExit(f"unknown format {kind!r}; known are {', '.join(FORMATS)}")


def add_levels(spark: SparkSession, path: str, bin_shape: tuple, factors: list[tuple[float, float]], mode: str | None, strategy: str, seed: int, scales: list | None = None, depth: int = 1, storage: str = "explicit") -> None:
    """Coarser levels of level 0, the links of each vertex to the level above it, and those
    over up to ``depth`` levels."""
    columns = store.read_points(spark, path, 0).columns
    mode = mode or pyramid.select_coarsener_key(columns)
    base = store.read_points(spark, path, 0).drop(*store.CHUNK)
    shape = store.level_shape(spark, path, 0)
    levels = pyramid.build_pyramid(base, bin_shape, factors, mode, strategy, seed, shape, scales)
    store.write_pyramid(levels, path, shape, depth, storage)


def _pyramid_flags(p: argparse.ArgumentParser, needed: bool) -> None:
    p.add_argument("--bin-shape", type=numbers, required=needed), p.add_argument("--bin-factors"), p.add_argument("--object-factors")
    p.add_argument("--mode", choices=["per_object", "polyline", "skeleton"]), p.add_argument("--strategy", default="random"), p.add_argument("--seed", type=int, default=0)
    p.add_argument("--chunk-scales", type=numbers, help="how much wider each level's chunks are than those below")
    p.add_argument("--cross-depth", type=int, default=1), p.add_argument("--cross-storage", choices=["explicit", "implicit"], default="explicit")


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="terravane")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="file to level 0 of a store, and coarser levels if a bin shape is given")
    c.add_argument("input"), c.add_argument("store"), c.add_argument("--format", choices=FORMATS), c.add_argument("--chunk-shape", type=numbers, required=True)
    c.add_argument("--nodes", help="the nodes of an edge list"), c.add_argument("--overwrite", action="store_true")
    c.add_argument("--enrich", action="store_true", help="columns of trees and graphs, and a table of objects"), c.add_argument("--object-column"), c.add_argument("--knn", type=int, default=0)
    c.add_argument("--length-range", type=numbers, help="least and largest length of paths")
    _pyramid_flags(c, False)
    p = sub.add_parser("pyramid", help="coarser levels of a store")
    p.add_argument("store")
    _pyramid_flags(p, True)
    layer = sub.add_parser("layer", help="a skeleton layer with a file for each segment to a store")
    layer.add_argument("input"), layer.add_argument("store"), layer.add_argument("--chunk-shape", type=numbers, required=True)
    layer.add_argument("--strides", type=numbers, default=()), layer.add_argument("--factors", type=numbers), layer.add_argument("--scale", type=int, default=2)
    layer.add_argument("--drop-interior-below", type=int, default=0), layer.add_argument("--segments", type=numbers), layer.add_argument("--parts", type=int)
    layer.add_argument("--overwrite", action="store_true")
    for name in ("validate", "info", "rebuild", "vacuum"):
        q = sub.add_parser(name)
        q.add_argument("store")
        if name in ("validate", "rebuild"):
            q.add_argument("--level", type=int, default=0)
    a = top.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "convert":
        kind = a.format or ENDINGS.get(a.input[a.input.rfind(".") :].lower())
        if store.has_level(spark, a.store, 0) and not a.overwrite:
            raise SystemExit(f"{a.store} exists; --overwrite replaces it")
        convert(spark, kind, a.input, a.store, a.chunk_shape, a.nodes, a.enrich, a.object_column, a.knn, a.length_range)
        print(f"{a.store}: {store.read_points(spark, a.store, 0).count()} rows at level 0")
    if a.command == "pyramid" or (a.command == "convert" and a.bin_shape):
        factors = build_factors(a.bin_factors, a.object_factors) or [(2.0, 1.0)]
        add_levels(spark, a.store, a.bin_shape, factors, a.mode, a.strategy, a.seed, [int(k) for k in a.chunk_scales] if a.chunk_scales else None, a.cross_depth, a.cross_storage)
        print(f"{a.store}: {len(factors)} coarser levels")
    elif a.command == "layer":
        if store.has_level(spark, a.store, 0) and not a.overwrite:
            raise SystemExit(f"{a.store} exists; --overwrite replaces it")
        segments = [int(k) for k in a.segments] if a.segments else None
        said = precomputed.run_ingest_plain(spark, a.input, a.store, a.chunk_shape, segments, strides=[int(k) for k in a.strides], factors=a.factors, scale=a.scale, least=a.drop_interior_below, parts=a.parts)
        print(f"{a.store}: " + ", ".join(f"{v} {k}" for k, v in said.items()))
    elif a.command == "validate":
        found = store.validate(spark, a.store, a.level)
        print("\n".join(found) or "no faults found")
        return int(bool(found))
    elif a.command == "rebuild":
        print(f"{a.store}: {store.rebuild(spark, a.store, a.level)} levels made again")
    elif a.command == "vacuum":
        print(f"{a.store}: {store.vacuum(spark, a.store)} old folders deleted")
    elif a.command == "info":
        for row in store.info(spark, a.store).orderBy("level").toLocalIterator():
            print(row["level"], row["chunk_shape"], row["columns"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
