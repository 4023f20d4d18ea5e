"""Reading and writing geometry files with Spark's own readers.

Text formats are read line by line in parallel; whole-file formats (a mesh or track
file is one unit) by ``binaryFile``, parsed in the task that holds the file.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.functions.vec3 import norm, sub, vec
from terravane.operators import filters
from terravane.plans.numbering import number_rows, prefix_sums

# Names under which coordinate and attribute columns are recognised.
AXES = {a: (a, f"pos_{a}", f"pos{a}", f"p{a}") for a in "xyz"}
KNOWN = {"r", "red", "g", "green", "b", "blue", "intensity", "i", "label", "class", "tissue", "confidence", "conf"}


def detect_columns(names: list[str], ndim: int = 3) -> tuple[list[str], list[str]]:
    """(position columns, recognised attributes), by name whatever its case and blanks
    around it, both in the order of the header; both empty unless every axis is found.
    The first column that fits an axis is the axis."""
    plain = [(n, n.strip().lower()) for n in names]
    axes = [next((n for n, low in plain if low in AXES[a]), None) for a in "xyz"[:ndim]]
    if None in axes:
        return [], []
    return axes, [n for n, low in plain if low in KNOWN and n not in axes]


def in_line_order(raw: DataFrame, name: str = "__line") -> DataFrame:
    """The rows of a file scan with ``name``, which orders them by file, place of the
    split in the file, and line."""
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return raw.select("*", place.alias(name))


def read_csv_points(spark: SparkSession, path: str, ndim: int = 3, delimiter: str = ",", header: bool = True, positions: list[str] | None = None, attributes: list[str] | None = None, auto: bool = False, object_column: str | None = None, drop_na: bool = False, drop_duplicates: bool = False, normalise: bool = False) -> DataFrame:
    """vertex_id, x, y[, z] and float attributes; ids follow the order of lines.  With an
    ``object_column`` also object_id, its value as a whole number.
    ``filters.normalise`` of the result gives the offset and scale that ``normalise`` applies."""
    raw = spark.read.csv(path, sep=delimiter, header=header)
    if not header:
        raw = raw.withColumnsRenamed({c: f"col{i}" for i, c in enumerate(raw.columns)})
    if auto and not positions:
        positions, found = detect_columns(raw.columns, ndim)
        attributes = attributes or found
    positions = positions or raw.columns[:ndim]
    attributes = attributes if attributes is not None else [c for c in raw.columns if c not in positions and c != object_column]
    axes = "xyz"[:ndim]
    rows = in_line_order(raw).select(
        "__line", *[F.col(f"`{c}`").cast("double").alias(a) for c, a in zip(positions, axes, strict=True)], *[F.col(f"`{c}`").cast("float").alias(c) for c in attributes],
        *([F.col(f"`{object_column}`").cast("long").alias("object_id")] if object_column else []),
    )
    if drop_na:
        rows = filters.drop_na(rows, axes)
    if drop_duplicates:
        rows = filters.drop_duplicates(rows, list(axes), "__line")
    out = number_rows(rows, ["__line"], "vertex_id").drop("__line")
    return filters.normalise(out, axes)[0] if normalise else out


def read_lines_csv(spark: SparkSession, path: str, header: bool = True, drop_zero: bool = False, drop_na: bool = False, drop_duplicates: bool = False) -> DataFrame:
    """line_id, x0..z1, length and further columns; missing values, then repeats, then
    zero-length lines are dropped, as asked."""
    raw = spark.read.csv(path, header=header)
    ends = [f"{a}{k}" for k in (0, 1) for a in "xyz"]
    rows = in_line_order(raw).select(
        "__line", *[F.col(f"`{c}`").cast("double").alias(e) for c, e in zip(raw.columns[:6], ends, strict=True)], *[F.col(f"`{c}`").cast("float").alias(c) for c in raw.columns[6:]]
    )
    if drop_na:
        rows = filters.drop_na(rows, ends)
    if drop_duplicates:
        rows = filters.drop_duplicates(rows, ends, "__line")
    rows = number_rows(rows, ["__line"], "line_id").drop("__line")
    out = rows.withColumn("length", norm(sub(vec(suffix="1"), vec(suffix="0"))))
    return out.where("length >= 1e-9") if drop_zero else out


def read_edge_list(spark: SparkSession, edges: str, nodes: str, source: str = "source", target: str = "target", node_id: str = "node_id", drop_duplicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes numbered by file order, edges by those numbers; edges with an
    unknown end are dropped, their attributes stay beside them."""
    n = in_line_order(spark.read.csv(nodes, header=True, inferSchema=True))
    if drop_duplicates:
        n = filters.drop_duplicates(n, [node_id], "__line")
    n = number_rows(n, ["__line"], "vertex_id").drop("__line")
    e = in_line_order(spark.read.csv(edges, header=True, inferSchema=True))
    if drop_duplicates:
        e = filters.drop_duplicates(e, [source, target], "__line")
    e = number_rows(e, ["__line"], "edge_id").drop("__line")
    for name, end in ((source, "v0"), (target, "v1")):
        e = e.join(n.select(F.col(node_id).alias(name), F.col("vertex_id").alias(end)), name)
    return n, e


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """file, node, kind, x, y, z, radius, parent (-1 if none or unknown), from 7-column
    lines; ``#`` starts a comment and short lines are skipped."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    f = F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+")
    rows = lines.select("file", f.alias("f")).where("size(f) >= 7")
    made = rows.select("file", F.col("f")[0].cast("long").alias("node"), F.col("f")[1].cast("int").alias("kind"), *[F.col("f")[i + 2].cast("double").alias(a) for i, a in enumerate("xyz")], F.col("f")[5].cast("double").alias("radius"), F.col("f")[6].cast("long").alias("p"))
    known = made.select("file", F.col("node").alias("p"), F.lit(True).alias("known"))
    return made.join(known, ["file", "p"], "left").select("file", "node", "kind", "x", "y", "z", "radius", F.when(F.col("known"), F.col("p")).otherwise(-1).alias("parent"))


def _parse_obj(text: str) -> tuple[list, list]:
    vertices, faces, names, current = [], [], {}, None
    for line in text.splitlines():
        w = line.split("#", 1)[0].split()
        if not w:
            continue
        if w[0] == "v":
            vertices.append(tuple(float(v) for v in w[1:4]))
        elif w[0] in "og":
            current = names.setdefault(" ".join(w[1:]), len(names))
        elif w[0] == "f":
            at = [int(c.split("/")[0]) for c in w[1:]]
            at = [i - 1 if i > 0 else len(vertices) + i for i in at]
            faces += [(at[0], at[k], at[k + 1], current) for k in range(1, len(at) - 1)]
    return vertices, faces


def _stl_size(raw: bytes) -> int | None:
    """Facets of a binary file: its length must be 84 + 50 each."""
    n = struct.unpack("<I", raw[80:84])[0] if len(raw) >= 84 else None
    return n if n is not None and len(raw) == 84 + 50 * n else None


def _parse_stl(raw: bytes) -> np.ndarray:
    n = _stl_size(raw)
    if n is not None:
        rec = np.frombuffer(raw, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), n, 84)
        return rec["v"].reshape(-1, 3).astype(float)
    rows = re.findall(r"vertex\s+(\S+)\s+(\S+)\s+(\S+)", raw.decode("utf-8", "replace"))
    return np.array(rows, float).reshape(-1, 3)


def _parse_ply(raw: bytes) -> pd.DataFrame:
    head, _, body = raw.partition(b"end_header")
    body = body.lstrip(b"\r").removeprefix(b"\n")
    kinds = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
    order, count, props, here = None, 0, [], False
    for line in head.decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[w[1]]
        elif w[:1] == ["element"]:
            here = w[1] == "vertex"
            count = int(w[2]) if here else count
        elif w[:1] == ["property"] and here:
            props.append((w[2], kinds[w[1]]))
    if order:
        table = np.frombuffer(body, np.dtype([(n, order + k) for n, k in props]), count)
        return pd.DataFrame({n: table[n].astype(float) for n, _ in props})
    rows = [line.split()[: len(props)] for line in body.decode().splitlines()[:count]]
    return pd.DataFrame(np.array(rows, float).reshape(-1, len(props)), columns=[n for n, _ in props])


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of OBJ files: file, vertex_id, x, y, z and file, face_id, v0, v1,
    v2, object_id; polygons become fans."""

    def vertices(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                v, _ = _parse_obj(bytes(raw).decode("utf-8", "replace"))
                yield pd.DataFrame([(name, i, *p) for i, p in enumerate(v)], columns=["file", "vertex_id", "x", "y", "z"])

    def faces(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                _, f = _parse_obj(bytes(raw).decode("utf-8", "replace"))
                yield pd.DataFrame([(name, i, *t) for i, t in enumerate(f)], columns=["file", "face_id", "v0", "v1", "v2", "object_id"])

    src = _texts(spark, path)
    return (
        src.mapInPandas(vertices, "file string, vertex_id long, x double, y double, z double"),
        src.mapInPandas(faces, "file string, face_id long, v0 long, v1 long, v2 long, object_id long"),
    )


def read_stl(spark: SparkSession, path: str, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of STL files; corners on the same tolerance grid cell are one
    vertex, represented by the first of them (exact positions for tolerance <= 0)."""

    def corners(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                v = _parse_stl(bytes(raw))
                yield pd.DataFrame({"file": name, "corner": np.arange(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]})

    raw = _texts(spark, path).mapInPandas(corners, "file string, corner long, x double, y double, z double")
    keys = ["file", *[F.rint(F.col(a) / tolerance) if tolerance > 0 else F.col(a) for a in "xyz"]]
    first = F.min("corner").over(Window.partitionBy(*keys))
    placed = raw.withColumn("vertex_id", first)
    vertices = placed.where("corner = vertex_id").select("file", "vertex_id", "x", "y", "z")
    faces = placed.withColumns({"face_id": F.expr("corner div 3"), "k": F.col("corner") % 3}).groupBy("file", "face_id").agg(*[F.max(F.when(F.col("k") == i, F.col("vertex_id"))).alias(f"v{i}") for i in range(3)])
    return vertices, faces


def read_ply(spark: SparkSession, path: str, attributes: tuple[str, ...] = ()) -> DataFrame:
    """file, vertex_id, x, y, z and the named properties of PLY files (ASCII or binary)."""
    names = list(attributes)

    def rows(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                t = _parse_ply(bytes(raw))
                axes = next((c for c in (["x", "y", "z"], ["X", "Y", "Z"]) if set(c) <= set(t.columns)), list(t.columns[:3]))
                out = pd.DataFrame({"file": name, "vertex_id": np.arange(len(t))} | {a: t[c] for a, c in zip("xyz", axes, strict=True)})
                for n in names:
                    out[n] = t[n] if n in t else np.nan
                yield out

    more = "".join(f", `{n}` double" for n in names)
    return _texts(spark, path).mapInPandas(rows, "file string, vertex_id long, x double, y double, z double" + more)


def parse_trk_header(raw: bytes) -> dict:
    """The 1000-byte header of a TrackVis file."""
    if len(raw) < 1000 or raw[:5] != b"TRACK":
        raise ValueError("not a TrackVis file")
    scalars, properties = struct.unpack("<h", raw[36:38])[0], struct.unpack("<h", raw[238:240])[0]
    return {
        "dim": struct.unpack("<3h", raw[6:12]), "voxel_size": struct.unpack("<3f", raw[12:24]), "origin": struct.unpack("<3f", raw[24:36]),
        "n_scalars": scalars, "n_properties": properties, "vox_to_ras": struct.unpack("<16f", raw[440:504]),
        "n_count": struct.unpack("<i", raw[988:992])[0], "version": struct.unpack("<i", raw[992:996])[0],
    }


def trk_headers(spark: SparkSession, path: str) -> DataFrame:
    """file and header (JSON) of TrackVis files."""
    read = F.pandas_udf(lambda raw: raw.map(lambda r: json.dumps(parse_trk_header(bytes(r)))), "string")
    return _texts(spark, path).select(F.col("path").alias("file"), read("content").alias("header"))


def read_trk(spark: SparkSession, path: str, attributes: bool = False, most: int | None = None) -> DataFrame:
    """file, object_id, seq, x, y, z of TrackVis files; a record without points ends a file.
    With ``attributes`` also scalars (of the point) and properties (of the track); ``most``
    limits the tracks read of each file."""

    def rows(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                raw = bytes(raw)
                h, at, k = parse_trk_header(raw), 1000, 0
                while at + 4 <= len(raw) and (most is None or k < most):
                    n = struct.unpack_from("<i", raw, at)[0]
                    if n <= 0:
                        break
                    width = 3 + h["n_scalars"]
                    p = np.frombuffer(raw, "<f4", n * width, at + 4).reshape(n, width).astype(float)
                    out = pd.DataFrame({"file": name, "object_id": k, "seq": np.arange(n), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})
                    end = at + 4 + 4 * n * width
                    if attributes:
                        of_track = np.frombuffer(raw, "<f4", h["n_properties"], end).astype(float)
                        out["scalars"], out["properties"] = list(p[:, 3:]), [of_track] * n
                    yield out
                    at, k = end + 4 * h["n_properties"], k + 1

    more = ", scalars array<double>, properties array<double>" if attributes else ""
    return _texts(spark, path).mapInPandas(rows, "file string, object_id long, seq long, x double, y double, z double" + more)


# The number types of MRtrix track files.
TCK_KINDS = {"Float32LE": "<f4", "Float32BE": ">f4", "Float64LE": "<f8", "Float64BE": ">f8"}


def read_tck(spark: SparkSession, path: str) -> DataFrame:
    """file, object_id, seq, x, y, z of MRtrix track files, of the datatype that the header
    names: a NaN row ends a track, an infinite one the file."""

    def rows(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for name, raw in zip(b["path"], b["content"], strict=True):
                raw = bytes(raw)
                at = int(re.search(rb"\nfile:\s*\.\s+(\d+)", raw)[1])
                said = re.search(rb"\ndatatype:\s*(\w+)", raw[:at])
                kind = np.dtype(TCK_KINDS[said[1].decode() if said else "Float32LE"])
                p = np.frombuffer(raw, kind, (len(raw) - at) // (3 * kind.itemsize) * 3, at).reshape(-1, 3).astype(float)
                stop = np.flatnonzero(np.isinf(p).all(axis=1))
                p = p[: stop[0]] if len(stop) else p
                gap = np.isnan(p).all(axis=1)
                k = np.cumsum(gap) - gap
                first = np.concatenate([[0], np.flatnonzero(gap) + 1])
                seq = np.arange(len(p)) - first[k]
                yield pd.DataFrame({"file": name, "object_id": k, "seq": seq, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})[~gap]

    return _texts(spark, path).mapInPandas(rows, "file string, object_id long, seq long, x double, y double, z double")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML: id, data (key -> text) and source, target, data."""
    kinds = "`_id` string, `_source` string, `_target` string, data array<struct<_key: string, _VALUE: string>>"
    out = []
    for tag, keep in (("node", ["_id"]), ("edge", ["_source", "_target"])):
        rows = spark.read.schema(kinds).option("rowTag", tag).xml(path)
        pairs = F.map_from_entries(F.transform(F.coalesce("data", F.array()), lambda d: F.struct(d["_key"], d["_VALUE"])))
        out.append(rows.select(*[F.col(c).alias(c[1:]) for c in keep], pairs.alias("data")))
    return tuple(out)


def read_graphml_typed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: vertex_id, id, ...; edges: edge_id, v0, v1, ...) with a column for each key the
    file declares: whole numbers long, other numbers double, the rest text.  A value that
    is missing is 0, false or empty; edges with an unknown end are dropped."""
    declared = spark.read.schema("`_id` string, `_for` string, `_attr.name` string, `_attr.type` string").option("rowTag", "key").xml(path)
    keys = declared.distinct().orderBy("_id").collect()  # a row for each declaration
    kinds = {"int": ("long", 0), "long": ("long", 0), "float": ("double", 0.0), "double": ("double", 0.0), "boolean": ("boolean", False)}

    def columns(of: str) -> list:
        out = []
        for k in keys:
            if k["_for"] in (of, "all", None):
                kind, missing = kinds.get(k["_attr.type"], ("string", ""))
                out.append(F.coalesce(F.col("data")[k["_id"]].try_cast(kind), F.lit(missing)).alias(k["_attr.name"] or k["_id"]))
        return out

    n, e = read_graphml(spark, path)
    nodes = number_rows(n.select("id", *columns("node")), ["id"], "vertex_id")
    edges = e.select("source", "target", *columns("edge"))
    for name, end in (("source", "v0"), ("target", "v1")):
        edges = edges.join(nodes.select(F.col("id").alias(name), F.col("vertex_id").alias(end)), name)
    return nodes, number_rows(edges.drop("source", "target"), ["v0", "v1", *[c for c in edges.columns if c not in ("source", "target", "v0", "v1")]], "edge_id")


# -- writing ---------------------------------------------------------------------


def csv_rows(points: DataFrame, attributes: tuple[str, ...] = ()) -> DataFrame:
    """dim0, dim1, dim2 with six decimals, and the attributes as they are."""
    return points.select(*[F.format_string("%.6f", F.col(a).cast("double")).alias(f"dim{i}") for i, a in enumerate("xyz")], *attributes)


def write_csv(points: DataFrame, path: str, attributes: tuple[str, ...] = (), delimiter: str = ",", header: bool = True) -> None:
    csv_rows(points, attributes).write.mode("overwrite").csv(path, sep=delimiter, header=header)


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """part, nth, value: the lines of one OBJ file, corners numbered from 1 by vertex_id."""
    ranked = number_rows(vertices, ["vertex_id"], "nth")
    v = ranked.select(F.lit(0).alias("part"), "nth", F.format_string("v %.6f %.6f %.6f", *[F.col(a).cast("double") for a in "xyz"]).alias("value"))
    f = faces
    for k in range(3):
        f = f.join(ranked.select(F.col("vertex_id").alias(f"v{k}"), (F.col("nth") + 1).alias(f"n{k}")), f"v{k}")
    return v.union(f.select(F.lit(1), F.col("face_id"), F.format_string("f %d %d %d", "n0", "n1", "n2")))


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One folder whose part files, in order, are the OBJ file."""
    obj_lines(vertices, faces).repartitionByRange("part", "nth").sortWithinPartitions("part", "nth").select("value").write.mode("overwrite").text(path)


def swc_parents(edges: DataFrame) -> DataFrame:
    """vertex_id, parent: the smaller end of each vertex's first edge to a smaller one, -1 at tops."""
    up = edges.where("v0 <> v1").groupBy(F.greatest("v0", "v1").alias("vertex_id")).agg(F.min_by(F.least("v0", "v1"), "edge_id").alias("parent"))
    tops = edges.where("v0 <> v1").select(F.least("v0", "v1").alias("vertex_id")).distinct().join(up, "vertex_id", "left_anti")
    return up.union(tops.select("vertex_id", F.lit(-1).cast("long")))


def write_swc(nodes: DataFrame, path: str) -> None:
    """nodes: node, kind, x, y, z, radius, parent; one line each, parents first by number."""
    line = F.format_string("%d %d %.6f %.6f %.6f %.6f %d", "node", "kind", "x", "y", "z", "radius", "parent")
    nodes.repartitionByRange("node").sortWithinPartitions("node").select(line.alias("value")).write.mode("overwrite").text(path)


def offsets(path: DataFrame) -> DataFrame:
    """object_id, start: vertices of the objects before it, as in a packed positions array."""
    counts = path.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    return prefix_sums(counts, ["object_id"], F.col("n"), "start").select("object_id", "start")


def balanced_parts(records: DataFrame, parts: int) -> DataFrame:
    """record, start, part: records in file order cut into parts of about equal bytes."""
    placed = prefix_sums(records, ["record"], F.col("bytes"), "start")
    total = records.agg(F.sum("bytes")).first()[0] or 1
    return placed.select("record", "start", F.floor(F.col("start").cast("double") * parts / F.lit(float(total))).cast("long").alias("part"))


# -- properties ------------------------------------------------------------------


def json_properties(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows with the fields of a JSON column in its place."""
    return rows.withColumn("__j", F.from_json(column, schema)).select(*[c for c in rows.columns if c != column], "__j.*")


def tag_masks(tags: DataFrame) -> DataFrame:
    """object_id, mask: bit i set for tag i; tags from 64 on are ignored."""
    bit = F.expr("shiftleft(1L, tag)")
    return tags.where("tag < 64").groupBy("object_id").agg(F.bit_or(bit).alias("mask"))


BOX = r"(-?\d+)-(-?\d+)_(-?\d+)-(-?\d+)_(-?\d+)-(-?\d+)"


def parse_boxes(names: DataFrame, column: str = "name") -> DataFrame:
    """Names with x0, x1, y0, y1, z0, z1 read from ``x0-x1_y0-y1_z0-z1``."""
    keys = [f"{a}{k}" for a in "xyz" for k in (0, 1)]
    return names.select("*", *[F.regexp_extract(column, BOX, i + 1).cast("long").alias(k) for i, k in enumerate(keys)])


def block_boxes(spark: SparkSession, low: tuple, high: tuple, size: tuple) -> DataFrame:
    """x0..z1 and name of every block of a volume, blocks cut at its upper ends."""
    out = spark.range(1)
    for i, a in enumerate("xyz"):
        out = out.withColumn(f"{a}0", F.explode(F.sequence(F.lit(low[i]), F.lit(high[i] - 1), F.lit(size[i]))))
    out = out.select(*[c for i, a in enumerate("xyz") for c in (F.col(f"{a}0"), F.least(F.col(f"{a}0") + size[i], F.lit(high[i])).alias(f"{a}1"))])
    return out.withColumn("name", F.concat_ws("_", *[F.concat_ws("-", F.col(f"{a}0"), F.col(f"{a}1")) for a in "xyz"]))


def grid_shape(low: tuple, high: tuple, target: int = 125) -> tuple:
    """A chunk shape for about ``target`` nearly cubic chunks over a box; 10 along each
    axis for a box without volume."""
    extent = [h - a for a, h in zip(low, high, strict=True)]
    volume = float(np.prod(extent))
    if volume <= 0:
        return (10.0, 10.0, 10.0)
    s = (target / volume) ** (1 / 3)
    return tuple(float(max(1, round(e / max(1, round(e * s))))) for e in extent)
