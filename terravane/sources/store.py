"""The level store: Parquet folders clustered by chunk, and a catalog that names the current ones.

Chunk columns cx, cy, cz are stored beside the coordinates and rows are range-
partitioned and sorted by them, so a box or chunk filter prunes files and row
groups by their statistics.  Rows may also be split into folders by a leading
column, a group or an attribute's bin; a filter on it reads those folders only.

Every write makes a folder of its own and then appends one row to the catalog
(``meta``): level, name (vertices, or that of links), version, folder, chunk shape,
columns and settings.  Readers take the row with the highest version, so a level is
replaced in one step, a reader of the old one is not disturbed, and no file is
renamed.  ``vacuum`` deletes the folders that no row with the highest version names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from terravane.functions.vec3 import cells
from terravane.operators import binning, filters, pyramid
from terravane.plans.numbering import number_rows, range_parts

CHUNK = ["cx", "cy", "cz"]
META = "level int, name string, version long, folder string, chunk_shape array<double>, columns string, settings string"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """The current row of every level and name; empty where there is no store."""
    try:
        rows = spark.read.schema(META).parquet(f"{path}/meta")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], META)
    last = rows.groupBy("level", "name").agg(F.max_by(F.struct(*rows.columns), "version").alias("r"))
    return last.select("r.*")


def _current(spark: SparkSession, path: str, level: int, name: str = "vertices") -> Row:
    row = catalog(spark, path).where((F.col("level") == level) & (F.col("name") == name)).first()
    if row is None:
        raise FileNotFoundError(f"{path} has no {name} at level {level}")
    return row


def _folder(spark: SparkSession, path: str, level: int, name: str = "vertices") -> str:
    return f"{path}/{_current(spark, path, level, name)['folder']}"


def _commit(spark: SparkSession, path: str, level: int, name: str, folder: str, shape: tuple | None, columns: list[str], settings: dict) -> None:
    last = catalog(spark, path).agg(F.max("version")).first()[0]
    row = (level, name, (last or 0) + 1, folder, [float(s) for s in shape] if shape else None, str(columns), json.dumps(settings))
    spark.createDataFrame([row], META).coalesce(1).write.mode("append").parquet(f"{path}/meta")


def write_level(vertices: DataFrame, path: str, level: int, shape: tuple, files: int | None = None, by: list[str] | None = None, settings: dict | None = None) -> None:
    """``by``: leading columns, each value of which gets a folder of its own."""
    spark, by = vertices.sparkSession, by or []
    placed = vertices.withColumns(cells(shape, "c"))
    out = placed.repartitionByRange(files or range_parts(vertices), *by, *CHUNK).sortWithinPartitions(*by, *CHUNK)
    folder = f"level={level}/{uuid.uuid4().hex}"
    (out.write.partitionBy(*by) if by else out.write).parquet(f"{path}/{folder}")
    _commit(spark, path, level, "vertices", folder, shape, vertices.columns, {"by": by, "made": settings or {}})


def level_shape(spark: SparkSession, path: str, level: int) -> tuple:
    return tuple(_current(spark, path, level)["chunk_shape"])


def level_settings(spark: SparkSession, path: str, level: int) -> dict:
    """What a coarser level was made with; empty for one that was not coarsened."""
    return json.loads(_current(spark, path, level)["settings"])["made"]


def read_points(spark: SparkSession, path: str, level: int = 0, low: tuple | None = None, high: tuple | None = None, object_ids=None, chunks=None, columns: list[str] | None = None) -> DataFrame:
    """Vertices of a level; all given filters hold together."""
    row = _current(spark, path, level)
    out, shape = spark.read.parquet(f"{path}/{row['folder']}"), tuple(row["chunk_shape"])
    if low is not None:
        out = filters.by_bbox(out, low, high, shape)
    if object_ids is not None:
        out = filters.by_ids(out, "object_id", object_ids)
    if chunks is not None:
        listed = [F.struct(*[F.lit(int(v)).cast("long").alias(c) for c, v in zip(CHUNK, k, strict=True)]) for k in chunks]
        out = out.where(F.struct(*CHUNK).isin(listed))
    return out.select(*columns) if columns else out


def write_links(links: DataFrame, vertices: DataFrame, path: str, level: int, shape: tuple, name: str = "edges", ends: tuple[str, ...] = ("v0", "v1"), files: int | None = None, by: list[str] | None = None) -> None:
    """Edges, faces or parents of a level, clustered by the chunk of their first end (and
    split into folders by its columns ``by``)."""
    by = by or []
    at = vertices.select(F.col("vertex_id").alias(ends[0]), *by, *[c.alias(n) for n, c in cells(shape, "c").items()]).dropDuplicates([ends[0]])
    placed = links.drop(*CHUNK, *by).join(at, ends[0])
    out = placed.repartitionByRange(files or range_parts(links), *by, *CHUNK, *ends).sortWithinPartitions(*by, *CHUNK, *ends)
    folder = f"links/{name}/level={level}/{uuid.uuid4().hex}"
    (out.write.partitionBy(*by) if by else out.write).parquet(f"{path}/{folder}")
    _commit(links.sparkSession, path, level, name, folder, shape, links.columns, {"by": by, "ends": list(ends)})


def read_links(spark: SparkSession, path: str, level: int = 0, name: str = "edges", within: DataFrame | None = None, ends: tuple[str, ...] = ("v0", "v1")) -> DataFrame:
    """The links of a level; with ``within``, those all of whose ends are among its vertices."""
    out = spark.read.parquet(_folder(spark, path, level, name)).drop(*CHUNK)
    return out if within is None else filters.edges_within(out, within, ends)


FACE = ("v0", "v1", "v2")


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, level: int, shape: tuple) -> None:
    write_level(vertices, path, level, shape)
    write_links(edges, vertices, path, level, shape)


def read_graph(spark: SparkSession, path: str, level: int = 0, **filters_) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges between them); takes the filters of ``read_points``."""
    vertices = read_points(spark, path, level, **filters_)
    return vertices, read_links(spark, path, level, "edges", vertices if filters_ else None)


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str, level: int, shape: tuple) -> None:
    write_level(vertices, path, level, shape)
    write_links(faces, vertices, path, level, shape, "faces", FACE)


def read_mesh(spark: SparkSession, path: str, level: int = 0, **filters_) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces all of whose corners are among them); takes the filters of ``read_points``."""
    vertices = read_points(spark, path, level, **filters_)
    return vertices, read_links(spark, path, level, "faces", vertices if filters_ else None, FACE)


def write_tree(vertices: DataFrame, path: str, level: int, shape: tuple) -> None:
    """A rooted forest, whose ``parent`` column (-1 at roots) is kept as links too."""
    write_level(vertices, path, level, shape)
    up = vertices.where("parent >= 0").select(F.col("vertex_id").alias("v0"), F.col("parent").alias("v1"))
    write_links(up, vertices, path, level, shape, "parents")


def write_parents(parents: DataFrame, vertices: DataFrame, path: str, level: int, shape: tuple) -> None:
    """vertex_id, parent: the links of a level's vertices to the level above (-1: none)."""
    links = parents.select(F.col("vertex_id").alias("v0"), F.col("parent").alias("v1"))
    write_links(links, vertices, path, level, shape, "level_parents")


def write_objects(objects: DataFrame, path: str) -> None:
    """The table of a store's objects (object_id, manifest, properties), sorted by object."""
    folder = f"objects/{uuid.uuid4().hex}"
    objects.repartitionByRange(range_parts(objects), "object_id").sortWithinPartitions("object_id").write.parquet(f"{path}/{folder}")
    _commit(objects.sparkSession, path, -1, "objects", folder, None, objects.columns, {})


def read_objects(spark: SparkSession, path: str, object_ids=None) -> DataFrame:
    out = spark.read.parquet(_folder(spark, path, -1, "objects"))
    return out if object_ids is None else filters.by_ids(out, "object_id", object_ids)


def write_lines(lines: DataFrame, path: str, level: int, shape: tuple) -> None:
    """line_id, x0..z1 and attributes, clustered by the chunk of the first end."""
    placed = lines.withColumnsRenamed({f"{a}0": a for a in "xyz"})
    write_level(placed, path, level, shape)


def read_lines(spark: SparkSession, path: str, level: int = 0, low: tuple | None = None, high: tuple | None = None) -> DataFrame:
    """The lines both of whose ends lie in the closed box."""
    out = read_points(spark, path, level, low, high)
    if low is not None:
        for k, a in enumerate("xyz"):
            out = out.where(F.col(f"{a}1").between(low[k], high[k]))
    return out.drop(*CHUNK).withColumnsRenamed({a: f"{a}0" for a in "xyz"})


def require_link_width(links: DataFrame, expected: int) -> DataFrame:
    """``links``, if it has the ends v0 to v<expected - 1> and no further ones."""
    have = sorted(c for c in links.columns if c[:1] == "v" and c[1:].isdigit())
    if have != sorted(f"v{k}" for k in range(expected)):
        raise ValueError(f"links have the ends {have}, {expected} were expected")
    return links


def has_level(spark: SparkSession, path: str, level: int = 0) -> bool:
    return not catalog(spark, path).where((F.col("level") == level) & (F.col("name") == "vertices")).isEmpty()


def levels_of(spark: SparkSession, path: str) -> list[pyramid.Level]:
    """The levels that follow each other from 0 on, with their links and settings."""
    rows = {(r["level"], r["name"]): r for r in catalog(spark, path).collect()}  # a row for each level and kind of link
    out = []
    while (n := len(out), "vertices") in rows:
        row = rows[n, "vertices"]
        parents = None
        if n and (n - 1, "level_parents") in rows:
            parents = spark.read.parquet(f"{path}/{rows[n - 1, 'level_parents']['folder']}").select(F.col("v0").alias("vertex_id"), F.col("v1").alias("parent"))
        out.append(pyramid.Level(n, spark.read.parquet(f"{path}/{row['folder']}").drop(*CHUNK), parents, json.loads(row["settings"])["made"]))
    return out


def write_pyramid(levels: list[pyramid.Level], path: str, shape: tuple, depth: int = 1, storage: str = "explicit", first: int = 1) -> None:
    """Levels from ``first`` on, with their settings and the links from the level below, then
    the links over up to ``depth`` levels (-1: all, 0: none).  ``shape`` is level 0's chunks'."""
    spark = levels[0].vertices.sparkSession
    below_shape = tuple(levels[first - 1].settings.get("chunk_shape") or shape)
    for below, level in zip(levels[first - 1 :], levels[first:], strict=False):
        own = tuple(level.settings.get("chunk_shape") or below_shape)
        write_level(level.vertices, path, level.number, own, settings=level.settings)
        if "parent" in level.vertices.columns:
            up = level.vertices.where("parent >= 0").select(F.col("vertex_id").alias("v0"), F.col("parent").alias("v1"))
            write_links(up, level.vertices, path, level.number, own, "parents")
        write_parents(level.parents, below.vertices, path, below.number, below_shape)
        below_shape = own
    if depth:
        write_cross_levels(spark, path, depth, storage)


def write_cross_levels(spark: SparkSession, path: str, depth: int = 1, storage: str = "explicit") -> None:
    """Links between a level's vertices and those up to ``depth`` levels away, composed from
    the stored links between neighbouring levels; a folder for each (level, delta)."""
    levels = [x for x in levels_of(spark, path) if x.number == 0 or x.parents is not None]
    if len(levels) < 2:
        return
    made = pyramid.cross_level(levels, depth, storage)
    at = None
    for x in levels:
        placed = x.vertices.select(F.lit(x.number).alias("level"), F.col("vertex_id").alias("v0"), *[c.alias(n) for n, c in cells(level_shape(spark, path, x.number), "c").items()])
        placed = placed.dropDuplicates(["v0"])
        at = placed if at is None else at.union(placed)
    keys = ["level", "delta", *CHUNK, "v0", "v1"]
    out = made.join(at, ["level", "v0"]).repartitionByRange(range_parts(made), *keys).sortWithinPartitions(*keys)
    folder = f"links/cross/{uuid.uuid4().hex}"
    out.write.partitionBy("level", "delta").parquet(f"{path}/{folder}")
    _commit(spark, path, -1, "cross", folder, None, ["v0", "v1"], {"depth": depth, "storage": storage})


def read_cross_links(spark: SparkSession, path: str, level: int, delta: int, within: DataFrame | None = None) -> DataFrame:
    """v0 (of ``level``), v1 (``delta`` levels above, or below if negative); with ``within``
    those of its vertices.  Where only links upwards are stored, the mirrored ones are read."""
    row = _current(spark, path, -1, "cross")
    mirrored = delta < 0 and json.loads(row["settings"])["storage"] == "implicit"
    at, step = (level + delta, -delta) if mirrored else (level, delta)
    found = spark.read.parquet(f"{path}/{row['folder']}").where((F.col("level") == at) & (F.col("delta") == step))
    out = found.select(F.col("v1").alias("v0"), F.col("v0").alias("v1")) if mirrored else found.select("v0", "v1")
    return out if within is None else filters.edges_within(out, within, ("v0",))


def rebuild(spark: SparkSession, path: str, source: int = 0) -> int:
    """Makes the levels above ``source`` again with their own settings, as after an edit of
    it, and then the links over several levels as they were asked for; returns how many.
    Each level is replaced in one step."""
    levels = levels_of(spark, path)
    if source >= len(levels):
        raise ValueError(f"{path} has no level {source}")
    cross = catalog(spark, path).where("name = 'cross'").first()
    asked = json.loads(cross["settings"]) if cross else {"depth": 0, "storage": "explicit"}
    made = pyramid.rebuild_from(levels, source)
    write_pyramid(made, path, level_shape(spark, path, 0), asked["depth"], asked["storage"], source + 1)
    return len(levels) - source - 1


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the folders of replaced versions; returns how many.  Readers that began before
    a replacement must have ended."""
    from pyarrow.fs import FileSelector, FileType

    from terravane.sources.ranged import located

    kept = {r["folder"] for r in catalog(spark, path).select("folder").collect()}
    files, root = located(path)
    folders = [f.path for f in files.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.Directory]
    named = [f for f in folders if len(f.rsplit("/", 1)[-1]) == 32 and "=" not in f.rsplit("/", 1)[-1]]
    gone = [f for f in named if f[len(root) :].strip("/") not in kept]
    for f in gone:
        files.delete_dir(f)
    return len(gone)


def write_composite(parts: dict[str, DataFrame], path: str, level: int, shape: tuple) -> None:
    """Several geometry types in one level, told apart by ``geometry_type``."""
    out = None
    for name, rows in parts.items():
        typed = rows.withColumn("geometry_type", F.lit(name))
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    write_level(out, path, level, shape)


def read_composite(spark: SparkSession, path: str, level: int, geometry_type: str, **filters_) -> DataFrame:
    """The vertices of one geometry type; takes the filters of ``read_points``."""
    return read_points(spark, path, level, **filters_).where(F.col("geometry_type") == geometry_type)


def _rewrite(spark: SparkSession, path: str, level: int, vertices: DataFrame, shape: tuple, files: int | None = None, by: list[str] | None = None) -> None:
    """A new version of a level's vertices, and of all its links where their clustering changes."""
    old = _current(spark, path, level)
    said = json.loads(old["settings"])
    by = said["by"] if by is None else by
    write_level(vertices, path, level, shape, files, by, said["made"])
    if tuple(old["chunk_shape"]) == tuple(map(float, shape)) and by == said["by"]:
        return
    for row in catalog(spark, path).where((F.col("level") == level) & (F.col("name") != "vertices")).collect():  # a row for each kind of link
        ends = json.loads(row["settings"])["ends"]
        links = spark.read.parquet(f"{path}/{row['folder']}").drop(*CHUNK)
        write_links(links, vertices, path, level, shape, row["name"], tuple(ends), by=by)


def write_back(spark: SparkSession, path: str, level: int, values: DataFrame, key: str = "vertex_id") -> None:
    """Adds the columns of ``values`` to a level's vertices (null where a key is missing)."""
    old = spark.read.parquet(_folder(spark, path, level)).drop(*CHUNK)
    made = [c for c in values.columns if c != key]
    _rewrite(spark, path, level, old.drop(*made).join(values, key, "left"), level_shape(spark, path, level))


def info(spark: SparkSession, path: str) -> DataFrame:
    """level, chunk_shape, columns and settings of every level."""
    return catalog(spark, path).where("name = 'vertices'").select("level", "chunk_shape", "columns", "settings")


def reshard(spark: SparkSession, path: str, level: int, files: int) -> None:
    """Rewrite a level's vertices in another number of files."""
    whole = spark.read.parquet(_folder(spark, path, level)).drop(*CHUNK)
    _rewrite(spark, path, level, whole, level_shape(spark, path, level), files)


def rechunk(spark: SparkSession, path: str, level: int, shape: tuple | None = None, by: str | None = None, edges: list[float] | None = None) -> None:
    """Rewrite a level and its links with another chunk shape, and with a folder for each
    value of ``by`` (a group), or, given ascending ``edges``, for each bin of it: column
    ``bin`` counts the edges at or below the value."""
    whole = spark.read.parquet(_folder(spark, path, level)).drop(*CHUNK)
    lead = None
    if by is not None:
        lead = [by] if edges is None else ["bin"]
        whole = whole if edges is None else pyramid.rechunk(whole, by, edges)
    _rewrite(spark, path, level, whole, shape or level_shape(spark, path, level), by=lead)


def coarsen_points(spark: SparkSession, path: str, source: int, target: int, bin_shape: tuple) -> None:
    """Writes level ``target``: the bin centroids of level ``source``, positions only."""
    shape = level_shape(spark, path, source)
    nodes = binning.metanodes(read_points(spark, path, source, columns=["vertex_id", "x", "y", "z"]), bin_shape)
    made = number_rows(nodes, binning.BIN, "vertex_id").select("vertex_id", "x", "y", "z")
    write_level(made, path, target, shape)


def validate(spark: SparkSession, path: str, level: int = 0, links: DataFrame | None = None) -> list[str]:
    """What is wrong with a level: null ids or coordinates, misplaced rows, repeated ids,
    links to missing vertices.  An empty list means none of these."""
    rows, shape, found = spark.read.parquet(_folder(spark, path, level)), level_shape(spark, path, level), []
    wrong = F.lit(False)
    for name, c in cells(shape, "c").items():
        wrong = wrong | ~F.col(name).eqNullSafe(c)
    bad = rows.agg(
        F.sum(F.col("vertex_id").isNull().cast("long")).alias("ids"),
        F.sum((F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).cast("long")).alias("coordinates"),
        F.sum(wrong.cast("long")).alias("chunks"),
        (F.count("vertex_id") - F.count_distinct("vertex_id")).alias("repeats"),
    ).first()
    found += [f"{bad[c]} rows with wrong {c}" for c in ("ids", "coordinates", "chunks", "repeats") if bad[c]]
    if links is not None:
        for end in ("v0", "v1"):
            lost = links.select(F.col(end).alias("vertex_id")).join(rows.select("vertex_id"), "vertex_id", "left_anti").count()
            if lost:
                found.append(f"{lost} links with a missing {end}")
    return found
