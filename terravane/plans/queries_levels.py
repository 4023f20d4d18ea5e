"""Queries over levels, object tables, groups and JSON properties."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import functions as F

from terravane.operators import paths, pyramid
from terravane.plans import fixtures as fx
from terravane.plans.queries_paths import CHUNK, FRAG

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def put(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return put


def bins(scale: float, of: str = "") -> str:
    return ", ".join(f"CAST(floor({of}{a} / {s * scale}) AS BIGINT) AS g{a}" for a, s in zip("xyz", SHAPE))


SHAPE = (10_000.0, 500.0, 10.0)
ALIVE = """ln AS (SELECT object_id, count(*) AS n FROM l GROUP BY object_id),
al AS (SELECT object_id FROM ln ORDER BY n DESC, object_id LIMIT (SELECT greatest(1, CAST(round_even(count(*) * 0.5, 0) AS BIGINT)) FROM ln)),
la AS (SELECT * FROM l WHERE object_id IN (SELECT object_id FROM al))"""
LEVEL1 = f"""{fx.L}, {ALIVE}, b1 AS (SELECT *, {bins(1)} FROM la),
n1 AS (SELECT gx, gy, gz, row_number() OVER (ORDER BY gx, gy, gz) - 1 AS vertex_id, CAST(sum(x) AS DOUBLE) / count(*) AS x, CAST(sum(y) AS DOUBLE) / count(*) AS y, CAST(sum(z) AS DOUBLE) / count(*) AS z FROM b1 GROUP BY gx, gy, gz)"""


def _one(spark, sf):
    """Level 1: half of the objects (most vertices first) over shared bins."""
    return pyramid.coarsen_level(pyramid.Level(0, fx.paths(spark, sf)), SHAPE, 2.0, strategy="attribute")


@query(f"""WITH {LEVEL1}, m AS (SELECT object_id, seq, n1.vertex_id AS v, n1.x, n1.y, n1.z, lag(n1.vertex_id) OVER (PARTITION BY object_id ORDER BY seq) AS pv FROM b1 JOIN n1 USING (gx, gy, gz))
SELECT object_id, row_number() OVER (PARTITION BY object_id ORDER BY seq) - 1 AS seq, v AS vertex_id, x, y, z FROM m WHERE pv IS NULL OR pv <> v""")
def pyramid_per_object(spark, sf):
    return _one(spark, sf).vertices


@query(f"WITH {LEVEL1}, p AS (SELECT *, {bins(1)} FROM l) SELECT p.vertex_id, coalesce(n1.vertex_id, -1) AS parent FROM p LEFT JOIN n1 USING (gx, gy, gz)")
def pyramid_parents(spark, sf):
    return _one(spark, sf).parents


@query(f"WITH {fx.L}, {ALIVE} SELECT object_id FROM al")
def pyramid_survivors(spark, sf):
    return pyramid.survivors(fx.paths(spark, sf), 2.0, "attribute", 0)


CL = f"""l0 AS (SELECT *, {bins(1)} FROM l), n1 AS (SELECT gx, gy, gz, row_number() OVER (ORDER BY gx, gy, gz) - 1 AS v, CAST(sum(x) AS DOUBLE) / count(*) AS x, CAST(sum(y) AS DOUBLE) / count(*) AS y, CAST(sum(z) AS DOUBLE) / count(*) AS z FROM l0 GROUP BY gx, gy, gz),
p0 AS (SELECT vertex_id AS v0, v AS v1 FROM l0 JOIN n1 USING (gx, gy, gz)),
q1 AS (SELECT v, {bins(4)} FROM n1), n2 AS (SELECT gx, gy, gz, row_number() OVER (ORDER BY gx, gy, gz) - 1 AS w FROM (SELECT DISTINCT gx, gy, gz FROM q1)),
p1 AS (SELECT v AS v0, w AS v1 FROM q1 JOIN n2 USING (gx, gy, gz)), p2 AS (SELECT p0.v0, p1.v1 FROM p0 JOIN p1 ON p1.v0 = p0.v1)"""


@query(f"""WITH {fx.L}, {CL}, a AS (SELECT 0 AS level, 1 AS delta, v0, v1 FROM p0 UNION ALL SELECT 0, 2, v0, v1 FROM p2 UNION ALL SELECT 1, 1, v0, v1 FROM p1)
SELECT CAST(level AS INTEGER) AS level, CAST(delta AS INTEGER) AS delta, v0, v1 FROM a UNION ALL SELECT CAST(level + delta AS INTEGER), CAST(-delta AS INTEGER), v1, v0 FROM a""")
def pyramid_cross_levels(spark, sf):
    """Two levels over all objects, links up to two levels apart and mirrored, read back from a store."""
    from terravane.sources import store

    path = _fresh(spark)
    store.write_level(fx.paths(spark, sf), path, 0, SHAPE)
    store.write_pyramid(pyramid.build_pyramid(fx.paths(spark, sf), SHAPE, [(1, 1), (4, 1)]), path, SHAPE, depth=2)
    pairs = [(0, 1), (0, 2), (1, 1), (1, -1), (2, -2), (2, -1)]
    read = [store.read_cross_links(spark, path, k, d).select(F.lit(k).alias("level"), F.lit(d).alias("delta"), "v0", "v1") for k, d in pairs]
    return functools.reduce(lambda a, b: a.union(b), read)


@query(f"WITH {LEVEL1.replace('FROM events', 'FROM events WHERE user_id % 3 <> 1')}, p AS (SELECT *, {bins(1)} FROM l) SELECT p.vertex_id, coalesce(n1.vertex_id, -1) AS parent FROM p LEFT JOIN n1 USING (gx, gy, gz)")
def pyramid_rebuild(spark, sf):
    """A stored level made again after a third of the objects below it went."""
    from terravane.sources import store

    path, base = _fresh(spark), fx.paths(spark, sf)
    store.write_level(base, path, 0, SHAPE)
    store.write_pyramid([pyramid.Level(0, base), _one(spark, sf)], path, SHAPE)
    store.write_level(base.where("object_id % 3 <> 1"), path, 0, SHAPE)
    store.rebuild(spark, path)
    return store.levels_of(spark, path)[1].parents


@query(f"WITH {fx.P} SELECT vertex_id, object_id, x, y, z, CAST((CASE WHEN z >= 30 THEN 1 ELSE 0 END) + (CASE WHEN z >= 60 THEN 1 ELSE 0 END) AS INTEGER) AS bin FROM p WHERE z >= 30 AND z < 60 AND x BETWEEN 5000000 AND 20000000 AND y BETWEEN 100 AND 900")
def io_bin_folders(spark, sf):
    """Points stored by bins of an attribute; a bin and a box are read from their own files."""
    from terravane.sources import store

    path, high = _fresh(spark), 1_000_000_000
    store.write_level(fx.points(spark, sf), path, 0, (1_000_000.0, 100.0, 10.0))
    store.rechunk(spark, path, 0, by="z", edges=[30.0, 60.0])
    read = store.read_points(spark, path, 0, low=(5_000_000, 100, -high), high=(20_000_000, 900, high))
    return read.where("bin = 1").select("vertex_id", "object_id", "x", "y", "z", "bin")


@query(f"""WITH {fx.L}, {FRAG}, s AS (SELECT object_id * 10 + 7 AS segment_id, cx, cy, cz, fragment FROM fr),
n AS (SELECT segment_id, row_number() OVER (ORDER BY segment_id) - 1 AS object_id FROM (SELECT DISTINCT segment_id FROM s))
SELECT n.object_id, segment_id, string_agg(cx || '.' || cy || '.' || cz || ':' || fragment, ' ' ORDER BY cx, cy, cz, fragment) AS manifest FROM s JOIN n USING (segment_id) GROUP BY n.object_id, segment_id""")
def object_index(spark, sf):
    parts = paths.fragments(fx.paths(spark, sf), CHUNK).selectExpr("object_id * 10 + 7 AS segment_id", "cx", "cy", "cz", "fragment")
    made = pyramid.object_index(parts)
    return made.select("object_id", "segment_id", F.expr("array_join(transform(manifest, m -> concat(m.cx, '.', m.cy, '.', m.cz, ':', m.fragment)), ' ')").alias("manifest"))


@query("""WITH v AS (SELECT o_orderkey AS vertex_id, o_custkey % 50 AS segment_id, o_custkey % 8 AS x, o_orderkey % 6 AS y, o_orderkey % 4 AS z, o_orderkey % 3 AS chunk FROM orders),
g AS (SELECT segment_id, x, y, z, chunk, min(vertex_id) AS v FROM v WHERE x % 4 = 0 OR y % 3 = 0 OR z % 5 = 0 GROUP BY ALL),
r AS (SELECT *, first_value(v) OVER (PARTITION BY segment_id, x, y, z ORDER BY chunk) AS lead, row_number() OVER (PARTITION BY segment_id, x, y, z ORDER BY chunk) AS k FROM g)
SELECT segment_id, lead AS v0, v AS v1 FROM r WHERE k > 1""")
def object_coincident_links(spark, sf):
    v = fx.table(spark, sf, "orders").selectExpr("o_orderkey AS vertex_id", "o_custkey % 50 AS segment_id", "o_custkey % 8 AS x", "o_orderkey % 6 AS y", "o_orderkey % 4 AS z", "o_orderkey % 3 AS chunk")
    return pyramid.coincident_links(v, (4, 3, 5))


@query(f"WITH {fx.L}, n AS (SELECT object_id, count(*) AS n FROM l GROUP BY object_id) SELECT object_id, n, CAST((n >= 50) AS BIGINT) + CAST((n >= 60) AS BIGINT) + CAST((n >= 70) AS BIGINT) AS bin FROM n")
def object_rechunk(spark, sf):
    sizes = fx.paths(spark, sf).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    return pyramid.rechunk(sizes, "n", [50, 60, 70])


@query(f"WITH {fx.P}, c AS (SELECT DISTINCT CAST(floor(x / 1000000.0) AS BIGINT) AS cx, CAST(floor(y / 100.0) AS BIGINT) AS cy, CAST(floor(z / 10.0) AS BIGINT) AS cz FROM p) SELECT cx, cy, cz, CAST(floor(cx / 3.0) AS BIGINT) AS tx, CAST(floor(cy / 3.0) AS BIGINT) AS ty, CAST(floor(cz / 3.0) AS BIGINT) AS tz FROM c")
def pyramid_target_chunks(spark, sf):
    return pyramid.target_chunks(fx.points(spark, sf), (1_000_000.0, 100.0, 10.0), 3)


@query(f"""WITH {fx.L}, q AS (SELECT *, CAST(floor(x / 20000.0) AS BIGINT) AS cx, CAST(floor(y / 2500.0) AS BIGINT) AS cy, CAST(floor(z / 10.0) AS BIGINT) AS cz FROM l),
k AS (SELECT object_id, cx, cy, cz FROM q GROUP BY ALL HAVING count(*) > 4 OR bool_or(x % 20000 = 0 OR y % 2500 = 0 OR z % 10 = 0))
SELECT object_id, seq FROM q JOIN k USING (object_id, cx, cy, cz)""")
def pyramid_drop_interior(spark, sf):
    return pyramid.drop_interior(fx.paths(spark, sf), CHUNK, 4).select("object_id", "seq")


@query(f"WITH {fx.L}, {ALIVE}, s AS (SELECT object_id, count(*) AS n FROM l GROUP BY object_id) SELECT s.object_id, al.object_id IS NOT NULL AS present, CASE WHEN al.object_id IS NOT NULL THEN CAST(n AS DOUBLE) END AS n FROM s LEFT JOIN al ON al.object_id = s.object_id")
def pyramid_attributes(spark, sf):
    level = fx.paths(spark, sf)
    sizes = level.groupBy("object_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return pyramid.attach(sizes, pyramid.survivors(level, 2.0, "attribute", 0))


@query("SELECT event_id AS object_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def object_properties(spark, sf):
    from terravane.sources import formats

    rows = fx.table(spark, sf, "events").select(F.col("event_id").alias("object_id"), "props")
    return formats.json_properties(rows, "props", "k long")


@query("SELECT user_id AS object_id, CAST(bit_or(CAST(1 AS BIGINT) << (event_id % 60)) AS BIGINT) AS mask FROM events GROUP BY user_id")
def object_tag_mask(spark, sf):
    from terravane.sources import formats

    tags = fx.table(spark, sf, "events").selectExpr("user_id AS object_id", "cast(event_id % 60 AS int) AS tag")
    return formats.tag_masks(tags)


@query("""WITH r AS (SELECT o_orderkey AS record, 12 + 12 * (1 + o_custkey % 40) AS bytes FROM orders), c AS (SELECT *, sum(bytes) OVER (ORDER BY record) - bytes AS start, (SELECT sum(bytes) FROM r) AS total FROM r)
SELECT record, CAST(start AS BIGINT) AS start, CAST(floor(CAST(start AS DOUBLE) * 8 / CAST(total AS DOUBLE)) AS BIGINT) AS part FROM c""")
def io_balanced_parts(spark, sf):
    """Records cut into eight parts of about equal bytes, in file order."""
    from terravane.sources import formats

    records = fx.table(spark, sf, "orders").selectExpr("o_orderkey AS record", "12 + 12 * (1 + o_custkey % 40) AS bytes")
    return formats.balanced_parts(records, 8)


@query(f"""WITH {fx.L}, k AS (SELECT *, dense_rank() OVER (ORDER BY object_id) - 1 AS o, row_number() OVER (PARTITION BY object_id ORDER BY seq) - 1 AS i FROM l)
SELECT o AS object_id, CAST(object_id AS DECIMAL(20,0)) AS segment_id, i, CASE WHEN i = 0 THEN CAST(-1 AS BIGINT) ELSE i - 1 END AS up,
CAST(x + 5 AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(object_id % 10 AS DOUBLE) AS weight FROM k""")
def io_plain_layer(spark, sf):
    """Paths written as the segments of a skeleton layer, and ingested from it with their properties."""
    from terravane.plans import runtime
    from terravane.sources import precomputed, ranged, store

    base, path = f"{runtime.shared_dir(spark)}/files/layer-{uuid.uuid4().hex}", _fresh(spark)
    paths_ = fx.paths(spark, sf).select("object_id", "seq", "x", "y", "z")
    ranged.write_documents(precomputed.segment_documents(paths_), base, "")
    affine = [1, 0, 0, 5, 0, 1, 0, 0, 0, 0, 1, 0]
    ranged.write_documents(spark.createDataFrame([("info", bytearray(json.dumps({"transform": affine}).encode()))], "name string, content binary"), base, "")
    properties = paths_.select(F.col("object_id").cast("decimal(20,0)").alias("segment_id"), (F.col("object_id") % 10).cast("double").alias("weight")).distinct()
    reader = precomputed.FolderReader(base)
    precomputed.run_ingest(spark, reader, reader.keys(), path, (20_000.0, 2_500.0, 10.0), align=False, parts=8, properties=properties)
    rows = store.read_points(spark, path, 0)
    first = rows.where("parent < 0").select("object_id", F.col("vertex_id").alias("first"))
    placed = rows.join(first, "object_id").join(store.read_objects(spark, path).select("object_id", "weight"), "object_id")
    up = F.when(F.col("parent") < 0, F.lit(-1)).otherwise(F.col("parent") - F.col("first")).cast("long")
    return placed.select("object_id", "segment_id", (F.col("vertex_id") - F.col("first")).alias("i"), up.alias("up"), "x", "y", "z", "weight")


@query(f"""WITH {fx.L} SELECT object_id // 64 AS part, dense_rank() OVER (PARTITION BY object_id // 64 ORDER BY object_id) - 1 AS object_id, seq,
CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM l""")
def io_trk_parts(spark, sf):
    """Paths written as TrackVis files, indexed, and read back by byte ranges."""
    from terravane.plans import runtime
    from terravane.sources import binary, ranged

    paths = fx.paths(spark, sf).withColumn("part", F.expr("object_id div 64"))
    folder = f"{runtime.shared_dir(spark)}/files/trk-{uuid.uuid4().hex}"
    ranged.write_documents(binary.trk_documents(paths, "part"), folder, "trk")
    read = ranged.read_tracks(spark, folder, step=1 << 14)
    return read.select(F.regexp_extract("file", r"(\d+)\.trk$", 1).cast("long").alias("part"), "object_id", "seq", "x", "y", "z")


def _store_query(name: str, sql: str, make) -> None:
    QUERIES[name] = make
    ORACLES[name] = sql


def _round_trip(spark, sf):
    from terravane.plans import runtime
    from terravane.sources import store

    path = f"{runtime.shared_dir(spark)}/stores/points-{uuid.uuid4().hex}"
    points = fx.points(spark, sf)
    store.write_level(points, path, 0, (1_000_000.0, 100.0, 10.0))
    return store.read_points(spark, path, 0, low=(5_000_000, 100, 10), high=(20_000_000, 900, 60), columns=["vertex_id", "object_id", "x", "y", "z"])


_store_query("io_store_bbox", f"WITH {fx.P} SELECT * FROM p WHERE x BETWEEN 5000000 AND 20000000 AND y BETWEEN 100 AND 900 AND z BETWEEN 10 AND 60", _round_trip)


@query(f"WITH {fx.P} SELECT format('{{:.6f}}', CAST(x AS DOUBLE)) AS dim0, format('{{:.6f}}', CAST(y AS DOUBLE)) AS dim1, format('{{:.6f}}', CAST(z AS DOUBLE)) AS dim2 FROM p")
def io_csv_rows(spark, sf):
    from terravane.sources import formats

    return formats.csv_rows(fx.points(spark, sf))


@query("""WITH e AS (SELECT p_partkey AS edge_id, p_partkey AS a, CAST(floor((p_partkey - 1) / CAST(1 + p_size % 4 AS DOUBLE)) AS BIGINT) AS b FROM part WHERE p_partkey > 0),
g AS (SELECT greatest(a, b) AS vertex_id, arg_min(least(a, b), edge_id) AS parent FROM e WHERE a <> b GROUP BY 1)
SELECT vertex_id, parent FROM g UNION ALL SELECT b, -1 FROM (SELECT DISTINCT least(a, b) AS b FROM e WHERE a <> b) WHERE b NOT IN (SELECT vertex_id FROM g)""")
def io_swc_parents(spark, sf):
    from terravane.sources import formats

    tree = fx.tree(spark, sf).where("parent >= 0").selectExpr("vertex_id AS edge_id", "vertex_id AS v0", "parent AS v1")
    return formats.swc_parents(tree)




# -- round trips through the store -----------------------------------------------


def _fresh(spark) -> str:
    from terravane.plans import runtime

    return f"{runtime.shared_dir(spark)}/stores/{uuid.uuid4().hex}"


@query(f"WITH {fx.M}, k AS (SELECT vertex_id FROM v WHERE x BETWEEN 2 AND 9 AND y BETWEEN 1 AND 12 AND z BETWEEN 0 AND 40) SELECT face_id, v0, v1, v2, object_id FROM f WHERE v0 IN (FROM k) AND v1 IN (FROM k) AND v2 IN (FROM k)")
def io_mesh_round_trip(spark, sf):
    """Faces of a stored mesh within a box."""
    from terravane.sources import store

    path = _fresh(spark)
    store.write_mesh(*fx.mesh(spark, sf), path, 0, (4.0, 4.0, 25.0))
    faces = store.read_mesh(spark, path, 0, low=(2, 1, 0), high=(9, 12, 40))[1]
    return store.require_link_width(faces, 3).select("face_id", "v0", "v1", "v2", "object_id")


@query(f"WITH {fx.E}, k AS (SELECT c_custkey AS v FROM customer WHERE c_custkey BETWEEN 20 AND 900 AND c_nationkey BETWEEN 3 AND 20) SELECT edge_id, v0, v1, weight FROM e WHERE v0 IN (FROM k) AND v1 IN (FROM k)")
def io_graph_round_trip(spark, sf):
    """Edges of a stored graph within a box."""
    from terravane.sources import store

    path = _fresh(spark)
    points = fx.table(spark, sf, "customer").selectExpr("c_custkey AS vertex_id", "c_custkey AS x", "c_nationkey AS y", "0 AS z")
    store.write_graph(points, fx.edges(spark, sf), path, 0, (100.0, 5.0, 1.0))
    edges = store.read_graph(spark, path, 0, low=(20, 3, 0), high=(900, 20, 0))[1]
    return store.require_link_width(edges, 2).select("edge_id", "v0", "v1", "weight")


@query(f"WITH {fx.T} SELECT vertex_id, parent, x, y, z FROM t WHERE parent >= 0")
def io_tree_round_trip(spark, sf):
    """Links of a stored tree, put back beside its vertices."""
    from terravane.sources import store

    path = _fresh(spark)
    store.write_tree(fx.tree(spark, sf), path, 0, (200.0, 20.0, 5.0))
    links = store.read_links(spark, path, 0, "parents").select(F.col("v0").alias("vertex_id"), F.col("v1").alias("up"))
    rows = store.read_points(spark, path, 0).join(links, "vertex_id")
    return rows.select("vertex_id", F.col("up").alias("parent"), "x", "y", "z")


# -- trees of a coarser level ----------------------------------------------------

THIN = """c AS (SELECT t.vertex_id, t.parent, count(k.vertex_id) AS children FROM t LEFT JOIN t k ON k.parent = t.vertex_id GROUP BY t.vertex_id, t.parent),
kd AS (SELECT vertex_id, parent, parent >= 0 AND children = 1 AS inner_ FROM c),
a(v, hops) AS (SELECT vertex_id, 0 FROM kd WHERE NOT inner_ UNION ALL SELECT kd.vertex_id, a.hops + 1 FROM a JOIN kd ON kd.parent = a.v AND kd.inner_),
at_ AS (SELECT vertex_id, parent, floor(x / 400.0) AS cx, floor(y / 20.0) AS cy, floor(z / 6.0) AS cz FROM t),
cr AS (SELECT p.vertex_id AS lo, p.parent AS hi FROM at_ p JOIN at_ q ON q.vertex_id = p.parent WHERE p.cx <> q.cx OR p.cy <> q.cy OR p.cz <> q.cz),
kp AS (SELECT v AS vertex_id FROM a WHERE hops % 3 = 0 UNION SELECT lo FROM cr UNION SELECT hi FROM cr),
o(v, owner) AS (SELECT vertex_id, vertex_id FROM kp UNION ALL SELECT t.vertex_id, o.owner FROM o JOIN t ON t.parent = o.v WHERE t.vertex_id NOT IN (SELECT vertex_id FROM kp))"""


def _thin(spark, sf):
    from terravane.operators import pyramid as p

    tree = fx.tree(spark, sf).withColumn("object_id", F.lit(0).cast("long"))
    return p.build_skeleton_pyramid(tree, (200.0, 10.0, 3.0), [3], attributes={"radius": "max"})[1]


@query(f"""WITH RECURSIVE {fx.T}, {THIN}, g AS (SELECT owner, max(radius) AS radius FROM o JOIN t ON t.vertex_id = o.v GROUP BY owner)
SELECT kp.vertex_id, coalesce(po.owner, -1) AS parent, g.radius, t.x, t.y, t.z FROM kp JOIN t USING (vertex_id) LEFT JOIN o po ON po.v = t.parent JOIN g ON g.owner = kp.vertex_id""")
def pyramid_skeleton(spark, sf):
    """A tree thinned to every third vertex between anchors and chunk crossings."""
    return _thin(spark, sf).vertices.select("vertex_id", "parent", "radius", "x", "y", "z")


@query(f"WITH RECURSIVE {fx.T}, {THIN} SELECT v AS vertex_id, owner AS parent FROM o")
def pyramid_skeleton_links(spark, sf):
    return _thin(spark, sf).parents
