"""Queries over points and object selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.operators import binning, filters, neighbours, selection
from terravane.plans import fixtures as fx
from terravane.plans.numbering import number_rows

QUERIES, ORACLES = {}, {}
BIN = (1_000_000.0, 100.0, 10.0)
LOW, HIGH = (5_000_000, 100, 10), (20_000_000, 900, 60)
CELL = "CAST(floor(x / 1000000.0) AS BIGINT) AS gx, CAST(floor(y / 100.0) AS BIGINT) AS gy, CAST(floor(z / 10.0) AS BIGINT) AS gz"
B = f"b AS (SELECT *, {CELL} FROM p)"


def query(sql: str | None):
    def put(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return put


@query(f"""WITH {fx.P}, {B} SELECT gx, gy, gz, count(*) AS n, CAST(sum(x) AS DOUBLE) / count(*) AS x, CAST(sum(y) AS DOUBLE) / count(*) AS y,
CAST(sum(z) AS DOUBLE) / count(*) AS z FROM b GROUP BY gx, gy, gz""")
def points_metanodes(spark, sf):
    return binning.metanodes(fx.points(spark, sf), BIN)


for _mode, _sql in (("sum", "CAST(sum(v) AS BIGINT)"), ("first", "arg_min(v, vertex_id)"), ("count", "count(v)"), ("max", "max(v)"), ("mean", "CAST(sum(v) AS DOUBLE) / count(*)")):

    def _metanodes(spark, sf, mode=_mode):
        points = fx.points(spark, sf).withColumn("v", F.col("x") % 1000)
        return binning.metanodes(points, BIN, ("v",), mode).select("gx", "gy", "gz", "v")

    QUERIES[f"points_metanodes_{_mode}"] = _metanodes
    ORACLES[f"points_metanodes_{_mode}"] = f"WITH {fx.P}, b AS (SELECT *, x % 1000 AS v, {CELL} FROM p) SELECT gx, gy, gz, {_sql} AS v FROM b GROUP BY gx, gy, gz"


@query(f"WITH {fx.P}, {B} SELECT gx, gy, gz, string_agg(CAST(vertex_id AS VARCHAR), ',' ORDER BY vertex_id) AS children FROM b GROUP BY gx, gy, gz")
def points_metanode_children(spark, sf):
    made = binning.metanodes(fx.points(spark, sf), BIN, children=True)
    return made.select("gx", "gy", "gz", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"))


@query(f"""WITH {fx.P}, {B}, c AS (SELECT gx, gy, gz, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz FROM b GROUP BY gx, gy, gz),
d AS (SELECT b.*, CAST(x * n - sx AS DOUBLE) * CAST(x * n - sx AS DOUBLE) + CAST(y * n - sy AS DOUBLE) * CAST(y * n - sy AS DOUBLE)
  + CAST(z * n - sz AS DOUBLE) * CAST(z * n - sz AS DOUBLE) AS q FROM b JOIN c USING (gx, gy, gz))
SELECT gx, gy, gz, vertex_id FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY q, vertex_id) AS r FROM d) WHERE r = 1""")
def points_medoid(spark, sf):
    return binning.medoids(fx.points(spark, sf), BIN)


@query(f"""WITH {fx.P}, {B}, c AS (SELECT gx, gy, gz, object_id, count(*) AS n FROM b GROUP BY ALL)
SELECT gx, gy, gz, object_id, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY n DESC, object_id) AS r FROM c) WHERE r = 1""")
def points_majority_object(spark, sf):
    return binning.majority(fx.points(spark, sf), BIN)


@query(f"""WITH {fx.P}, {B}, c AS (SELECT gx, gy, gz, object_id, count(*) AS n FROM b GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY n DESC, object_id) AS r FROM c) WHERE r = 1)
SELECT b.gx, b.gy, b.gz, count(*) AS n, CAST(sum(x) AS DOUBLE) / count(*) AS x, CAST(sum(y) AS DOUBLE) / count(*) AS y,
CAST(sum(z) AS DOUBLE) / count(*) AS z, any_value(m.object_id) AS object_id, any_value(m.n) AS votes
FROM b JOIN m USING (gx, gy, gz) GROUP BY b.gx, b.gy, b.gz""")
def points_coarsen(spark, sf):
    return binning.coarsen_points(fx.points(spark, sf), BIN)


@query(f"WITH {fx.P} SELECT * FROM p WHERE x BETWEEN 5000000 AND 20000000 AND y BETWEEN 100 AND 900 AND z BETWEEN 10 AND 60")
def points_filter_bbox(spark, sf):
    return filters.by_bbox(fx.points(spark, sf), LOW, HIGH)


@query(f"WITH {fx.P} SELECT * FROM p WHERE object_id IN (1, 2, 3, 50, 77)")
def points_filter_objects(spark, sf):
    return filters.by_ids(fx.points(spark, sf), "object_id", [1, 2, 3, 50, 77])


@query(f"WITH {fx.P}, {B} SELECT vertex_id, object_id, x, y, z FROM b WHERE (gx, gy, gz) IN ((10, 3, 4), (11, 3, 4), (12, 5, 0))")
def points_filter_chunks(spark, sf):
    return filters.by_chunks(fx.points(spark, sf), [(10, 3, 4), (11, 3, 4), (12, 5, 0)], BIN)


@query(f"""WITH {fx.P}, {B} SELECT vertex_id, object_id, x, y, z FROM b
WHERE x BETWEEN 5000000 AND 20000000 AND y BETWEEN 100 AND 900 AND z BETWEEN 10 AND 60 AND object_id % 5 = 2""")
def points_filter_combined(spark, sf):
    points = fx.points(spark, sf)
    members = points.select("object_id").distinct().withColumn("group_id", F.col("object_id") % 5)
    return filters.by_groups(filters.by_bbox(points, LOW, HIGH), members, [2])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END IS NOT NULL
AND CASE WHEN l_tax > 0.07 THEN NULL ELSE l_tax END IS NOT NULL""")
def points_drop_na(spark, sf):
    rows = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        "CASE WHEN l_discount = 0 THEN double('NaN') ELSE l_discount END AS x", "CASE WHEN l_tax > 0.07 THEN NULL ELSE l_tax END AS y",
    )
    return filters.drop_na(rows, ["x", "y"]).drop("x", "y")


@query("""SELECT min(o_orderkey) AS vertex_id, o_custkey AS x, o_orderkey % 7 AS y FROM orders GROUP BY o_custkey, o_orderkey % 7""")
def points_drop_duplicates(spark, sf):
    rows = fx.table(spark, sf, "orders").selectExpr("o_orderkey AS vertex_id", "o_custkey AS x", "o_orderkey % 7 AS y")
    return filters.drop_duplicates(rows, ["x", "y"], "vertex_id")


@query(f"""WITH {fx.P}, m AS (SELECT CAST(sum(x) AS DOUBLE) / count(*) AS mx, CAST(sum(y) AS DOUBLE) / count(*) AS my, CAST(sum(z) AS DOUBLE) / count(*) AS mz FROM p),
s AS (SELECT greatest(max(abs(x - mx)), max(abs(y - my)), max(abs(z - mz))) AS s FROM p, m)
SELECT vertex_id, round((x - mx) / s, 9) AS x, round((y - my) / s, 9) AS y, round((z - mz) / s, 9) AS z FROM p, m, s""")
def points_normalise(spark, sf):
    moved, _ = filters.normalise(fx.points(spark, sf))
    return moved.select("vertex_id", *[F.round(a, 9).alias(a) for a in "xyz"])


@query(f"WITH {fx.P} SELECT object_id, count(*) AS n FROM p GROUP BY object_id")
def points_per_object(spark, sf):
    return fx.points(spark, sf).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {fx.P}, {B} SELECT vertex_id, gx, gy, gz FROM b")
def points_cells(spark, sf):
    return binning.binned(fx.points(spark, sf), BIN).select("vertex_id", "gx", "gy", "gz")


@query(f"WITH {fx.P}, {B} SELECT vertex_id, row_number() OVER (ORDER BY gx, gy, gz, vertex_id) - 1 AS global_id FROM b")
def points_global_ids(spark, sf):
    return number_rows(binning.binned(fx.points(spark, sf), BIN), ["gx", "gy", "gz", "vertex_id"], "global_id").select("vertex_id", "global_id")


@query(f"WITH {fx.P}, {B}, n AS (SELECT gx, gy, gz, row_number() OVER (ORDER BY gx, gy, gz) - 1 AS metavertex FROM (SELECT DISTINCT gx, gy, gz FROM b)) SELECT vertex_id, metavertex FROM b JOIN n USING (gx, gy, gz)")
def points_metavertices(spark, sf):
    return binning.metavertices(fx.points(spark, sf), BIN)


@query(f"WITH {fx.P}, {B} SELECT min(vertex_id) AS vertex_id FROM b GROUP BY gx, gy, gz")
def select_point_thinning(spark, sf):
    return selection.thin(fx.points(spark, sf), BIN)


O = "o AS (SELECT o_custkey AS object_id, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS length FROM orders GROUP BY o_custkey)"


def _objects(spark, sf):
    return fx.points(spark, sf).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("length"))


@query(f"WITH {O} SELECT object_id, n, length FROM o ORDER BY length DESC, object_id LIMIT 50")
def select_by_length(spark, sf):
    return selection.top(_objects(spark, sf), "length", 50)


@query(f"WITH {O} SELECT object_id, n, length FROM o ORDER BY n, object_id LIMIT 40")
def select_by_attribute(spark, sf):
    return selection.top(_objects(spark, sf), "n", 40, largest=False)


@query(f"WITH {O} SELECT object_id FROM o ORDER BY length DESC, object_id LIMIT (SELECT greatest(1, CAST(round_even(count(*) * 0.3, 0) AS BIGINT)) FROM o)")
def select_sparsity_length(spark, sf):
    return selection.apply_sparsity(_objects(spark, sf), 0.3, "length", "length")


@query(f"WITH {O} SELECT object_id FROM o ORDER BY md5('5:' || object_id), object_id LIMIT (SELECT least(count(*), greatest(1, CAST(round_even(count(*) * 0.25, 0) AS BIGINT))) FROM o)")
def select_random(spark, sf):
    """A quarter of the objects, drawn by the least digests of seed and id."""
    return selection.apply_sparsity(_objects(spark, sf), 0.25, "random", seed=5).select("object_id")


COVER = """WITH {c}, p0 AS (SELECT c_custkey AS object_id, CAST(floor(c_nationkey / 2.0) AS BIGINT) AS gx, CAST(floor(round(c_acctbal * 100) / 300000.0) AS BIGINT) AS gy FROM customer),
b AS (SELECT gx, gy, count(*) AS n, min(object_id) AS lead FROM p0 GROUP BY gx, gy),
t AS (SELECT count(*) AS bins, sum(n - 1) AS more FROM b),
s AS (SELECT b.*, CAST(floor(least(300 - bins, more) * (n - 1) / CAST(more AS DOUBLE)) AS BIGINT) AS extra FROM b, t),
u AS (SELECT s.*, row_number() OVER (ORDER BY n - 1 DESC, lead) AS r, (SELECT least(300 - bins, more) FROM t) - (SELECT sum(extra) FROM s) AS spare FROM s),
r AS (SELECT p0.*, row_number() OVER (PARTITION BY gx, gy ORDER BY object_id) AS place FROM p0)
SELECT object_id FROM r JOIN u USING (gx, gy) WHERE place <= 1 + extra + CASE WHEN r <= spare THEN 1 ELSE 0 END"""


@query(COVER.replace("{c}, ", ""))
def select_spatial_coverage(spark, sf):
    points = fx.table(spark, sf, "customer").selectExpr("c_custkey AS object_id", "c_nationkey AS x", "round(c_acctbal * 100) AS y", "0 AS z")
    return selection.cover(points, (2.0, 300_000.0, 1.0), 300)


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 10 = 0),
d AS (SELECT q.vec_id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda s: (CAST(s[1] AS DOUBLE) - CAST(s[2] AS DOUBLE)) * (CAST(s[1] AS DOUBLE) - CAST(s[2] AS DOUBLE)))) AS d2, e.vec_id AS other
  FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
SELECT vec_id, round(sqrt(d2), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, other) AS r FROM d) WHERE r = 5""")
def points_knn_vectors(spark, sf):
    """The stated query set is every tenth vector, against all vectors."""
    rows = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return neighbours.knn_vectors(rows, rows.where("vec_id % 10 = 0"), 5).select("vec_id", F.round("distance", 6).alias("distance"))


@query("""WITH p AS (SELECT c_custkey AS vertex_id, c_custkey % 50 AS x, c_nationkey AS y, CAST(round(c_acctbal) AS BIGINT) % 40 AS z FROM customer),
d AS (SELECT a.vertex_id, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS q FROM p a JOIN p b ON a.vertex_id <> b.vertex_id)
SELECT vertex_id, round(sum(sqrt(q)) / 3, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vertex_id ORDER BY q) AS r FROM d) WHERE r <= 3 GROUP BY vertex_id""")
def points_knn_distance(spark, sf):
    points = fx.table(spark, sf, "customer").selectExpr("c_custkey AS vertex_id", "c_custkey % 50 AS x", "c_nationkey AS y", "cast(round(c_acctbal) AS bigint) % 40 AS z")
    return neighbours.knn_distance(points, 3, 6.0).select("vertex_id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {fx.P}, {B}, c AS (SELECT DISTINCT gx, gy, gz FROM b), o(d) AS (VALUES (-1), (0), (1))
SELECT c.gx AS cx, c.gy AS cy, c.gz AS cz, n.gx AS nx, n.gy AS ny, n.gz AS nz FROM c, o i, o j, o k, c n
WHERE n.gx = c.gx + i.d AND n.gy = c.gy + j.d AND n.gz = c.gz + k.d AND NOT (i.d = 0 AND j.d = 0 AND k.d = 0)""")
def points_neighbour_chunks(spark, sf):
    chunks = binning.binned(fx.points(spark, sf), BIN).selectExpr("gx AS cx", "gy AS cy", "gz AS cz").distinct()
    return filters.neighbour_chunks(chunks)
