"""Queries over line segments and ordered paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.operators import filters, paths
from terravane.plans import fixtures as fx

QUERIES, ORACLES = {}, {}
CHUNK = (20_000.0, 2_500.0, 10.0)
C = "CAST(floor(x / 20000.0) AS BIGINT) AS cx, CAST(floor(y / 2500.0) AS BIGINT) AS cy, CAST(floor(z / 10.0) AS BIGINT) AS cz"
W = "OVER (PARTITION BY object_id ORDER BY seq)"
STEP = f"""st AS (SELECT *, coalesce(sqrt(CAST((x - lag(x) {W}) * (x - lag(x) {W}) + (y - lag(y) {W}) * (y - lag(y) {W}) + (z - lag(z) {W}) * (z - lag(z) {W}) AS DOUBLE)), 0) AS step FROM l)"""
RANK = f"k AS (SELECT *, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY object_id) AS n FROM l)"
RUN = f"""q AS (SELECT *, {C} FROM l), j AS (SELECT *, CASE WHEN lag(cx) {W} <> cx OR lag(cy) {W} <> cy OR lag(cz) {W} <> cz THEN 1 ELSE 0 END AS moved FROM q),
u AS (SELECT *, CAST(sum(moved) {W} AS BIGINT) AS run FROM j)"""
FRAG = f"""{RUN}, g AS (SELECT object_id, run, cx, cy, cz, count(*) AS n, min(seq) AS first_seq FROM u GROUP BY object_id, run, cx, cy, cz),
fr AS (SELECT *, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY object_id, run) - 1 AS fragment FROM g)"""


def query(sql: str | None):
    def put(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return put


SEG = f"sg AS (SELECT * FROM (SELECT object_id, seq, x AS x0, y AS y0, z AS z0, lead(x) {W} AS x1, lead(y) {W} AS y1, lead(z) {W} AS z1 FROM l) WHERE x1 IS NOT NULL)"
SEGLEN = "sqrt(CAST((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)+(z1-z0)*(z1-z0) AS DOUBLE))"


@query(f"WITH {fx.L}, {SEG} SELECT object_id, seq, round({SEGLEN}, 6) AS length FROM sg")
def lines_length(spark, sf):
    return paths.line_lengths(paths.segments(fx.paths(spark, sf))).select("object_id", "seq", F.round("length", 6).alias("length"))


@query("""SELECT l_orderkey, x0, x1, round(sqrt((x1-x0)*(x1-x0)), 6) AS length FROM
(SELECT l_orderkey, l_quantity AS x0, CAST(1 + l_partkey % 50 AS DOUBLE) AS x1 FROM lineitem) WHERE x0 <> x1""")
def lines_drop_zero(spark, sf):
    rows = fx.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_quantity AS x0", "0 AS y0", "0 AS z0", "cast(1 + l_partkey % 50 AS double) AS x1", "0 AS y1", "0 AS z1")
    return paths.line_lengths(rows, drop_zero=True).select("l_orderkey", "x0", "x1", F.round("length", 6).alias("length"))


@query(f"WITH {fx.L}, {STEP} SELECT object_id, count(*) AS n, round(sum(step), 4) AS length FROM st GROUP BY object_id")
def poly_lengths(spark, sf):
    return paths.lengths(fx.paths(spark, sf)).select("object_id", "n", F.round("length", 4).alias("length"))


@query(f"""WITH {fx.L}, {RANK} SELECT a.object_id, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1
FROM k a JOIN k b ON a.object_id = b.object_id AND a.i = 0 AND b.i = b.n - 1""")
def poly_endpoints(spark, sf):
    return paths.endpoints(fx.paths(spark, sf))


@query(f"WITH {fx.L}, {RANK} SELECT object_id, seq, x, y, z FROM k WHERE i = n // 2")
def poly_representative(spark, sf):
    return paths.representatives(fx.paths(spark, sf))


@query(f"WITH {fx.L}, {STEP}, ln AS (SELECT object_id, count(*) AS n, sum(step) AS length FROM st GROUP BY object_id) SELECT object_id, n, round(length, 4) AS length FROM ln WHERE length BETWEEN 100000 AND 400000")
def poly_filter_length(spark, sf):
    kept = filters.by_length(paths.lengths(fx.paths(spark, sf)), 100_000, 400_000)
    return kept.select("object_id", "n", F.round("length", 4).alias("length"))


@query(f"WITH {fx.L}, {RANK} SELECT object_id, seq, x, y, z FROM k WHERE n <= 2 OR i % 8 = 0 OR i = n - 1")
def poly_decimate(spark, sf):
    return paths.decimate(fx.paths(spark, sf), 8).select("object_id", "seq", "x", "y", "z")


@query(f"WITH {fx.L}, {RUN} SELECT object_id, seq, cx, cy, cz, run FROM u")
def poly_runs(spark, sf):
    return paths.runs(fx.paths(spark, sf), CHUNK).select("object_id", "seq", "cx", "cy", "cz", "run")


V = "OVER (PARTITION BY object_id, run ORDER BY seq)"
POS = f"{RUN}, m AS (SELECT *, x // 5000 AS mv FROM u), c AS (SELECT *, CASE WHEN lag(mv) {V} <> mv THEN 1 ELSE 0 END AS new FROM m), pp AS (SELECT *, CAST(sum(new) {V} AS BIGINT) AS pos FROM c)"


def _with_meta(spark, sf):
    return fx.paths(spark, sf).withColumn("mv", F.expr("x div 5000"))


@query(f"WITH {fx.L}, {POS} SELECT object_id, seq, run, pos FROM pp")
def poly_run_positions(spark, sf):
    return paths.runs(_with_meta(spark, sf), CHUNK, "mv").select("object_id", "seq", "run", "pos")


@query(f"WITH {fx.L}, {POS}, d AS (SELECT object_id, run, pos, any_value(mv) AS mv FROM pp GROUP BY ALL) SELECT object_id, run, string_agg(CAST(mv AS VARCHAR), ',' ORDER BY pos) AS members FROM d GROUP BY object_id, run")
def poly_collapsed_runs(spark, sf):
    made = paths.collapsed_runs(_with_meta(spark, sf), CHUNK, "mv")
    return made.select("object_id", "run", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query(f"WITH {fx.L}, {FRAG} SELECT object_id, run, cx, cy, cz, n, first_seq, fragment FROM fr")
def poly_fragments(spark, sf):
    return paths.fragments(fx.paths(spark, sf), CHUNK).select("object_id", "run", "cx", "cy", "cz", "n", "first_seq", "fragment")


@query(f"WITH {fx.L}, {FRAG} SELECT cx, cy, cz, fragment, n, CAST(sum(n) OVER (PARTITION BY cx, cy, cz ORDER BY fragment) - n AS BIGINT) AS start FROM fr")
def poly_fragment_starts(spark, sf):
    return paths.fragment_starts(paths.fragments(fx.paths(spark, sf), CHUNK)).select("cx", "cy", "cz", "fragment", "n", "start")


@query(f"WITH {fx.L}, {FRAG} SELECT object_id, string_agg(cx || '.' || cy || '.' || cz || ':' || fragment, ' ' ORDER BY run) AS manifest FROM fr GROUP BY object_id")
def poly_manifest(spark, sf):
    made = paths.manifests(paths.fragments(fx.paths(spark, sf), CHUNK))
    return made.select("object_id", F.expr("array_join(transform(manifest, m -> concat(m.cx, '.', m.cy, '.', m.cz, ':', m.fragment)), ' ')").alias("manifest"))


LINK = f"""q AS (SELECT *, {C} FROM l), nx AS (SELECT *, lead(seq) {W} AS seq1, lead(cx) {W} AS ax, lead(cy) {W} AS ay, lead(cz) {W} AS az FROM q),
cl AS (SELECT * FROM nx WHERE seq1 IS NOT NULL AND (ax <> cx OR ay <> cy OR az <> cz))"""


@query(f"WITH {fx.L}, {LINK} SELECT object_id, seq AS seq0, seq1, ax - cx AS dx, ay - cy AS dy, az - cz AS dz FROM cl")
def poly_cross_links(spark, sf):
    return paths.cross_links(fx.paths(spark, sf), CHUNK)


@query(f"""WITH {fx.L}, {LINK}, o AS (SELECT CASE WHEN (cx, cy, cz) < (ax, ay, az) THEN [cx, cy, cz] ELSE [ax, ay, az] END AS a,
CASE WHEN (cx, cy, cz) < (ax, ay, az) THEN [ax, ay, az] ELSE [cx, cy, cz] END AS b FROM cl)
SELECT DISTINCT a[1] AS ax, a[2] AS ay, a[3] AS az, b[1] AS ox, b[2] AS oy, b[3] AS oz FROM o""")
def poly_link_cells(spark, sf):
    return paths.link_cells(fx.paths(spark, sf), CHUNK)


@query(f"""WITH {fx.L}, q AS (SELECT *, {C} FROM l), h AS (SELECT *, (cx, cy, cz) IN ((0, 0, 0), (0, 1, 0), (1, 2, 0)) AS keep FROM q),
b AS (SELECT *, CASE WHEN keep AND NOT coalesce(lag(keep) {W}, false) THEN 1 ELSE 0 END AS broke FROM h),
r AS (SELECT *, CAST(sum(broke) {W} - 1 AS BIGINT) AS part FROM b) SELECT object_id, part, seq, x, y, z FROM r WHERE keep""")
def poly_read_chunks(spark, sf):
    return paths.read_chunks(fx.paths(spark, sf), CHUNK, [(0, 0, 0), (0, 1, 0), (1, 2, 0)])


for _by, _order in (("longest", "n DESC, object_id DESC"), ("first", "object_id")):

    def _subsample(spark, sf, rule=_by):
        return paths.subsample(fx.paths(spark, sf), (4_000.0, 5_000.0, 10.0), 2, rule)

    QUERIES[f"poly_subsample_{_by}"] = _subsample
    ORACLES[f"poly_subsample_{_by}"] = f"""WITH {fx.L}, {RANK}, b AS (SELECT object_id, n, CAST(floor(x / 4000.0) AS BIGINT) AS gx, CAST(floor(y / 5000.0) AS BIGINT) AS gy,
CAST(floor(z / 10.0) AS BIGINT) AS gz FROM k WHERE i = n // 2) SELECT object_id FROM (SELECT object_id, row_number() OVER (PARTITION BY gx, gy, gz ORDER BY {_order}) AS r FROM b) WHERE r <= 2"""


def _rdp(eps: float) -> str:
    return f"""WITH RECURSIVE {fx.L}, {RANK}, p AS (SELECT object_id AS o, i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM k),
s(o, lo, hi) AS (SELECT o, CAST(0 AS BIGINT), max(i) FROM p GROUP BY o
UNION ALL SELECT w.o, unnest([w.lo, w.m]), unnest([w.m, w.hi]) FROM (
  SELECT * FROM (SELECT t.o, t.lo, t.hi, t.m, t.d2, row_number() OVER (PARTITION BY t.o, t.lo, t.hi ORDER BY t.d2 DESC, t.m) AS rn FROM (
    SELECT g.*, (qx - u * dx) * (qx - u * dx) + (qy - u * dy) * (qy - u * dy) + (qz - u * dz) * (qz - u * dz) AS d2 FROM (
      SELECT s.o, s.lo, s.hi, q.i AS m, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, q.x - a.x AS qx, q.y - a.y AS qy, q.z - a.z AS qz,
        CASE WHEN (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z) < 1e-30 THEN 0.0 ELSE least(1.0, greatest(0.0,
          ((b.x-a.x)*(q.x-a.x)+(b.y-a.y)*(q.y-a.y)+(b.z-a.z)*(q.z-a.z)) / ((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)))) END AS u
      FROM s JOIN p a ON a.o = s.o AND a.i = s.lo JOIN p b ON b.o = s.o AND b.i = s.hi JOIN p q ON q.o = s.o AND q.i > s.lo AND q.i < s.hi) g) t) z
  WHERE rn = 1 AND d2 > {eps * eps}) w)
SELECT DISTINCT k.object_id, k.seq, k.x, k.y, k.z FROM (SELECT o, lo AS i FROM s UNION SELECT o, hi FROM s) e JOIN k ON k.object_id = e.o AND k.i = e.i"""


@query(_rdp(3000.0))
def poly_simplify(spark, sf):
    return paths.simplify(fx.paths(spark, sf), 3000.0).select("object_id", "seq", "x", "y", "z")


@query(f"WITH {fx.L} SELECT object_id, CAST(sum(z) AS DOUBLE) / count(*) AS mean_z FROM l GROUP BY object_id")
def poly_mean_scalar(spark, sf):
    return fx.paths(spark, sf).groupBy("object_id").agg((F.sum("z") / F.count(F.lit(1)).cast("double")).alias("mean_z"))


@query(f"WITH {fx.L}, c AS (SELECT object_id, count(*) AS n FROM l GROUP BY object_id) SELECT object_id, CAST(sum(n) OVER (ORDER BY object_id) - n AS BIGINT) AS start FROM c")
def poly_offsets(spark, sf):
    from terravane.sources import formats

    return formats.offsets(fx.paths(spark, sf))


@query(f"WITH {fx.L} SELECT object_id % 5 AS group_id, object_id, count(*) AS n FROM l WHERE object_id % 5 IN (1, 3) GROUP BY object_id")
def poly_filter_groups(spark, sf):
    path = fx.paths(spark, sf)
    members = path.select("object_id").distinct().withColumn("group_id", F.col("object_id") % 5)
    kept = filters.by_groups(path, members, [1, 3])
    return kept.groupBy("object_id").agg(F.count(F.lit(1)).alias("n")).withColumn("group_id", F.col("object_id") % 5)
