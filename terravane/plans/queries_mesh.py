"""Queries over triangle meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.operators import binning, filters, mesh, quadric, mesh_search
from terravane.plans import fixtures as fx

QUERIES, ORACLES = {}, {}
CHUNK = (8.0, 8.0, 20.0)


def query(sql: str | None):
    def put(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return put


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


EDGE = "eg AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM (SELECT v0 AS a, v1 AS b FROM f UNION ALL SELECT v1, v2 FROM f UNION ALL SELECT v2, v0 FROM f))"
AREA = "sqrt(CAST(nx * nx + ny * ny + nz * nz AS DOUBLE)) / 2"
VOL = "(x0*(y1*z2-z1*y2)+y0*(z1*x2-x1*z2)+z0*(x1*y2-y1*x2)) / 6.0"


@query(f"""WITH {fx.M}, {EDGE} SELECT (SELECT count(*) FROM f) AS n_faces, round(sum({AREA}), 4) AS area, round(CAST(sum({VOL}) AS DOUBLE), 4) AS volume,
(SELECT count(*) FROM eg) AS n_edges, (SELECT count(*) FROM v) AS n_vertices, CAST(0 AS BIGINT) AS excluded,
(SELECT count(*) FROM v) - (SELECT count(*) FROM eg) + (SELECT count(*) FROM f) AS euler FROM fc""")
def mesh_summary(spark, sf):
    return rounded(mesh.summary(*fx.mesh(spark, sf)), "area", "volume", digits=4)


CELLS = ", ".join(f"CAST(floor({a}{k} / {s}) AS BIGINT)" for k in range(3) for a, s in zip("xyz", ("8.0", "8.0", "20.0")))
_C = [f"[{', '.join(f'CAST(floor({a}{k} / {s}) AS BIGINT)' for a, s in zip('xyz', ('8.0', '8.0', '20.0')))}]" for k in range(3)]
CROSS = f"fx AS (SELECT *, ({_C[0]} <> {_C[1]} OR {_C[1]} <> {_C[2]}) AS is_cross FROM fc)"


@query(f"""WITH {fx.M}, {CROSS}, eg AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM (
  SELECT v0 AS a, v1 AS b FROM fx UNION ALL SELECT v1, v2 FROM fx UNION ALL SELECT v2, v0 FROM fx WHERE NOT is_cross))
SELECT count(*) FILTER (NOT is_cross) AS n_faces, round(sum(CASE WHEN is_cross THEN 0 ELSE {AREA} END), 4) AS area,
round(CAST(sum(CASE WHEN is_cross THEN 0 ELSE {VOL} END) AS DOUBLE), 4) AS volume, (SELECT count(*) FROM eg) AS n_edges, (SELECT count(*) FROM v) AS n_vertices,
2 * count(*) FILTER (is_cross) AS excluded, (SELECT count(*) FROM v) - (SELECT count(*) FROM eg) + count(*) FILTER (NOT is_cross) AS euler FROM fx""")
def mesh_summary_chunked(spark, sf):
    return rounded(mesh.summary(*fx.mesh(spark, sf), shape=CHUNK), "area", "volume", digits=4)


@query(f"""WITH {fx.M}, eg AS (SELECT object_id, count(*) AS n_edges FROM (SELECT DISTINCT object_id, least(a, b) AS u, greatest(a, b) AS v FROM (
  SELECT object_id, v0 AS a, v1 AS b FROM f UNION ALL SELECT object_id, v1, v2 FROM f UNION ALL SELECT object_id, v2, v0 FROM f)) GROUP BY object_id),
vv AS (SELECT object_id, count(DISTINCT c) AS n_vertices FROM (SELECT object_id, unnest([v0, v1, v2]) AS c FROM f) GROUP BY object_id)
SELECT object_id, count(*) AS n_faces, round(sum({AREA}), 4) AS area, round(CAST(sum({VOL}) AS DOUBLE), 4) AS volume, CAST(0 AS BIGINT) AS excluded,
any_value(n_edges) AS n_edges, any_value(n_vertices) AS n_vertices, any_value(n_vertices) - any_value(n_edges) + count(*) AS euler
FROM fc JOIN eg USING (object_id) JOIN vv USING (object_id) GROUP BY object_id""")
def mesh_summary_per_object(spark, sf):
    return rounded(mesh.summary(*fx.mesh(spark, sf), by="object_id"), "area", "volume", digits=4)


@query(f"WITH {fx.M}, {EDGE} SELECT u, v FROM eg")
def mesh_edges(spark, sf):
    return mesh.edges(fx.mesh(spark, sf)[1])


@query(f"""WITH {fx.M}, o AS (SELECT least(a, b) AS u, greatest(a, b) AS v FROM (SELECT v0 AS a, v1 AS b FROM f UNION ALL SELECT v1, v2 FROM f UNION ALL SELECT v2, v0 FROM f)
GROUP BY ALL HAVING count(*) = 1) SELECT DISTINCT unnest([u, v]) AS vertex_id FROM o""")
def mesh_boundary(spark, sf):
    return mesh.boundary_vertices(fx.mesh(spark, sf)[1])


@query(f"WITH {fx.M}, {CROSS} SELECT face_id, is_cross FROM fx")
def mesh_cross_faces(spark, sf):
    return mesh.intra(*fx.mesh(spark, sf), CHUNK).select("face_id", "is_cross")


for _weighting, _n in (("area", ("nx", "ny", "nz")), ("uniform", tuple(f"n{a} / sqrt(CAST(nx*nx+ny*ny+nz*nz AS DOUBLE))" for a in "xyz"))):

    def _normals(spark, sf, weighting=_weighting):
        return rounded(mesh.vertex_normals(*fx.mesh(spark, sf), weighting), "nx", "ny", "nz", digits=5)

    QUERIES[f"mesh_normals_{_weighting}"] = _normals
    ORACLES[f"mesh_normals_{_weighting}"] = f"""WITH {fx.M}, c AS (SELECT unnest([v0, v1, v2]) AS vertex_id, {_n[0]} AS a, {_n[1]} AS b, {_n[2]} AS c FROM fc),
g AS (SELECT vertex_id, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(b) AS DOUBLE) AS b, CAST(sum(c) AS DOUBLE) AS c FROM c GROUP BY vertex_id)
SELECT v.vertex_id, round(coalesce(a / sqrt(a*a+b*b+c*c), 0), 5) + 0.0::DOUBLE AS nx, round(coalesce(b / sqrt(a*a+b*b+c*c), 0), 5) + 0.0::DOUBLE AS ny, round(coalesce(c / sqrt(a*a+b*b+c*c), 0), 5) + 0.0::DOUBLE AS nz
FROM v LEFT JOIN g USING (vertex_id)"""


def _cot(i, j, k):
    a = [f"({x}{i}-{x}{k})" for x in "xyz"]
    b = [f"({x}{j}-{x}{k})" for x in "xyz"]
    dot = "+".join(f"{p}*{q}" for p, q in zip(a, b))
    cot = f"CAST({dot} AS DOUBLE) / sqrt(CAST(nx*nx+ny*ny+nz*nz AS DOUBLE))"
    rows = []
    for at, s in ((i, ""), (j, "-")):
        rows.append(f"SELECT v{at} AS vertex_id, " + ", ".join(f"{s}({x}{j}-{x}{i}) * ({cot}) AS h{x}" for x in "xyz") + ", CAST(0 AS DOUBLE) AS area FROM fc")
    return rows


_ROWS = [r for t in ((0, 1, 2), (1, 2, 0), (2, 0, 1)) for r in _cot(*t)] + [f"SELECT v{k}, 0, 0, 0, {AREA} / 3 FROM fc" for k in range(3)]


@query(f"""WITH {fx.M}, c AS ({' UNION ALL '.join(_ROWS)}), g AS (SELECT vertex_id, sum(hx) AS hx, sum(hy) AS hy, sum(hz) AS hz, sum(area) AS area FROM c GROUP BY vertex_id)
SELECT v.vertex_id, round(coalesce(sqrt(hx*hx+hy*hy+hz*hz) / (2 * area) / 2, 0), 5) AS curvature FROM v LEFT JOIN g USING (vertex_id)""")
def mesh_curvature(spark, sf):
    return rounded(mesh.mean_curvature(*fx.mesh(spark, sf)), "curvature", digits=5)


@query(f"""WITH {fx.M}, b AS (SELECT vertex_id, CAST(floor(x / 4.0) AS BIGINT) || ',' || CAST(floor(y / 4.0) AS BIGINT) || ',' || CAST(floor(z / 25.0) AS BIGINT) AS b FROM v),
m AS (SELECT face_id, p.b AS v0, q.b AS v1, r.b AS v2 FROM f JOIN b p ON p.vertex_id = v0 JOIN b q ON q.vertex_id = v1 JOIN b r ON r.vertex_id = v2 WHERE p.b <> q.b AND q.b <> r.b AND p.b <> r.b)
SELECT face_id, v0, v1, v2 FROM (SELECT *, row_number() OVER (PARTITION BY list_sort([v0, v1, v2]) ORDER BY face_id) AS n FROM m) WHERE n = 1""")
def mesh_cluster(spark, sf):
    return binning.coarsen_mesh(*fx.mesh(spark, sf), (4.0, 4.0, 25.0))[1]


@query(f"WITH {fx.M} SELECT CAST(floor(x / 4.0) AS BIGINT) AS gx, CAST(floor(y / 4.0) AS BIGINT) AS gy, CAST(floor(z / 25.0) AS BIGINT) AS gz, count(*) AS n, CAST(sum(x) AS DOUBLE) / count(*) AS x, CAST(sum(y) AS DOUBLE) / count(*) AS y, CAST(sum(z) AS DOUBLE) / count(*) AS z FROM v GROUP BY 1, 2, 3")
def mesh_cluster_vertices(spark, sf):
    return binning.coarsen_mesh(*fx.mesh(spark, sf), (4.0, 4.0, 25.0))[0]


@query(None)
def mesh_simplify(spark, sf):
    """Clustering for about a quarter of the faces; its bin edge is derived from the data."""
    v, f = fx.mesh(spark, sf)
    return binning.coarsen_mesh_to(v, f, max(1, f.count() // 4))[1]


@query(None)
def mesh_quadric(spark, sf):
    """Collapses depend on the order of equal costs; tests hold shapes and counts."""
    return quadric.simplify(*fx.mesh(spark, sf), 0.5)


@query(f"""WITH {fx.M}, k AS (SELECT * FROM v WHERE x BETWEEN 3 AND 20 AND y BETWEEN 2 AND 17 AND z BETWEEN 0 AND 45)
SELECT face_id, v0, v1, v2 FROM f WHERE v0 IN (SELECT vertex_id FROM k) AND v1 IN (SELECT vertex_id FROM k) AND v2 IN (SELECT vertex_id FROM k)""")
def mesh_filter_bbox(spark, sf):
    v, f = fx.mesh(spark, sf)
    kept = filters.by_bbox(v, (3, 2, 0), (20, 17, 45))
    return filters.edges_within(f, kept, ("v0", "v1", "v2")).select("face_id", "v0", "v1", "v2")


Q = (5.3, 4.7, 80.0)
_QP = {a: f"({Q[i]}::DOUBLE - {a}0)" for i, a in enumerate("xyz")}


def _closest() -> str:
    q = {a: f"{Q[i]}::DOUBLE" for i, a in enumerate("xyz")}
    dot = lambda u, w: "(" + "+".join(f"({x})*({y})" for x, y in zip(u, w)) + ")"
    ab, ac = ([f"({a}{k}-{a}0)" for a in "xyz"] for k in (1, 2))
    ap, bp, cp = ([f"({q[a]}-{a}{k})" for a in "xyz"] for k in range(3))
    d = {1: dot(ab, ap), 2: dot(ac, ap), 3: dot(ab, bp), 4: dot(ac, bp), 5: dot(ab, cp), 6: dot(ac, cp)}
    head = ", ".join(f"{v} AS d{k}" for k, v in d.items())
    point = []
    for i, a in enumerate("xyz"):
        point.append(
            f"CASE WHEN d1<=0 AND d2<=0 THEN {a}0::DOUBLE WHEN d3>=0 AND d4<=d3 THEN {a}1::DOUBLE WHEN vc<=0 AND d1>=0 AND d3<=0 THEN {a}0+({a}1-{a}0)*(d1/(d1-d3))"
            f" WHEN d6>=0 AND d5<=d6 THEN {a}2::DOUBLE WHEN vb<=0 AND d2>=0 AND d6<=0 THEN {a}0+({a}2-{a}0)*(d2/(d2-d6))"
            f" WHEN va<=0 AND d4-d3>=0 AND d5-d6>=0 THEN {a}1+({a}2-{a}1)*((d4-d3)/((d4-d3)+(d5-d6)))"
            f" ELSE {a}0+({a}1-{a}0)*(vb/(va+vb+vc))+({a}2-{a}0)*(vc/(va+vb+vc)) END AS p{a}"
        )
    far = "+".join(f"(p{a}-{q[a]})*(p{a}-{q[a]})" for a in "xyz")
    return f"""WITH {fx.M}, h AS (SELECT *, {head} FROM fc), g AS (SELECT *, d1*d4-d3*d2 AS vc, d5*d2-d1*d6 AS vb, d3*d6-d5*d4 AS va FROM h),
    p AS (SELECT face_id, {', '.join(point)} FROM g) SELECT face_id, round(sqrt({far}), 6) AS distance, round(px, 6) AS px, round(py, 6) AS py, round(pz, 6) AS pz FROM p ORDER BY {far}, face_id LIMIT 1"""


@query(_closest())
def mesh_closest_point(spark, sf):
    return rounded(mesh.closest_point(*fx.mesh(spark, sf), Q), "distance", "px", "py", "pz")


@query(f"""WITH {fx.M}, d AS (SELECT face_id, v0, nx, ny, nz, x0, y0, z0, x1, y1, z1, x2, y2, z2, -(nx * 0 + ny * 0 + nz * -1.0::DOUBLE) AS det FROM fc),
e AS (SELECT face_id, ((x2-x0)*(9.4::DOUBLE-y0)-(y2-y0)*(7.3::DOUBLE-x0)) AS c2, ((x1-x0)*(9.4::DOUBLE-y0)-(y1-y0)*(7.3::DOUBLE-x0)) AS c1, nz, nx, ny, x0, y0, z0 FROM d WHERE nz <> 0),
h AS (SELECT face_id, -c2 / nz AS u, c1 / nz AS w, 500 - (z0 - (nx*(7.3::DOUBLE-x0)+ny*(9.4::DOUBLE-y0)) / nz) AS t FROM e)
SELECT face_id, round(t, 6) AS t, 7.3::DOUBLE AS px, 9.4::DOUBLE AS py, round(500 - t, 6) AS pz FROM h WHERE u >= 0 AND w >= 0 AND u + w <= 1 AND t > 1e-7 ORDER BY t, face_id LIMIT 1""")
def mesh_cast_ray(spark, sf):
    return rounded(mesh.cast_ray(*fx.mesh(spark, sf), (7.3, 9.4, 500.0), (0.0, 0.0, -2.0)), "t", "px", "py", "pz")


@query(f"""WITH {fx.M}, r AS (SELECT p_partkey AS ray_id, p_partkey // 45 + 0.3::DOUBLE AS ox, p_partkey % 45 + 0.4::DOUBLE AS oy FROM part WHERE p_partkey % 5 = 2),
c AS (SELECT ray_id, ox, oy, face_id, ((x2-x0)*(oy-y0)-(y2-y0)*(ox-x0)) AS c2, ((x1-x0)*(oy-y0)-(y1-y0)*(ox-x0)) AS c1, nx, ny, nz, x0, y0, z0
      FROM r JOIN fc ON nz <> 0 AND ox BETWEEN least(x0, x1, x2) AND greatest(x0, x1, x2) AND oy BETWEEN least(y0, y1, y2) AND greatest(y0, y1, y2)),
h AS (SELECT ray_id, face_id, ox, oy, -c2 / nz AS u, c1 / nz AS w, 500 - (z0 - (nx*(ox-x0)+ny*(oy-y0)) / nz) AS t FROM c),
b AS (SELECT ray_id, min(struct_pack(t := t, face_id := face_id)) AS b, any_value(ox) AS ox, any_value(oy) AS oy FROM h WHERE u >= 0 AND w >= 0 AND u + w <= 1 AND t > 1e-7 GROUP BY ray_id)
SELECT ray_id, b.face_id AS face_id, round(b.t, 6) AS t, round(ox, 6) AS px, round(oy, 6) AS py, round(500 - b.t, 6) AS pz FROM b""")
def mesh_cast_rays(spark, sf):
    """A ray downwards for every fifth part; some pass beside the mesh."""
    rays = fx.table(spark, sf, "part").where("p_partkey % 5 = 2").selectExpr(
        "p_partkey AS ray_id", "p_partkey div 45 + 0.3D AS ox", "p_partkey % 45 + 0.4D AS oy", "500D AS oz", "0D AS dx", "0D AS dy", "-2D AS dz"
    )
    return rounded(mesh_search.cast_rays(*fx.mesh(spark, sf), rays, 8.0), "t", "px", "py", "pz")
