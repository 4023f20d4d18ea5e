"""Triangle meshes: vertices (vertex_id, x, y, z), faces (face_id, v0, v1, v2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.vec3 import Vec, const, cross, dot, norm, sub, vec
from terravane.plans.rows import side_by_side

EPS = 1e-7


def with_corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with their corners' coordinates x0..z2."""
    out = faces
    for k in range(3):
        at = vertices.select(F.col("vertex_id").alias(f"v{k}"), *[F.col(a).cast("double").alias(f"{a}{k}") for a in "xyz"])
        out = out.join(at, f"v{k}")
    return out


def corner(k: int) -> Vec:
    return vec(suffix=str(k))


def face_cross() -> Vec:
    """Cross product of two sides: twice the area, along the normal."""
    return cross(sub(corner(1), corner(0)), sub(corner(2), corner(0)))


def intra(vertices: DataFrame, faces: DataFrame, shape: tuple) -> DataFrame:
    """Faces with ``is_cross``: whether their corners lie in more than one chunk."""
    from terravane.functions.vec3 import cell

    placed = with_corners(vertices, faces)
    keys = [F.struct(*[cell(f"{a}{k}", s).alias(a) for a, s in zip("xyz", shape, strict=True)]) for k in range(3)]
    return placed.withColumn("is_cross", F.size(F.array_distinct(F.array(*keys))) > 1)


def edges(faces: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct undirected edges u < v of the faces."""
    pairs = F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    return faces.select(*keep, F.explode(pairs).alias("e")).select(*keep, "e.u", "e.v").distinct()


def summary(vertices: DataFrame, faces: DataFrame, by: str | None = None, shape: tuple | None = None) -> DataFrame:
    """Faces, area, volume (signed tetrahedra to the origin), vertices, edges, Euler
    characteristic; in total or for each object ``by``.

    With a chunk ``shape`` faces whose corners lie in several chunks are left out of
    faces, area and volume; their open chains v0-v1-v2 still count as edges, and
    ``excluded`` is the number of those chain links before equal ones collapse.
    """
    keys = [by] if by else []
    own = faces.select(*keys, "face_id", "v0", "v1", "v2")
    solid = with_corners(vertices, own) if shape is None else intra(vertices, own, shape)
    whole = F.lit(True) if shape is None else ~F.col("is_cross")
    signed = dot(corner(0), cross(corner(1), corner(2))) / 6.0
    sums = solid.groupBy(*keys).agg(
        F.sum(whole.cast("long")).alias("n_faces"),
        F.sum(F.when(whole, norm(face_cross()) / 2.0).otherwise(0.0)).alias("area"),
        F.sum(F.when(whole, signed).otherwise(0.0)).alias("volume"),
        F.sum(F.when(whole, 0).otherwise(2)).cast("long").alias("excluded"),
    )
    links = edges(solid.where(whole), tuple(keys))
    if shape is not None:
        chain = F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in (("v0", "v1"), ("v1", "v2"))])
        links = links.union(solid.where(~whole).select(*keys, F.explode(chain).alias("e")).select(*keys, "e.u", "e.v")).distinct()
    n_edges = links.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))
    if by:
        used = own.select(by, F.explode(F.array("v0", "v1", "v2")).alias("v")).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("n_vertices"))
        out = sums.join(n_edges, by).join(used, by)
    else:
        out = side_by_side(sums, n_edges, vertices.agg(F.count(F.lit(1)).alias("n_vertices")))
    return out.withColumn("euler", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"))


def boundary_vertices(faces: DataFrame) -> DataFrame:
    """vertex_id of the ends of edges that belong to one face only."""
    pairs = F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    once = faces.select(F.explode(pairs).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return once.select(F.explode(F.array("e.u", "e.v")).alias("vertex_id")).distinct()


def vertex_normals(vertices: DataFrame, faces: DataFrame, weighting: str = "area") -> DataFrame:
    """vertex_id, nx, ny, nz: normalised sums of the normals of a vertex's faces, weighted
    by area or uniformly; vertices without a face have 0."""
    n = face_cross()
    size = norm(n)
    parts = n if weighting == "area" else tuple(F.when(size > 0, c / size).otherwise(0.0) for c in n)
    each = with_corners(vertices, faces).select(F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"), *[p.alias(f"n{a}") for p, a in zip(parts, "xyz", strict=True)])
    total = each.groupBy("vertex_id").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in "xyz"])
    length = norm(vec("n"))
    out = vertices.select("vertex_id").join(total, "vertex_id", "left")
    return out.select("vertex_id", *[F.coalesce(F.when(length > 0, F.col(f"n{a}") / length), F.lit(0.0)).alias(f"n{a}") for a in "xyz"])


def mean_curvature(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vertex_id, curvature: half the norm of the cotangent Laplacian over twice the
    barycentric area (a third of the adjacent faces)."""
    # each level of terms is a column of its own, or every later term would repeat it
    solid = with_corners(vertices, faces)
    sides = {f"{x}{i}{j}": F.col(f"{x}{j}") - F.col(f"{x}{i}") for i, j in ((0, 1), (1, 2), (2, 0)) for x in "xyz"}
    solid = solid.select("v0", "v1", "v2", *[c.alias(n) for n, c in sides.items()])
    side = {k: vec(suffix=f"{i}{j}") for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))}  # opposite to corner k
    solid = solid.withColumn("twice", norm(cross(side[2], side[0])))
    sine = F.when(F.col("twice") == 0, 1.0).otherwise(F.col("twice"))
    solid = solid.withColumns({f"cot{k}": -dot(side[(k + 1) % 3], side[(k + 2) % 3]) / sine for k in range(3)})  # weighs the side opposite
    solid = solid.withColumns({f"h{x}{k}": side[k][n] * F.col(f"cot{k}") for k in range(3) for n, x in enumerate("xyz")})
    rows = []
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):  # side i-j leaves corner i, side k-i enters it
        rows.append(F.struct(F.col(f"v{i}").alias("vertex_id"), *[(F.col(f"h{x}{k}") - F.col(f"h{x}{j}")).alias(f"h{x}") for x in "xyz"], (F.col("twice") / 6.0).alias("area")))
    each = solid.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    total = each.groupBy("vertex_id").agg(*[F.sum(c).alias(c) for c in ("hx", "hy", "hz", "area")])
    value = F.when(F.col("area") > 0, norm(vec("h")) / (2.0 * F.col("area")) / 2.0).otherwise(0.0)
    return vertices.select("vertex_id").join(total.select("vertex_id", value.alias("curvature")), "vertex_id", "left").select("vertex_id", F.coalesce("curvature", F.lit(0.0)).alias("curvature"))


def nearest_on_triangle(solid: DataFrame, p: Vec) -> DataFrame:
    """``solid`` with px, py, pz, the point of each face nearest to p, by Voronoi regions
    in the order corner 0, 1, edge 01, corner 2, edge 02, edge 12, inside."""
    a, b, c = corner(0), corner(1), corner(2)
    ab, ac = sub(b, a), sub(c, a)
    products = {f"d{2 * k + 1 + j}": dot(side, sub(p, corner(k))) for k in range(3) for j, side in enumerate((ab, ac))}
    d1, d2, d3, d4, d5, d6, va, vb, vc = (F.col(n) for n in ("d1", "d2", "d3", "d4", "d5", "d6", "va", "vb", "vc"))
    areas = {"vc": d1 * d4 - d3 * d2, "vb": d5 * d2 - d1 * d6, "va": d3 * d6 - d5 * d4}

    def ratio(top: Column, bottom: Column) -> Column:
        return top / F.when(bottom == 0, 1.0).otherwise(bottom)

    # the point as corner 0 plus s times side 01 plus t times side 02
    zero, one = F.lit(0.0), F.lit(1.0)
    far = ratio(d4 - d3, (d4 - d3) + (d5 - d6))
    total = va + vb + vc
    regions = [
        ((d1 <= 0) & (d2 <= 0), zero, zero),
        ((d3 >= 0) & (d4 <= d3), one, zero),
        ((vc <= 0) & (d1 >= 0) & (d3 <= 0), ratio(d1, d1 - d3), zero),
        ((d6 >= 0) & (d5 <= d6), zero, one),
        ((vb <= 0) & (d2 >= 0) & (d6 <= 0), zero, ratio(d2, d2 - d6)),
        ((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), one - far, far),
    ]
    s, t = ratio(vb, total), ratio(vc, total)
    for test, u, w in reversed(regions):
        s, t = F.when(test, u).otherwise(s), F.when(test, w).otherwise(t)
    placed = solid.withColumns(products).withColumns(areas).withColumns({"s": s, "t": t})
    return placed.withColumns({f"p{x}": a[i] + F.col("s") * ab[i] + F.col("t") * ac[i] for i, x in enumerate("xyz")})


def closest_point(vertices: DataFrame, faces: DataFrame, query: tuple, max_distance: float | None = None) -> DataFrame:
    """At most one row: face_id, distance, px, py, pz of the nearest point of the mesh
    (the least face_id among equals)."""
    q = const(*query)
    solid = with_corners(vertices, faces)
    if max_distance is not None:  # faces whose box is too far cannot hold it
        for i, a in enumerate("xyz"):
            solid = solid.where((F.least(*[f"{a}{k}" for k in range(3)]) <= query[i] + max_distance) & (F.greatest(*[f"{a}{k}" for k in range(3)]) >= query[i] - max_distance))
    near = nearest_on_triangle(solid, q).withColumn("far", dot(sub(vec("p"), q), sub(vec("p"), q)))
    best = near.agg(F.min(F.struct("far", "face_id", "px", "py", "pz")).alias("b")).where("b IS NOT NULL")
    out = best.select("b.face_id", F.sqrt("b.far").alias("distance"), "b.px", "b.py", "b.pz")
    return out if max_distance is None else out.where(F.col("distance") <= max_distance)


def cast_ray(vertices: DataFrame, faces: DataFrame, origin: tuple, direction: tuple, max_distance: float | None = None) -> DataFrame:
    """At most one row: face_id, t, px, py, pz of the first face that the ray hits."""
    size = sum(d * d for d in direction) ** 0.5
    if size == 0:
        raise ValueError("the direction is zero")
    unit = tuple(d / size for d in direction)
    o, d = const(*origin), const(*unit)
    e1, e2 = sub(corner(1), corner(0)), sub(corner(2), corner(0))
    h = cross(d, e2)
    det = dot(e1, h)
    f = 1.0 / F.when(F.abs(det) < EPS, None).otherwise(det)
    s = sub(o, corner(0))
    u = f * dot(s, h)
    q = cross(s, e1)
    v, t = f * dot(d, q), f * dot(e2, q)
    hit = with_corners(vertices, faces).select("face_id", u.alias("u"), v.alias("v"), t.alias("t")).where("u >= 0 AND v >= 0 AND u <= 1 AND u + v <= 1").where(F.col("t") > EPS)
    if max_distance is not None:
        hit = hit.where(F.col("t") <= max_distance)
    best = hit.agg(F.min(F.struct("t", "face_id")).alias("b")).where("b IS NOT NULL")
    return best.select("b.face_id", "b.t", *[(F.lit(float(origin[i])) + F.col("b.t") * unit[i]).alias(f"p{a}") for i, a in enumerate("xyz")])
