"""Tables of rays and points on a mesh against one query at a time."""

import random

import pytest

from terravane.operators import mesh, mesh_search


@pytest.fixture(scope="module")
def surface(spark):
    """A bumpy sheet of small faces, and a few very large ones."""
    draw = random.Random(2)
    n = 8
    v = [(i * n + j, float(i), float(j), draw.uniform(-1, 1)) for i in range(n) for j in range(n)]
    f = []
    for i in range(n - 1):
        for j in range(n - 1):
            a = i * n + j
            f += [(a, a + 1, a + n), (a + 1, a + n + 1, a + n)]
    v += [(1000, -40.0, -40.0, -9.0), (1001, 60.0, -40.0, -9.0), (1002, 0.0, 70.0, -8.0), (1003, 3.0, 3.0, 30.0), (1004, 3.5, 3.0, 30.0), (1005, 3.0, 3.5, 30.0)]
    f += [(1000, 1001, 1002), (1003, 1004, 1005)]
    vertices = spark.createDataFrame(v, "vertex_id long, x double, y double, z double").cache()
    return vertices, spark.createDataFrame([(k, *c) for k, c in enumerate(f)], "face_id long, v0 long, v1 long, v2 long").cache()


def near(a, b):
    assert a.face_id == b.face_id
    for c in ("px", "py", "pz"):
        assert a[c] == pytest.approx(b[c], abs=1e-9)


def test_rays(spark, surface):
    draw = random.Random(3)
    rays = [tuple(draw.uniform(-3, 10) for _ in range(3)) + tuple(draw.uniform(-1, 1) for _ in range(3)) for _ in range(12)]
    rays += [(3.0, 3.0, 50.0, 0.0, 0.0, -2.0), (2.0, -5.0, 0.0, 0.0, 1.0, 0.0), (0.5, 0.5, 5.0, 0.0, 0.0, 1.0), (20.0, 20.0, 3.0, 0.0, 0.0, -1.0)]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rays)] + [(99, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    got = {r.ray_id: r for r in mesh_search.cast_rays(*surface, table, 1.0).collect()}
    hits = 0
    for k, r in enumerate(rays):
        want = mesh.cast_ray(*surface, r[:3], r[3:]).first()
        assert (k in got) == (want is not None)
        if want is not None:
            near(got[k], want)
            assert got[k].t == pytest.approx(want.t, abs=1e-9)
            hits += 1
    assert 99 not in got and hits > 4
    some = mesh_search.cast_rays(*surface, table, 2.5, max_distance=15.0).collect()
    assert {r.ray_id for r in some} == {k for k, r in got.items() if r.t <= 15.0}
    assert mesh_search.cast_rays(surface[0], surface[1].where("false"), table, 1.0).count() == 0


def test_points(spark, surface):
    draw = random.Random(4)
    points = [tuple(draw.uniform(-3, 10) for _ in range(3)) for _ in range(10)] + [(3.0, 3.0, 29.0), (300.0, -200.0, 50.0), (0.0, 0.0, 0.0)]
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(99, None, 0.0, 0.0), (98, float("nan"), 0.0, 0.0)], "point_id long, x double, y double, z double")
    got = {r.point_id: r for r in mesh_search.closest_points(*surface, table, 0.7).collect()}
    assert set(got) == set(range(len(points)))
    for k, p in enumerate(points):
        want = mesh.closest_point(*surface, p).first()
        assert got[k].distance == pytest.approx(want.distance, abs=1e-9)
        near(got[k], want)
    close = mesh_search.closest_points(*surface, table, 0.7, max_distance=2.0).collect()
    assert {r.point_id for r in close} == {k for k, r in got.items() if r.distance <= 2.0}
    assert mesh_search.closest_points(surface[0], surface[1].where("false"), table, 1.0).count() == 0
