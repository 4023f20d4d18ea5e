"""Quadric collapse keeps flat shapes and borders."""

import numpy as np

from terravane.operators.quadric import collapse, simplify


def grid(n):
    v = np.array([(i, j, 0.0) for i in range(n) for j in range(n)], float)
    at = lambda i, j: i * n + j
    f = [t for i in range(n - 1) for j in range(n - 1) for t in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)))]
    return v, np.array(f)


def area(v, f):
    return np.linalg.norm(np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]]), axis=1).sum() / 2


def test_flat_grid_keeps_its_area():
    v, f = grid(8)
    w, g = collapse(v, f, 20)
    assert len(g) <= 20 and abs(area(w, g) - 49) < 1e-6 and np.abs(w[:, 2]).max() < 1e-9


def test_by_object(spark):
    v, f = grid(6)
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame([(k, i, *map(int, t)) for k in (1, 2) for i, t in enumerate(f)], "object_id long, face_id long, v0 long, v1 long, v2 long")
    got = simplify(vertices, faces, 0.5).collect()
    assert {r.object_id for r in got} == {1, 2}
    assert sum(r.object_id == 1 for r in got) <= 3 * 25 and len(got) % 3 == 0
