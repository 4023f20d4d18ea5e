"""Pruning against a plain walk, round by round."""

import math
import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from terravane.operators import pruning

POINT = "vertex_id long, x double, y double, z double, radius long"


def plain(points, pairs, min_length, min_vertices):
    """(vertices left, branches removed)."""
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b), near[b].add(a)
    left, removed = set(points), 0
    while True:
        walks = defaultdict(list)
        for leaf in sorted(v for v in near if len(near[v]) == 1):
            path, length = [leaf], 0.0
            came, at = None, leaf
            while True:
                (ahead,) = near[at] - {came}
                length += math.dist(points[at], points[ahead])
                came, at = at, ahead
                if len(near[at]) != 2:
                    break
                path.append(at)
            if (min_length and length < min_length) or (min_vertices and len(path) < min_vertices):
                walks[at].append((leaf, path))
        gone = []
        for stop, found in walks.items():
            if len(near[stop]) == 1:
                gone += [p for _, p in found]
            else:
                gone += [p for _, p in found[: len(near[stop]) - 2]]
        if not gone:
            return left, removed
        removed += len(gone)
        for v in {v for p in gone for v in p}:
            left.discard(v)
            for b in near.pop(v, ()):
                near[b].discard(v)


def made(spark, points, pairs):
    v = spark.createDataFrame([(k, *map(float, p), 7 * k) for k, p in points.items()], POINT)
    return v, spark.createDataFrame(pairs, "v0 long, v1 long")


def check(spark, points, pairs, min_length, min_vertices):
    got = pruning.prune(*made(spark, points, pairs), min_length, min_vertices)
    left, removed = plain(points, pairs, min_length, min_vertices)
    rows = sorted(got.vertices.collect(), key=lambda r: r.vertex_id)
    assert [r.vertex_id for r in rows] == sorted(left) and [r.new_id for r in rows] == list(range(len(left)))
    assert all(r.radius == 7 * r.vertex_id for r in rows)
    number = {r.vertex_id: r.new_id for r in rows}
    assert sorted((r.n0, r.n1) for r in got.edges.collect()) == sorted((number[a], number[b]) for a, b in pairs if a in left and b in left)
    assert got.removed == removed
    return left, removed


@pytest.mark.parametrize(("seed", "min_length", "min_vertices"), [(1, 0.0, 3), (2, 9.0, 0), (3, 5.0, 4)])
def test_random_trees(spark, seed, min_length, min_vertices):
    draw = random.Random(seed)
    points = {k: (draw.randint(0, 5), draw.randint(0, 5), 0) for k in range(150)}
    pairs = [(k, max(0, k - draw.choice([1, 1, 1, 2, 9]))) for k in range(1, 110)]  # a tree,
    pairs += [(k, k + 1) for k in range(112, 116)] + [(118, 119)]  # loose paths,
    pairs += [(k, k + 1) for k in range(120, 128)] + [(128, 120), (124, 129), (129, 130)]  # a cycle with a twig, and single vertices
    pairs += [(5, 4), (7, 7)]  # a repeat the other way round, and a loop
    left, removed = check(spark, points, pairs, min_length, min_vertices)
    assert removed > 5 and {120, 140} <= left and not {118, 119} & left


def test_star_keeps_two(spark):
    points = {k: (k, 0, 0) for k in range(6)}
    left, removed = check(spark, points, [(0, k) for k in range(1, 6)], 0.0, 2)
    assert removed == 3 and left == {0, 4, 5}


def test_nothing_to_prune(spark):
    points = {k: (k, 0, 0) for k in range(4)}
    assert check(spark, points, [(0, 1), (1, 2), (2, 3)], 0.0, 2)[1] == 0
    assert check(spark, points, [(0, 1), (1, 2), (2, 3)], 0.0, 0)[1] == 0
    v, e = made(spark, points, [(0, 1)])
    got = pruning.prune(v, e.where("false"), 5.0, 5)
    assert got.vertices.count() == 4 and got.edges.count() == 0


def test_long_branch(spark):
    """A bound of 1,000 vertices over a branch of 10^5: rounds do not follow the length."""
    n = 100_000
    v = spark.range(n).select(F.col("id").alias("vertex_id"))
    e = spark.range(n - 1).where("id <> 50000").selectExpr("id AS v0", "id + 1 AS v1").union(spark.createDataFrame([(20_000, 50_001), (50_002, 500)], "v0 long, v1 long"))
    began = time.perf_counter()
    got = pruning.prune(v, e, min_vertices=1000)
    assert got.vertices.count() == got.edges.count() == n - 500 and got.removed == 1
    assert time.perf_counter() - began < 120
