"""Trees and paths solved in tasks against rounds over tables."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terravane.operators import paths, trees
from terravane.plans import whole

TREE = "object_id long, vertex_id long, parent long"


@pytest.fixture(scope="module")
def forest(spark):
    draw, rows, at = random.Random(6), [], 0
    for k in range(40):
        n = draw.choice([1, 2, 9, 60])
        name = [at + i for i in range(n)]
        draw.shuffle(name)
        rows += [(k if k else None, name[i], name[draw.randint(max(0, i - 3), i - 1)] if i else -1) for i in range(n)]
        at += n
    return spark.createDataFrame(rows, TREE).repartition(5).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("columns", [["object_id", "vertex_id", "parent"], ["vertex_id", "parent"]])
def test_trees_in_tasks(forest, columns):
    tree = forest.select(*columns)
    marked = tree.where("vertex_id % 7 = 3").select("vertex_id")
    assert rows(trees.nearest_marked(tree, marked)) == rows(trees._by_doubling(tree, marked))
    assert rows(trees.strahler(tree)) == rows(trees._strahler_by_anchors(tree))


def test_chains_below_in_tasks(forest):
    tree = forest.select("vertex_id", "parent")
    fixed = trees.anchors(tree)
    inner = tree.join(fixed, "vertex_id", "left_anti")
    assert rows(trees.nearest_below(tree, fixed, inner)) == rows(trees._below_by_doubling(tree, fixed, inner))


def test_large_and_small_groups(forest):
    """Each group goes one way, whole; null is a group."""
    small, large = whole.split(forest, most=9)
    n = {r.object_id: r["count"] for r in forest.groupBy("object_id").count().collect()}
    assert {r.object_id for r in large.collect()} == {k for k, c in n.items() if c > 9}
    assert small.count() + large.count() == forest.count()
    assert whole.split(forest.drop("object_id"), most=5)[0] is None and whole.split(forest)[1] is None


def test_groups_come_whole(forest):
    def sizes(table: pa.Table) -> pa.Table:
        return table.group_by("object_id").aggregate([("vertex_id", "count")]).rename_columns(["object_id", "n"]) if table.num_rows else pa.table({"object_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})

    for gathered in (1, 25, 10_000):
        got = whole.solve(forest, sizes, "object_id long, n long", gathered=gathered).groupBy("object_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
        assert all(r.parts == 1 for r in got.collect())
        assert {(r.object_id, r.n) for r in got.collect()} == {(r.object_id, r["count"]) for r in forest.groupBy("object_id").count().collect()}


def test_cycles_are_refused(spark):
    ring = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "vertex_id long, parent long")
    with pytest.raises(Exception, match="cycle"):
        trees.depths(ring).collect()


def test_caterpillar(spark):
    """A spine of 50,000 with a twig at every vertex."""
    n = 50_000
    t = spark.range(2 * n).selectExpr("id AS vertex_id", f"CASE WHEN id = 0 THEN -1 WHEN id < {n} THEN id - 1 ELSE id - {n} END AS parent")
    began = time.perf_counter()
    got = {r.strahler: r["count"] for r in trees.strahler(t).groupBy("strahler").count().collect()}
    # the last spine vertex has one child, its twig, so it is 1 like the twigs; those above it are 2
    assert got == {1: n + 1, 2: n - 1} and time.perf_counter() - began < 60


def test_paths_cut_by_batches(spark):
    draw = random.Random(8)
    made = [(k if k else None, i, float(i), draw.uniform(0, 3), 0.0) for k in range(30) for i in range(draw.choice([1, 2, 3, 40, 200]))]
    p = spark.createDataFrame(made, "object_id long, seq long, x double, y double, z double").repartition(3)
    want = rows(paths.simplify(p, 1.0, whole=1))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for n in ("7", "10000"):
            spark.conf.set(key, n)
            assert rows(paths.simplify(p.where("object_id IS NOT NULL"), 1.0)) == [r for r in want if r[0] is not None]
    finally:
        spark.conf.set(key, before)
