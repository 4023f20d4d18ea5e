"""Stored pyramids: settings, links over several levels, rebuilding, folders by bins."""

import pytest
from pyspark.sql import functions as F

from terravane.cli.__main__ import main
from terravane.operators import pyramid
from terravane.sources import store

TREE = "object_id long, vertex_id long, parent long, x double, y double, z double, radius double"
CHUNK = (10.0, 10.0, 10.0)


def chains(spark, sizes, shift=0.0):
    """An object for each size: a chain along x with a twig at its middle."""
    rows, at = [], 0
    for k, n in enumerate(sizes):
        rows += [(k, at + i, at + i - 1 if i else -1, float(i) + shift, 3.0 * k, 0.0, float(i % 5)) for i in range(n)]
        rows += [(k, at + n, at + n // 2, float(n // 2), 3.0 * k + 1, 0.0, 9.0)]
        at += n + 1
    return spark.createDataFrame(rows, TREE)


def same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_factor_is_the_stride(spark):
    """A skeleton's bin factor is its stride, its chunks grow by two, random is by length."""
    levels = pyramid.build_pyramid(chains(spark, [40, 90]), CHUNK, [(3, 1), (2.4, 2)], "skeleton", "random", chunk_shape=(1000.0,) * 3)
    assert [x.settings.get("stride") for x in levels[1:]] == [3, 2] and levels[2].settings["strategy"] == "length"
    assert [x.settings["chunk_shape"][0] for x in levels[1:]] == [2000.0, 4000.0]
    kept = {r.vertex_id for r in levels[1].vertices.where("object_id = 0").collect()}
    assert kept == {0, 20, 39, 40} | {v for v in range(0, 20, 3)} | {20 + v for v in range(0, 19, 3)}
    assert {r.object_id for r in levels[2].vertices.select("object_id").distinct().collect()} == {1}
    with pytest.raises(ValueError, match="chunk scale"):
        pyramid.build_pyramid(chains(spark, [3]), CHUNK, [(2, 1)], "skeleton", chunk_scales=[2, 2])


@pytest.mark.parametrize("strategy", ["coverage", "thinning", "length"])
def test_no_sparsity(spark, strategy):
    got = pyramid.skeleton(chains(spark, [8, 9]), CHUNK, 0.0, strategy)[0]
    assert got.select("object_id").distinct().count() == 2


def test_rebuilt_like_built(spark):
    levels = pyramid.build_skeleton_pyramid(chains(spark, [60, 30, 44]), CHUNK, [3, 4], [1.0, 2.0], attributes={"radius": "max"})
    again = pyramid.rebuild_from(levels, 0)
    for a, b in zip(levels[1:], again[1:], strict=True):
        same(a.vertices, b.vertices), same(a.parents, b.parents)
        assert a.settings == b.settings
    assert pyramid.rebuild_from(levels, 2) == levels


@pytest.mark.parametrize("storage", ["explicit", "implicit"])
def test_stored_links(spark, tmp_path, storage):
    where, base = str(tmp_path / "s"), chains(spark, [60, 30])
    store.write_tree(base, where, 0, CHUNK)
    levels = pyramid.build_skeleton_pyramid(base, CHUNK, [2, 2, 3])
    store.write_pyramid(levels, where, CHUNK, -1, storage)
    assert store.level_shape(spark, where, 3) == (80.0,) * 3 and store.level_settings(spark, where, 2)["stride"] == 2
    up = [{r.vertex_id: r.parent for r in x.parents.collect()} for x in levels[1:]]
    for level, delta in [(0, 1), (0, 3), (1, 2)]:
        want = set()
        for v in {r.vertex_id for r in levels[level].vertices.collect()}:
            at = v
            for k in range(delta):
                at = up[level + k].get(at, -1) if at >= 0 else -1
            want |= {(v, at)} if at >= 0 else set()
        got = {(r.v0, r.v1) for r in store.read_cross_links(spark, where, level, delta).collect()}
        assert got == want
        assert {(r.v1, r.v0) for r in store.read_cross_links(spark, where, level + delta, -delta).collect()} == want
    some = levels[3].vertices.where("object_id = 1")
    assert {r.v0 for r in store.read_cross_links(spark, where, 3, -3, some).collect()} == {r.vertex_id for r in some.collect()}
    parents = {(r.v0, r.v1) for r in store.read_links(spark, where, 1, "parents").collect()}
    assert parents == {(r.vertex_id, r.parent) for r in levels[1].vertices.collect() if r.parent >= 0}
    plan = store.read_cross_links(spark, where, 0, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "(delta#" in plan


def test_rebuilding_after_an_edit(spark, tmp_path):
    """A rebuilt store equals a fresh one of the edited level."""
    old, edited = chains(spark, [60, 30, 45]), chains(spark, [60, 33], shift=0.25)
    stores = [str(tmp_path / k) for k in "ab"]
    for where, base in zip(stores, (old, edited), strict=True):
        store.write_tree(base, where, 0, CHUNK)
        store.write_pyramid(pyramid.build_skeleton_pyramid(base, CHUNK, [3, 2], [1.0, 2.0], attributes={"radius": "sum"}), where, CHUNK, 2)
    store.write_tree(edited, stores[0], 0, CHUNK)
    assert store.rebuild(spark, stores[0]) == 2
    levels = [store.levels_of(spark, where) for where in stores]
    for a, b in zip(*levels, strict=True):
        same(a.vertices, b.vertices)
        assert a.settings == b.settings
    for k, d in [(0, 1), (0, 2), (2, -2), (1, 1)]:
        same(*(store.read_cross_links(spark, where, k, d) for where in stores))
    assert store.vacuum(spark, stores[0]) > 4 and store.vacuum(spark, stores[0]) == 0
    same(*(store.read_cross_links(spark, where, 1, -1) for where in stores))
    same(*(store.read_links(spark, where, 0, "parents") for where in stores))
    with pytest.raises(ValueError, match="no level 5"):
        store.rebuild(spark, stores[0], 5)


def test_folders_by_bins(spark, tmp_path):
    where = str(tmp_path / "s")
    points = spark.range(200).selectExpr("id AS vertex_id", "double(id) AS x", "double(id % 7) AS y", "0D AS z", "id % 3 AS tissue")
    edges = spark.range(199).selectExpr("id AS edge_id", "id AS v0", "id + 1 AS v1")
    store.write_graph(points, edges, where, 0, CHUNK)
    store.rechunk(spark, where, 0, by="x", edges=[50.0, 120.0])
    read = store.read_points(spark, where, 0).where("bin = 1")
    assert sorted(r.vertex_id for r in read.collect()) == list(range(50, 120))
    assert all("/bin=1/" in f for f in read.inputFiles() if "bin=1" in f) and "PartitionFilters: [isnotnull(bin" in read._jdf.queryExecution().executedPlan().toString()
    links = store.read_links(spark, where, 0)
    assert {(r.v0, r.bin) for r in links.collect()} == {(k, (k >= 50) + (k >= 120)) for k in range(199)}
    store.rechunk(spark, where, 0, (25.0, 25.0, 25.0), by="tissue")
    assert store.level_shape(spark, where, 0) == (25.0,) * 3 and store.validate(spark, where, 0, store.read_links(spark, where, 0)) == []
    assert store.read_points(spark, where, 0, low=(0, 0, 0), high=(30, 9, 9)).where("tissue = 2").count() == 10
    assert store.read_graph(spark, where, 0, low=(0, 0, 0), high=(30, 9, 9))[1].count() == 30


def test_command_line(spark, tmp_path, capsys):
    rows = "".join(f"{i} 3 {i} 0 0 1 {i - 1 if i > 1 else -1}\n" for i in range(1, 50))
    (tmp_path / "t.swc").write_text(rows)
    where = str(tmp_path / "s")
    main(["convert", str(tmp_path / "t.swc"), where, "--chunk-shape", "40,40,40", "--bin-shape", "40,40,40", "--bin-factors", "2,3", "--chunk-scales", "3,2", "--cross-depth", "2"])
    assert store.level_shape(spark, where, 1) == (120.0,) * 3 and store.level_shape(spark, where, 2) == (240.0,) * 3
    before = sorted(map(tuple, store.read_points(spark, where, 2).collect()))
    assert main(["rebuild", where]) == 0 and main(["vacuum", where]) == 0 and main(["validate", where, "--level", "2"]) == 0
    assert sorted(map(tuple, store.read_points(spark, where, 2).collect())) == before
    assert "2 levels made again" in capsys.readouterr().out
    assert store.read_cross_links(spark, where, 0, 2).count() == 49
