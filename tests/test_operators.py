"""Known answers for operators over small hand-made geometry."""

import math

import pytest

from terravane.operators import binning, filters, graph, mesh, neighbours, paths, pyramid, selection, trees
from terravane.plans import components


def edges(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id long, v0 long, v1 long")


def clique(nodes):
    nodes = list(nodes)
    return [(a, b) for i, a in enumerate(nodes) for b in nodes[:i]]


def path(spark, *objects):
    rows = [(k, i, i, *map(float, p)) for k, pts in enumerate(objects) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "object_id long, seq long, vertex_id long, x double, y double, z double")


def tree(spark, parents):
    return spark.createDataFrame(list(enumerate(parents)), "vertex_id long, parent long")


def values(df, *columns):
    return {r[columns[0]]: r[columns[1]] if len(columns) == 2 else tuple(r[c] for c in columns[1:]) for r in df.collect()}


@pytest.mark.parametrize(
    "pairs, core",
    [([(0, 1), (1, 2)], [1, 1, 1]), (clique(range(3)), [2] * 3), (clique(range(3)) + [(2, 3), (3, 4)], [2, 2, 2, 1, 1]), (clique(range(4)) + clique(range(4, 8)) + [(3, 4)], [3] * 8)],
)
def test_k_core(spark, pairs, core):
    assert values(graph.k_core(edges(spark, pairs)), "vertex_id", "core") == dict(enumerate(core))


def test_louvain_finds_cliques(spark):
    e = edges(spark, clique(range(5)) + clique(range(5, 10)) + [(0, 5)])
    labels = graph.louvain(e)
    by = values(labels, "vertex_id", "label")
    assert len(set(by.values())) == 2 and len({by[i] for i in range(5)}) == 1
    assert graph.modularity(e, labels).first().q > 0.4


def test_label_propagation(spark):
    by = values(graph.label_propagation(edges(spark, clique(range(3)) + clique(range(3, 6)))), "vertex_id", "label")
    assert len({by[i] for i in range(3)}) == len({by[i] for i in range(3, 6)}) == 1 and by[0] != by[3]


def test_search(spark):
    e = edges(spark, [(i, i + 1) for i in range(4)] + [(10, 11)])
    assert values(graph.bfs(e, 0), "vertex_id", "distance", "predecessor") == {i: (i, i - 1) for i in range(5)}
    assert set(values(graph.bfs(e, 0, 2), "vertex_id", "distance")) == {0, 1, 2}
    assert [r.vertex_id for r in graph.shortest_path(e, 0, 4).orderBy("step").collect()] == [0, 1, 2, 3, 4]
    assert graph.shortest_path(e, 0, 11).count() == 0
    for search in (graph.bfs, graph.shortest_distances):
        with pytest.raises(ValueError, match="no edge has vertex 99"):
            search(e, 99)
    grid = edges(spark, [(4 * i + j, 4 * i + j + 1) for i in range(4) for j in range(3)] + [(4 * i + j, 4 * i + j + 4) for i in range(3) for j in range(4)])
    assert values(graph.shortest_distances(grid, 0), "vertex_id", "cost")[15] == 6


def test_components(spark):
    e = edges(spark, [(5, 3), (3, 9), (7, 8), (4, 4)] + [(100 + i, 101 + i) for i in range(60)])
    by = values(components.connected_components(e, "v0", "v1"), "node", "component")
    assert by[9] == 3 and by[5] == 3 and by[8] == 7 and 4 not in by and {by[i] for i in range(100, 161)} == {100}
    assert components.connected_components(edges(spark, []), "v0", "v1").count() == 0


def test_tree_measures(spark):
    t = tree(spark, [-1, 0, 1, 1, 2, 3, 5])
    assert list(dict(sorted(values(trees.depths(t), "vertex_id", "depth").items())).values()) == [0, 1, 2, 2, 3, 3, 4]
    assert list(dict(sorted(values(trees.strahler(t), "vertex_id", "strahler").items())).values()) == [2, 2, 1, 1, 1, 1, 1]
    assert list(dict(sorted(values(trees.kinds(t), "vertex_id", "kind").items())).values()) == [0, 1, 2, 2, 3, 2, 3]


def test_tree_thinning(spark):
    chain = tree(spark, [i - 1 for i in range(33)])
    assert sorted(r.vertex_id for r in trees.decimated(chain, 8).collect()) == [0, 8, 16, 24, 32]
    assert sorted(r.vertex_id for r in trees.decimated(chain, 1).collect()) == [0, 32]
    straight = spark.createDataFrame([(i, 10.0 * i, 0.0, 0.0) for i in range(33)], "vertex_id long, x double, y double, z double")
    assert sorted(r.vertex_id for r in trees.simplify(chain, straight, 0.5).collect()) == [0, 32]
    kept = spark.createDataFrame([(0,), (32,), (10,)], "vertex_id long")
    radius = spark.createDataFrame([(i, float(-i)) for i in range(33)], "vertex_id long, r double")
    got = values(trees.collapse(chain, kept, {"r": "max"}, radius), "vertex_id", "parent", "r")
    assert got == {0: (-1, 0.0), 10: (0, -10.0), 32: (10, -32.0)}


def cube(spark):
    v = [(i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    f = [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]
    return (
        spark.createDataFrame(v, "vertex_id long, x double, y double, z double"),
        spark.createDataFrame([(i, *t, 0) for i, t in enumerate(f)], "face_id long, v0 long, v1 long, v2 long, object_id long"),
    )


def test_mesh(spark):
    v, f = cube(spark)
    s = mesh.summary(v, f).first()
    assert s.area == pytest.approx(6) and abs(s.volume) == pytest.approx(1) and s.n_edges == 18 and s.euler == 2
    cut = mesh.summary(v, f, shape=(0.5, 0.5, 0.5)).first()
    assert cut.n_faces == 0 and cut.area == 0 and cut.excluded > 0
    for r in mesh.vertex_normals(v, f).collect():
        out = [2 * (r.vertex_id >> k & 1) - 1 for k in range(3)]
        assert math.isclose(r.nx**2 + r.ny**2 + r.nz**2, 1) and abs(r.nx * out[0] + r.ny * out[1] + r.nz * out[2]) / math.sqrt(3) > 0.9
    near = mesh.closest_point(v, f, (5, 0.5, 0.5)).first()
    assert near.distance == pytest.approx(4) and near.px == pytest.approx(1)
    assert mesh.closest_point(v, f, (5, 0.5, 0.5), 1.0).count() == 0
    hit = mesh.cast_ray(v, f, (5, 0.4, 0.5), (-1, 0, 0)).first()
    assert hit.t == pytest.approx(4) and hit.px == pytest.approx(1)
    assert mesh.cast_ray(v, f, (5, 0.4, 0.5), (1, 0, 0)).count() == 0
    with pytest.raises(ValueError):
        mesh.cast_ray(v, f, (0, 0, 0), (0, 0, 0))
    assert binning.coarsen_mesh_to(v, f, 3)[1].count() <= 12


def test_sphere_curvature(spark):
    lat, lon, r = 16, 24, 5.0
    v = [(0, 0.0, 0.0, r)] + [(1 + (i - 1) * lon + j, r * math.sin(math.pi * i / lat) * math.cos(2 * math.pi * j / lon), r * math.sin(math.pi * i / lat) * math.sin(2 * math.pi * j / lon), r * math.cos(math.pi * i / lat)) for i in range(1, lat) for j in range(lon)]
    v.append((len(v), 0.0, 0.0, -r))
    at = lambda i, j: 1 + (i - 1) * lon + j % lon
    f = [(0, at(1, j), at(1, j + 1)) for j in range(lon)] + [(len(v) - 1, at(lat - 1, j + 1), at(lat - 1, j)) for j in range(lon)]
    f += [t for i in range(1, lat - 1) for j in range(lon) for t in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1)))]
    got = mesh.mean_curvature(spark.createDataFrame(v, "vertex_id long, x double, y double, z double"), spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "face_id long, v0 long, v1 long, v2 long"))
    middle = sorted(r.curvature for r in got.collect())[len(v) // 2]
    assert 0.5 / r <= middle <= 2 / r


def test_paths(spark):
    p = path(spark, [(i, 0, 0) for i in range(30)], [(0, 0, 0), (3, 4, 0)], [(7, 7, 7)])
    assert sorted(r.seq for r in paths.decimate(p, 8).where("object_id = 0").collect()) == [0, 8, 16, 24, 29]
    assert values(paths.lengths(p), "object_id", "length") == {0: 29.0, 1: 5.0, 2: 0.0}
    assert sorted(r.seq for r in paths.simplify(p, 0.5).where("object_id = 0").collect()) == [0, 29]
    runs = paths.runs(path(spark, [(0, 0, 0), (1, 0, 0), (11, 0, 0), (2, 0, 0), (-0.5, 0, 0)]), (10, 10, 10)).orderBy("seq").collect()
    assert [r.run for r in runs] == [0, 0, 1, 2, 3] and runs[-1].cx == -1
    assert paths.cross_links(p, (10.0, 10.0, 10.0)).count() == 2


def test_selection(spark):
    objects = spark.createDataFrame([(i, float(i % 7)) for i in range(20)], "object_id long, length double")
    assert selection.kept_count(1000, 0.0001) == 1 and selection.kept_count(5, 0.5) == 2 and selection.kept_count(7, 0.5) == 4
    assert selection.apply_sparsity(objects, 0.25).count() == 5
    assert {r.object_id for r in selection.apply_sparsity(objects, 0.1, "length", "length").collect()} == {6, 13}
    with pytest.raises(ValueError):
        selection.apply_sparsity(objects, 0.1, "length")
    with pytest.raises(ValueError):
        selection.apply_sparsity(objects, 0.1, "nothing")


def test_filters(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0), (1, float("nan"), 0.0), (2, None, 0.0), (3, 1.0, 1.0)], "i long, x double, y double")
    assert [r.i for r in filters.drop_na(rows, ["x", "y"]).orderBy("i").collect()] == [0, 3]
    assert sorted(r.i for r in filters.drop_duplicates(filters.drop_na(rows, ["x"]), ["x", "y"], "i").collect()) == [0]
    one = spark.createDataFrame([(x, y, z) for x in range(3) for y in range(3) for z in range(3)], "cx long, cy long, cz long")
    assert filters.neighbour_chunks(one).where("cx = 1 AND cy = 1 AND cz = 1").count() == 26


def test_knn(spark):
    pts = spark.createDataFrame([(i, float(i * i), 0.0, 0.0) for i in range(12)], "vertex_id long, x double, y double, z double")
    want = {i: sum(sorted(abs(i * i - j * j) for j in range(12) if j != i)[:2]) / 2 for i in range(12)}
    assert values(neighbours.knn_distance(pts, 2, 1.0), "vertex_id", "distance") == want


def test_pyramid_keeps_ids(spark):
    p = path(spark, *[[(k + i, k * 3 % 17, i % 5) for i in range(30)] for k in range(30)])
    p = p.withColumn("vertex_id", p.object_id * 100 + p.seq)
    levels = pyramid.build_pyramid(p, (5.0, 5.0, 5.0), [(1, 2), (2, 2)])
    ids = [{r.object_id for r in x.vertices.select("object_id").distinct().collect()} for x in levels]
    assert [len(s) for s in ids] == [30, 15, 8] and ids[2] <= ids[1] <= ids[0]
    assert all(r.n == 1 for r in levels[1].vertices.groupBy("object_id", "seq").agg({"vertex_id": "count"}).withColumnRenamed("count(vertex_id)", "n").collect())
    again = pyramid.rebuild_from(levels, 0)
    assert again[2].vertices.exceptAll(levels[2].vertices).count() == 0
    with pytest.raises(pyramid.CoarseningError):
        pyramid.get_coarsener("unheard of")
    poly = pyramid.coarsen_level(pyramid.Level(0, p), (5.0, 5.0, 5.0), 2.0, "polyline", "length")
    assert poly.vertices.select("object_id").distinct().count() == 15 and poly.parents.where("parent IS NULL").count() == 0


def test_paths_over_zero_weights(spark):
    rows = [(0, 1, 2, 0.0), (1, 2, 3, 1.0), (2, 3, 4, 0.0), (3, 4, 1, 0.0), (4, 4, 5, 0.0), (5, 7, 8, 1.0)]
    e = spark.createDataFrame(rows, "edge_id long, v0 long, v1 long, w double")
    way = lambda a, b, **o: [(r.vertex_id, r.cost) for r in graph.shortest_path(e, a, b, "w", **o).orderBy("step").collect()]
    assert way(2, 3) == [(2, 0.0), (1, 0.0), (4, 0.0), (3, 0.0)] and way(1, 5) == [(1, 0.0), (4, 0.0), (5, 0.0)]
    assert way(1, 8) == [] and way(1, 1) == [(1, 0.0)]
    chain = edges(spark, [(i, i + 1) for i in range(40)])
    left = spark.createDataFrame([(i, float(abs(20 - i))) for i in range(41)], "vertex_id long, h double")
    assert [r.vertex_id for r in graph.shortest_path(chain, 3, 20, heuristic=left).orderBy("step").collect()] == list(range(3, 21))


def test_knn_of_few_and_odd_points(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 3.0, 0.0, 0.0), (2, 0.0, 4.0, 0.0), (3, float("nan"), 0.0, 0.0)], "vertex_id long, x double, y double, z double")
    got = values(neighbours.knn_distance(points, 3, 0.1), "vertex_id", "distance")
    assert got == {0: 3.5, 1: 4.0, 2: 4.5, 3: None}
    assert values(neighbours.knn_distance(points.limit(1), 3, 1.0), "vertex_id", "distance") == {0: 0.0}
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "vec_id long, embedding array<double>")
    for block in (5, 10, 3):
        assert values(neighbours.knn_vectors(rows, rows, 1, block=block), "vec_id", "distance") == dict.fromkeys(range(10), 1.0)
    assert neighbours.knn_vectors(rows, rows.limit(0), 1).count() == 0


def test_first_rows_either_way(spark):
    rows = spark.range(500).selectExpr("id AS object_id", "(id * 37) % 101 AS n")
    for k in (0, 7, 300):
        small, large = (selection.top(rows, "n", k, heap=h).collect() for h in (10_000, 0))
        assert sorted(small) == sorted(large) and len(small) == k
        assert sorted(selection.sample(rows, k, 3, heap=0).collect()) == sorted(selection.sample(rows, k, 3).collect())


def test_long_chains_and_paths(spark):
    """A chain of many vertices is one step, and a long path a few rounds."""
    chain = spark.range(20_000).selectExpr("id AS vertex_id", "id - 1 AS parent")
    got = trees.strahler(chain)
    assert got.count() == 20_000 and {r.strahler for r in got.select("strahler").distinct().collect()} == {1}
    wave = spark.range(20_000).selectExpr("0L AS object_id", "id AS seq", "id AS vertex_id", "double(id) AS x", "double(abs(id % 200 - 100)) AS y", "0D AS z")
    kept = sorted(r.seq for r in paths.simplify(wave, 1.0, whole=50_000).collect())
    assert kept == sorted({*range(0, 20_000, 100), 19_999})


def test_simplified_by_rounds_or_whole(spark):
    p = spark.range(600).selectExpr("id % 3 AS object_id", "id div 3 AS seq", "id AS vertex_id", "double(id div 3) AS x", "sin(id / 7) * (id % 11) AS y", "cos(id / 5) AS z")
    kept = [sorted(r.vertex_id for r in paths.simplify(p, 0.8, whole=w).collect()) for w in (10_000, 40, 10)]
    assert kept[0] == kept[1] == kept[2] and 6 < len(kept[0]) < 600


def test_skeleton_levels(spark):
    # two trees: a long path with one branch, and a short one; chunks of 100 along x
    parents = [-1, *range(40), 20, 41, 42, -1, 44]
    at = [*range(41), 20, 20, 20, 0, 1]
    rows = [(int(i > 43), i, i, p, float(x), 0.0, 0.0, i) for i, (p, x) in enumerate(zip(parents, at))]
    level = spark.createDataFrame(rows, "object_id long, seq long, vertex_id long, parent long, x double, y double, z double, r long")
    made, links = pyramid.skeleton(level, (100.0, 100.0, 100.0), stride=8, attributes={"r": "max"})
    assert values(made, "vertex_id", "parent") == {0: -1, 8: 0, 16: 8, 20: 16, 28: 20, 36: 28, 40: 36, 43: 20, 44: -1, 45: 44}
    assert values(made, "vertex_id", "r")[0] == 7 and values(links, "vertex_id", "parent")[23] == 20
    half, links = pyramid.skeleton(level, (100.0, 100.0, 100.0), 2.0, stride=8)
    assert {r.object_id for r in half.collect()} == {0} and values(links, "vertex_id", "parent")[45] == -1
    # both ends of an edge between chunks stay
    cut = values(pyramid.skeleton(level, (10.0, 10.0, 10.0), stride=100)[0], "vertex_id", "parent")
    assert {9, 10, 19, 20, 29, 30} <= set(cut)
    levels = pyramid.build_skeleton_pyramid(level, (50.0, 50.0, 50.0), [4, 4])
    assert levels[2].vertices.count() < levels[1].vertices.count() < level.count()
    assert pyramid.select_coarsener_key(level.columns) == "skeleton" and pyramid.select_coarsener_key(["x"], "streamline") == "polyline"


def test_coarsened_paths(spark):
    p = path(spark, [(i, 0, 0) for i in range(10)], [(i, i % 2 * 9, 0) for i in range(6)], [(50, 0, 0), (51, 0, 0)])
    thin, figures = paths.coarsen(p, 1.0, (100, 100, 100), 1)
    row = figures.first()
    assert {r.object_id for r in thin.collect()} == {1} and row.paths == 1 and row.subsampling_ratio == 3.0 and row.simplification_ratio == 18 / 10
