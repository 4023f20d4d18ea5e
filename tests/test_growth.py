"""Work, memory and broadcasts that must not grow faster than the tables."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from terravane.operators import graph, mesh, mesh_search, neighbours, quadric
from terravane.plans import runtime
from terravane.sources import binary, precomputed, ranged


def test_rounds_broadcast_small_tables_only(spark):
    """Ids take few bytes in files: a table of 2 MB there is far more in the driver."""
    before = spark.conf.get(runtime._BROADCAST, None)
    ids = runtime.materialize(spark.range(600_000).select(F.xxhash64("id").alias("id")), "ids")
    few = runtime.materialize(spark.range(100), "few")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    with runtime._round_settings(spark):
        assert "Broadcast" not in plan(ids.join(ids.withColumnRenamed("id", "other"), F.col("id") == F.col("other")))
        assert "Broadcast" in plan(ids.join(few, "id"))
    assert spark.conf.get(runtime._BROADCAST, None) == before
    assert [runtime._bytes(t) for t in ("-1", "256k", "10MB", "10485760b")] == [-1, 256 << 10, 10 << 20, 10 << 20]


def test_nearest_distances_with_copies_and_dense_cells(spark):
    """Copies are one spot with a count; cells of many spots are made smaller."""
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.integers(0, 30, (300, 3)) / 10.0, np.repeat([[1.0, 1.0, 1.0], [900.0, 0.0, -5.0]], [50, 2], axis=0), [[-0.0, 0.0, 0.0], [0.0, 0.0, 0.0]], [[1e4, 2e4, 3e4]]])
    rows = [(i, *map(float, p)) for i, p in enumerate(xyz)] + [(1000, None, 0.0, 0.0)]
    got = {r.vertex_id: r.distance for r in neighbours.knn_distance(spark.createDataFrame(rows, "vertex_id long, x double, y double, z double"), 4, 6.0).collect()}
    far = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    want = np.sort(far, axis=1)[:, :4].mean(axis=1)
    assert got.pop(1000) is None and sorted(got) == list(range(len(xyz)))
    assert np.allclose([got[i] for i in range(len(xyz))], want)


def test_nearest_distances_meet_few_pairs(spark):
    """Cells that would hold many spots are halved."""
    spots = runtime.materialize(spark.range(20_000).selectExpr("id AS spot", "(id % 100) / 50D AS x", "(id div 100) / 100D AS y", "0D AS z", "1L AS n"), "spots")
    edge = neighbours._edge(spots, 6.0, 20_000, 2.0)
    most = spots.groupBy(*[neighbours.cell(a, edge).alias(f"c{a}") for a in "xyz"]).count().agg(F.max("count")).first()[0]
    assert edge < 0.1 and most <= 16


def test_nearest_vectors_by_tiles(spark):
    """A task's arrays do not grow with queries or rows, and distances stay exact."""
    rng = np.random.default_rng(5)
    n, k = 6000, 5
    base = np.concatenate([rng.normal(size=(n - 1500, 16)), 1e6 + rng.normal(size=(1500, 16)) * 1e-3])
    base[1::3] = base[::3]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.distance for r in neighbours.knn_vectors(frame, frame.where("vec_id % 20 = 0"), k).collect()}
    for q in range(0, n, 20):
        d = ((base - base[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert got[q] == np.sqrt(np.sort(d)[k - 1])
    ids = np.arange(1000)
    points, x = rng.normal(size=(1000, 64)), rng.normal(size=(10_000, 64))
    tracemalloc.start()
    best = np.full((1000, k), np.inf), np.full((1000, k), -1)
    for at in range(0, len(x), neighbours.TILE[1]):
        for q in range(0, 1000, neighbours.TILE[0]):
            s, t = slice(q, q + neighbours.TILE[0]), slice(at, at + neighbours.TILE[1])
            best[0][s], best[1][s] = neighbours._nearer(ids[s], points[s], np.arange(len(x))[t] + 5000, x[t], best[0][s], best[1][s])
    assert tracemalloc.get_traced_memory()[1] < 64e6
    tracemalloc.stop()


def test_quadric_by_connected_parts_as_by_whole_objects(spark, monkeypatch):
    """No task takes a whole object, and the collapses are those of a run over it."""
    rng = np.random.default_rng(7)
    v, f = [], []
    for strip in range(4):  # strips of one object, apart from each other, in mixed order of ids
        base = len(v)
        v += [(i + 100.0 * strip, j, rng.normal() * (strip + 1)) for i in range(4) for j in range(6)]
        f += [t for i in range(3) for j in range(5) for t in ((base + 6 * i + j, base + 6 * i + j + 6, base + 6 * i + j + 1), (base + 6 * i + j + 6, base + 6 * i + j + 7, base + 6 * i + j + 1))]
    f.append((0, 0, 1))
    order = rng.permutation(len(f))
    v, f = np.array(v), np.array(f)[order]
    vertices = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame([(k, i, *map(int, t)) for k in (1, 2) for i, t in enumerate(f)], "object_id long, face_id long, v0 long, v1 long, v2 long")
    held = []
    kernel = quadric._groups
    monkeypatch.setattr(quadric, "_groups", lambda rows, key: (held.append(len(g["face_id"])) or g for g in kernel(rows, key)))
    for ratio in (0.5, 0.2):
        w, left = quadric.collapse(v, f, round(len(f) * ratio))
        want = [(n, k, int(c), *w[c]) for n, t in enumerate(left) for k, c in enumerate(t)]
        got = quadric.simplify(vertices, faces, ratio).collect()
        for o in (1, 2):
            assert sorted((r.face, r.corner, r.vertex_id, r.x, r.y, r.z) for r in got if r.object_id == o) == want
    parts = spark.createDataFrame([(1, 0, 0, 9, 0, 1, 2, *[float(x) for x in range(9)]), (2, 0, 1, 9, 3, 4, 5, *[float(x) for x in range(9)])], "component long, object_id long, face_id long, need long, v0 long, v1 long, v2 long, " + ", ".join(f"{c} double" for c in quadric.XYZ))
    quadric._logged(parts.toArrow())
    assert held == [1, 1]


def test_louvain_shuffles_links_twice_a_sweep(spark, monkeypatch):
    """A sweep passes the links once by their far and once by their near end, and its quality needs none."""
    plans, write = [], runtime.materialize

    def noted(df, label, *more):
        if label == "louvain-state":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label, *more)

    monkeypatch.setattr(runtime, "materialize", noted)
    pairs = [(a, b) for base in (0, 8, 16) for a in range(base, base + 8) for b in range(base, a)] + [(0, 8), (8, 16), (3, 3)]
    labels = graph.louvain(spark.createDataFrame(pairs, "v0 long, v1 long"))
    by = {r.vertex_id: r.label for r in labels.collect()}
    assert [len({by[i] for i in range(base, base + 8)}) for base in (0, 8, 16)] == [1, 1, 1] and len(set(by.values())) == 3
    assert len(plans) > 2 and all(sum("Exchange" in line for line in p.splitlines()) <= 8 and p.count("louvain-apart") <= 1 for p in plans)


def test_searches_take_rounds_by_blocks(spark, monkeypatch):
    """A long path passes few blocks; costs, hops and predecessors are those of plain search."""
    import heapq

    rng = np.random.default_rng(11)
    pairs = [(i, i + 1, 1.0) for i in range(400)] + [(int(a), int(min(400, a + d)), float(w)) for a, d, w in zip(rng.integers(0, 400, 300), rng.integers(0, 9, 300), rng.integers(0, 4, 300))] + [(500, 501, 1.0)]
    e = spark.createDataFrame(pairs, "v0 long, v1 long, weight double")
    near = {}
    for a, b, w in pairs:
        near.setdefault(a, []).append((b, w)), near.setdefault(b, []).append((a, w))

    def walk(of):
        best, heap = {}, [(0.0, 0, 3)]
        while heap:
            c, k, v = heapq.heappop(heap)
            if v not in best:
                best[v] = c, k
                for b, w in near[v]:
                    heapq.heappush(heap, (c + of(w), k + 1, b))
        return best

    rounds, write = [], runtime.materialize
    monkeypatch.setattr(runtime, "materialize", lambda df, label, *more: (rounds.append(label), write(df, label, *more))[1])
    monkeypatch.setattr(graph, "BLOCK", 256, raising=False)
    want = walk(lambda w: w)
    got = graph._relaxed(e, 3, "weight")[0].collect()
    assert {r.vertex_id: (r.cost, r.hops) for r in got} == want
    assert rounds.count("sssp") < 40
    steps = {v: c for v, (c, _) in walk(lambda w: 1.0).items()}
    rounds.clear()
    found = {r.vertex_id: (r.distance, r.predecessor) for r in graph.bfs(e, 3).collect()}
    assert found == {v: (c, min((b for b, _ in near[v] if steps[b] == c - 1), default=-1)) for v, c in steps.items()}
    assert sum(n in ("sssp", "bfs") for n in rounds) < 40
    assert {r.vertex_id for r in graph.bfs(e, 3, 20).collect()} == {v for v, c in steps.items() if c <= 20}
    heuristic = spark.createDataFrame([(i, 0.0) for i in range(0, 400, 2)], "vertex_id long, h double")
    path = graph.shortest_path(e, 3, 397, "weight", heuristic).orderBy("step").collect()
    assert path[0].vertex_id == 3 and path[-1].vertex_id == 397 and path[-1].cost == want[397][0]
    least = lambda a, b: min(w for x, w in near[a] if x == b)
    assert all(p.cost + least(p.vertex_id, q.vertex_id) == q.cost for p, q in zip(path, path[1:]))
    assert graph.shortest_path(e, 3, 501).count() == 0 and graph.shortest_path(e, 3, 3).count() == 1


def test_curvature_works_out_each_term_once(spark):
    """A face gives a row for each corner, and no term is repeated in later ones."""
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 3.0), (4, 9.0, 9.0, 9.0)], "vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 2, 1), (1, 0, 1, 3), (2, 0, 3, 2), (3, 1, 2, 3), (4, 0, 0, 1)], "face_id long, v0 long, v1 long, v2 long")
    found = mesh.mean_curvature(v, f)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("SQRT(") <= 4
    xyz, want = np.array([[0, 0, 0], [2, 0, 0], [0, 1, 0], [0, 0, 3], [9, 9, 9.0]]), {4: 0.0}
    for i in range(4):
        h, area = np.zeros(3), 0.0
        for t in ((0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)):
            if i in t:
                area += np.linalg.norm(np.cross(xyz[t[1]] - xyz[t[0]], xyz[t[2]] - xyz[t[0]])) / 6
                for j, k in ((t[(t.index(i) + 1) % 3], t[(t.index(i) + 2) % 3]), (t[(t.index(i) + 2) % 3], t[(t.index(i) + 1) % 3])):
                    a, b = xyz[i] - xyz[k], xyz[j] - xyz[k]
                    h += (xyz[j] - xyz[i]) * (a @ b) / np.linalg.norm(np.cross(a, b))
        want[i] = np.linalg.norm(h) / (2 * area) / 2
    got = {r.vertex_id: r.curvature for r in found.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and all(abs(got[i] - want[i]) < 1e-12 for i in got)


def test_small_track_files_share_tasks(spark, tmp_path, monkeypatch):
    """Partitions follow the bytes, not the number of files or of index rows."""
    paths = spark.range(40 * 6).selectExpr("id div 6 AS part", "id div 3 AS object_id", "id % 3 AS seq", "id AS x", "id + 1 AS y", "0 AS z")
    assert ranged.write_documents(binary.trk_documents(paths, "part"), str(tmp_path), "trk") == 40
    monkeypatch.setattr(ranged, "TASKS", 4, raising=False)
    assert ranged.build_offset_index(spark, str(tmp_path)).rdd.getNumPartitions() == 4
    index = runtime.materialize(ranged.build_offset_index(spark, str(tmp_path), 16), "track-index")
    reader = ranged.TrackReader({"index": index.written_at, "path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) == 4
    found = [r for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
    got = sorted((int(r["file"].rsplit("/", 1)[1][:-4]), r["object_id"], r["seq"], r["x"], r["y"], r["z"]) for r in found)
    assert got == [(i // 6, i % 6 // 3, i % 3, float(i), float(i + 1), 0.0) for i in range(240)]


def test_blocks_are_read_in_small_batches(monkeypatch):
    """A task holds some vertices at a time, however many pieces it has."""
    monkeypatch.setattr(precomputed, "BATCH", 100, raising=False)
    piece = {"vertices": np.arange(90).reshape(30, 3), "edges": [(i, i + 1) for i in range(29)], "radius": np.arange(30)}
    blocks = precomputed.InMemoryBlocks({str(k): {k: piece, k + 1000: {"vertices": np.zeros((1, 3))}} for k in range(50)}, [("radius", "float32", 1)])
    reader = precomputed.block_source(blocks, [str(k) for k in range(50)], 1)({}).reader(None)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert max(sum(len(v) for v in b.column(2)) for b in batches) <= 130
    rows = [r for b in batches for r in b.to_pylist()]
    assert [int(r["segment_id"]) for r in rows] == [s for k in range(50) for s in (k, k + 1000)]
    assert rows[0]["vertices"][7] == {"parent": 6, "x": 21.0, "y": 22.0, "z": 23.0, "radius": 7.0} and rows[1]["vertices"][0]["radius"] is None


def test_rays_are_dealt_to_tasks(spark, monkeypatch):
    """Rays from one small file are walked by many tasks, and those beside the mesh not at all."""
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 40.0, 0.0, 0.0), (2, 0.0, 40.0, 3.0)], "vertex_id long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2)], "face_id long, v0 long, v1 long, v2 long")
    rays = spark.range(2000).coalesce(1).selectExpr("id AS ray_id", "id + 0.5D AS ox", "1D AS oy", "9D AS oz", "0D AS dx", "0D AS dy", "-2D AS dz")
    monkeypatch.setattr(mesh_search, "WALKED", (250, 64), raising=False)
    found = mesh_search.cast_rays(v, f, rays, 8.0)
    assert "Exchange RoundRobinPartitioning(8)" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.ray_id for r in found.collect()) == list(range(39))
    some = np.array([[1.0, 1, 9, 0, 0, -1], [99, 1, 9, 0, 0, -1], [-5, 1, 1, 1, 0, 0], [-5, 1, 1, -1, 0, 0], [1, 1, 1, 0, 0, 0]])
    assert mesh_search.in_box(some[:, :3], some[:, 3:], np.zeros(3), np.array([40.0, 40, 3])).tolist() == [True, False, True, False, True]
