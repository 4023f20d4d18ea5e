"""Files in, files out, the store, headers, the command line and the stream."""

import math
import struct
from datetime import datetime

import pytest

from terravane.cli.__main__ import build_factors, main
from terravane.sources import formats, headers, store
from terravane.streaming.bins import windowed_bins


def write(tmp_path, name, content):
    (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(tmp_path / name)


def test_csv(spark, tmp_path):
    p = write(tmp_path, "p.csv", "pos_x,pos_y,pos_z,label,other\n1,2,3,4,5\nnan,0,0,0,0\n1,2,3,9,9\n-1,-2,-3,1,1\n")
    got = formats.read_csv_points(spark, p, auto=True, drop_na=True, drop_duplicates=True).orderBy("vertex_id").collect()
    assert [(r.vertex_id, r.x, r.label) for r in got] == [(0, 1.0, 4.0), (1, -1.0, 1.0)] and "other" not in got[0].asDict()
    q = write(tmp_path, "p.xyz", "1 2 3\n4 5 6\n")
    assert formats.read_csv_points(spark, q, delimiter=" ", header=False).count() == 2
    assert formats.detect_columns(["X", "y"], 3) == ([], [])
    formats.write_csv(formats.read_csv_points(spark, q, delimiter=" ", header=False), str(tmp_path / "out"))
    back = formats.read_csv_points(spark, str(tmp_path / "out"))
    assert sorted((r.x, r.y, r.z) for r in back.collect()) == [(1, 2, 3), (4, 5, 6)]


def test_lines_and_edges(spark, tmp_path):
    p = write(tmp_path, "l.csv", "x0,y0,z0,x1,y1,z1,w\n0,0,0,1,0,0,1\n0,0,0,3,4,0,2\n1,1,1,1,1,1,3\n0,0,0,nan,0,0,4\n")
    got = formats.read_lines_csv(spark, p, drop_zero=True, drop_na=True).collect()
    assert sorted(r.length for r in got) == [1.0, 5.0]
    n = write(tmp_path, "n.csv", "node_id,x,y,z\na,0,0,0\nb,1,0,0\nc,2,0,0\n")
    e = write(tmp_path, "e.csv", "source,target,weight\na,b,.5\nb,c,.6\nc,zz,.7\n")
    nodes, edges = formats.read_edge_list(spark, e, n)
    assert nodes.count() == 3 and sorted((r.v0, r.v1, r.weight) for r in edges.collect()) == [(0, 1, 0.5), (1, 2, 0.6)]


def test_swc(spark, tmp_path):
    p = write(tmp_path, "a.swc", "# head\n1 1 0 0 0 2 -1\n2 3 1 0 0 1 1\n3 3 2 0 0 1 2\nbad line\n4 3 3 0 0 1 77\n")
    rows = formats.read_swc(spark, p)
    assert {r.node: r.parent for r in rows.collect()} == {1: -1, 2: 1, 3: 2, 4: -1}
    formats.write_swc(rows, str(tmp_path / "out"))
    assert formats.read_swc(spark, str(tmp_path / "out")).drop("file").exceptAll(rows.drop("file")).count() == 0


def test_meshes(spark, tmp_path):
    p = write(tmp_path, "m.obj", "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nv 0 2 0\no cell_a\nf 1 2 3 4 5\ng cell_b\nf -5/1/1 -4//2 -3\n")
    v, f = formats.read_obj(spark, p)
    assert v.count() == 5 and [r.object_id for r in f.orderBy("face_id").collect()] == [0, 0, 0, 1]
    formats.write_obj(v, f, str(tmp_path / "obj"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "obj")).collect()]
    assert sum(x.startswith("v ") for x in lines) == 5 and "f 1 2 3" in lines
    tri = [((0, 0, 0), (1, 0, 0), (0, 1, 0)), ((1, 0, 0), (1, 1, 0), (0, 1, 0))]
    text = "solid x\n" + "".join("facet normal 0 0 1\nouter loop\n" + "".join(f"vertex {a} {b} {c}\n" for a, b, c in t) + "endloop\nendfacet\n" for t in tri) + "endsolid\n"
    raw = b"solid but binary".ljust(80) + struct.pack("<I", 2) + b"".join(struct.pack("<12fH", 0, 0, 1, *[x for c in t for x in c], 0) for t in tri)
    for name, content in (("a.stl", text), ("b.stl", raw)):
        v, f = formats.read_stl(spark, write(tmp_path, name, content))
        assert v.count() == 4 and f.count() == 2


def test_ply(spark, tmp_path):
    head = "ply\nformat {}\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n"
    a = write(tmp_path, "a.ply", head.format("ascii 1.0") + "1 2 3 9\n4 5 6 8\n")
    b = write(tmp_path, "b.ply", head.format("binary_little_endian 1.0").encode() + struct.pack("<fffB", 1, 2, 3, 9) + struct.pack("<fffB", 4, 5, 6, 8))
    for p in (a, b):
        assert [(r.x, r.z, r.red) for r in formats.read_ply(spark, p, ("red",)).orderBy("vertex_id").collect()] == [(1, 3, 9), (4, 6, 8)]


def test_tracks(spark, tmp_path):
    head = bytearray(1000)
    head[:5] = b"TRACK"
    struct.pack_into("<3h", head, 6, 10, 20, 30)
    struct.pack_into("<h", head, 36, 1)
    body = struct.pack("<i", 2) + struct.pack("<8f", 1, 2, 3, 9, 4, 5, 6, 9) + struct.pack("<i", 1) + struct.pack("<4f", 7, 8, 9, 9) + struct.pack("<i", 0) + b"junk"
    got = formats.read_trk(spark, write(tmp_path, "a.trk", bytes(head) + body)).orderBy("object_id", "seq").collect()
    assert [(r.object_id, r.seq, r.x) for r in got] == [(0, 0, 1), (0, 1, 4), (1, 0, 7)]
    assert formats.parse_trk_header(bytes(head))["dim"] == (10, 20, 30)
    text = b"mrtrix tracks\ndatatype: Float32LE\nfile: . 60\nEND\n".ljust(60)
    nan, inf = math.nan, math.inf
    data = struct.pack("<18f", 1, 2, 3, 4, 5, 6, nan, nan, nan, 7, 8, 9, nan, nan, nan, inf, inf, inf)
    got = formats.read_tck(spark, write(tmp_path, "a.tck", text + data)).orderBy("object_id", "seq").collect()
    assert [(r.object_id, r.seq, r.x) for r in got] == [(0, 0, 1), (0, 1, 4), (1, 0, 7)]


def test_graphml(spark, tmp_path):
    text = '<graphml><graph><node id="a"><data key="x">1</data></node><node id="b"/><edge source="a" target="b"><data key="w">2</data></edge></graph></graphml>'
    nodes, edges = formats.read_graphml(spark, write(tmp_path, "g.graphml", text))
    assert {r.id: r.data for r in nodes.collect()} == {"a": {"x": "1"}, "b": {}}
    assert [(r.source, r.target, r.data) for r in edges.collect()] == [("a", "b", {"w": "2"})]


def test_blocks_and_boxes(spark):
    made = formats.block_boxes(spark, (0, 0, 0), (100, 50, 10), (64, 64, 64))
    assert {r.name for r in made.collect()} == {"0-64_0-50_0-10", "64-100_0-50_0-10"}
    read = formats.parse_boxes(made.select("name")).collect()
    assert {(r.x0, r.x1, r.z1) for r in read} == {(0, 64, 10), (64, 100, 10)}
    assert formats.grid_shape((0, 0, 0), (100, 100, 100)) == (20.0, 20.0, 20.0) and formats.grid_shape((0, 0, 0), (0, 1, 1)) == (10.0,) * 3


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, float(i), float(-i), 0.5) for i in range(100)], "vertex_id long, object_id long, x double, y double, z double")
    where = str(tmp_path / "s")
    store.write_level(rows, where, 0, (10.0, 10.0, 10.0))
    assert store.read_points(spark, where, 0, (5, -20, 0), (30, 0, 1)).count() == 16
    assert store.read_points(spark, where, 0, object_ids=[1]).count() == 33
    assert store.read_points(spark, where, 0, chunks=[(0, -1, 0)]).count() == 9
    assert store.validate(spark, where) == []
    links = spark.createDataFrame([(0, 1), (1, 1000)], "v0 long, v1 long")
    assert store.validate(spark, where, 0, links) == ["1 links with a missing v1"]
    store.reshard(spark, where, 0, 2)
    assert store.read_points(spark, where, 0).count() == 100


def test_composite_and_write_back(spark, tmp_path):
    a = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(10)], "vertex_id long, x double, y double, z double")
    b = spark.createDataFrame([(100 + i, float(i), 1.0, 0.0, 2.5) for i in range(5)], "vertex_id long, x double, y double, z double, w double")
    where = str(tmp_path / "c")
    store.write_composite({"points": a, "mesh": b}, where, 0, (4.0, 4.0, 4.0))
    assert store.read_composite(spark, where, 0, "mesh").count() == 5 and store.read_composite(spark, where, 0, "points", low=(0, 0, 0), high=(3, 9, 9)).count() == 4
    store.write_back(spark, where, 0, spark.createDataFrame([(3, 9), (104, 8)], "vertex_id long, label long"))
    got = {r.vertex_id: r.label for r in store.read_points(spark, where, 0).collect()}
    assert len(got) == 15 and got[3] == 9 and got[104] == 8 and got[0] is None
    assert store.validate(spark, where) == []


def test_headers(spark):
    registry = headers.HeaderRegistry()
    registry.add(headers.Header("trk", {"affine": [1, 0]}))
    back = headers.HeaderRegistry.from_frame(registry.to_frame(spark))
    assert back.available_formats == ["trk"] and back.get("trk").affine == [1, 0]
    back.remove("trk")
    with pytest.raises(KeyError):
        back.get("trk")
    with pytest.raises(ValueError):
        headers.header_from_dict({"format": "unheard"})
    assert headers.header_from_dict({"format": "swc"}).to_dict() == {"format": "swc", "fields": {}}


def test_command_line(spark, tmp_path, capsys):
    p = write(tmp_path, "p.csv", "x,y,z\n" + "".join(f"{i},{i * 2},{i % 3}\n" for i in range(50)))
    where = str(tmp_path / "store")
    assert main(["convert", p, where, "--chunk-shape", "10,10,10"]) == 0
    assert main(["pyramid", where, "--bin-shape", "5,5,5", "--bin-factors", "1,2"]) == 0
    assert main(["validate", where]) == 0 and main(["info", where]) == 0
    assert len([x for x in capsys.readouterr().out.splitlines() if x[:1].isdigit()]) == 3
    assert build_factors(None, None) is None and build_factors("2,4", None) == [(2, 1), (4, 1)]
    with pytest.raises(SystemExit):
        build_factors("2", "1,2")


def test_command_line_keeps_links(spark, tmp_path, capsys):
    """Faces, edges and parents go into the store; a store is not overwritten unasked."""
    cube = "".join(f"v {i} {i % 2} {i // 2}\n" for i in range(6)) + "f 1 2 3\nf 2 3 4\nf 4 5 6\n"
    mesh, where = write(tmp_path, "m.obj", cube), str(tmp_path / "mesh")
    assert main(["convert", mesh, where, "--chunk-shape", "2,2,2"]) == 0
    v, f = store.read_mesh(spark, where)
    assert v.count() == 6 and sorted((r.v0, r.v1, r.v2) for r in f.collect()) == [(0, 1, 2), (1, 2, 3), (3, 4, 5)]
    assert store.read_mesh(spark, where, low=(0, 0, 0), high=(2, 9, 9))[1].count() == 1
    with pytest.raises(SystemExit):
        main(["convert", mesh, where, "--chunk-shape", "2,2,2"])
    assert main(["convert", mesh, where, "--chunk-shape", "3,3,3", "--overwrite", "--bin-shape", "2,2,2"]) == 0
    assert store.level_shape(spark, where, 0) == (3, 3, 3) and store.has_level(spark, where, 1)
    assert store.read_links(spark, where, 0, "level_parents").count() == 6
    n, e = write(tmp_path, "n.csv", "node_id,x,y,z\na,0,0,0\nb,1,0,0\nc,2,0,0\n"), write(tmp_path, "e.csv", "source,target,weight\na,b,.5\nb,c,.6\n")
    assert main(["convert", e, str(tmp_path / "graph"), "--format", "edgelist", "--nodes", n, "--chunk-shape", "1,1,1"]) == 0
    assert store.read_graph(spark, str(tmp_path / "graph"))[1].count() == 2
    swc = write(tmp_path, "t.swc", "".join(f"{i} 3 {i} 0 0 1 {i - 1 if i > 1 else -1}\n" for i in range(1, 20)))
    assert main(["convert", swc, str(tmp_path / "tree"), "--chunk-shape", "50,50,50", "--bin-shape", "50,50,50"]) == 0
    thin = store.read_points(spark, str(tmp_path / "tree"), 1)
    assert sorted((r.vertex_id, r.parent) for r in thin.collect()) == [(0, -1)] + [(k, k - 2) for k in range(2, 19, 2)]
    lines = write(tmp_path, "l.csv", "x0,y0,z0,x1,y1,z1\n0,0,0,1,0,0\n5,5,5,9,9,9\n")
    assert main(["convert", lines, str(tmp_path / "lines"), "--format", "lines", "--chunk-shape", "4,4,4"]) == 0
    assert [r.line_id for r in store.read_lines(spark, str(tmp_path / "lines"), low=(0, 0, 0), high=(4, 4, 4)).collect()] == [0]


def test_levels_are_replaced_whole(spark, tmp_path):
    points = spark.range(40).selectExpr("id AS vertex_id", "double(id) AS x", "double(id % 5) AS y", "double(0) AS z")
    where = str(tmp_path / "s")
    store.write_level(points, where, 0, (10, 10, 10))
    store.write_back(spark, where, 0, points.selectExpr("vertex_id", "x * 2 AS twice"))
    store.reshard(spark, where, 0, 3)
    store.rechunk(spark, where, 0, (5, 5, 5))
    store.coarsen_points(spark, where, 0, 1, (20, 20, 20))
    back = store.read_points(spark, where, 0)
    assert back.where("twice = 2 * x").count() == 40 and store.level_shape(spark, where, 0) == (5, 5, 5)
    assert sorted(r.x for r in store.read_points(spark, where, 1).collect()) == [9.5, 29.5]
    assert sorted(x.name for x in (tmp_path / "s").iterdir()) == ["level=0", "level=1", "meta"]
    with pytest.raises(ValueError):
        store.require_link_width(points.selectExpr("vertex_id AS v0"), 2)


def test_columns_by_name():
    assert formats.detect_columns([" PosX", "conf", "py", "tissue", "Z ", "i", "x"]) == ([" PosX", "py", "Z "], ["conf", "tissue", "i"])
    assert formats.detect_columns(["a", "b", "c"]) == ([], [])


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    for k in range(3):
        write(tmp_path, f"{k}.csv", "x,y,z\n" + "".join(f"{k},{i},0\n" for i in range(100)))
    got = formats.read_csv_points(spark, str(tmp_path)).orderBy("vertex_id").collect()
    assert [(r.vertex_id, r.x, r.y) for r in got] == [(100 * k + i, k, i) for k in range(3) for i in range(100)]
    moved = formats.read_csv_points(spark, str(tmp_path), normalise=True)
    assert max(abs(r.y) for r in moved.collect()) == 1.0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 0, i % 40), float(i), float(i % 7), 0.0) for i in range(200)], "ts timestamp, x double, y double, z double")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    shape = (50.0, 5.0, 1.0)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = windowed_bins(stream, shape).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    run.processAllAvailable()
    run.stop()
    got = {(r.start, r.gx, r.gy): (r.n, r.x) for r in spark.sql("SELECT * FROM bins").collect()}
    assert got == {(r.start, r.gx, r.gy): (r.n, r.x) for r in windowed_bins(rows, shape).collect()}
