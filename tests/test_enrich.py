"""Columns and tables worked out at ingest, through the command line."""

import struct

import pytest

from terravane.cli.__main__ import main
from terravane.operators import enrich
from terravane.sources import formats, store


def test_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x,y,z,cell\n" + "".join(f"{i * i},0,0,{i % 3}\n" for i in range(9)))
    where = str(tmp_path / "s")
    main(["convert", str(tmp_path / "p.csv"), where, "--chunk-shape", "10,10,10", "--object-column", "cell", "--knn", "1", "--enrich"])
    rows = {r.vertex_id: r for r in store.read_points(spark, where).collect()}
    assert [rows[i].object_id for i in range(9)] == [i % 3 for i in range(9)] and "cell" not in rows[0]
    assert [rows[i].knn_distance for i in (0, 1, 3)] == [1.0, 1.0, 5.0]
    assert {(r.object_id, r.n) for r in store.read_objects(spark, where).collect()} == {(0, 3), (1, 3), (2, 3)}


def test_tracks(spark, tmp_path):
    head = bytearray(1000)
    head[:5] = b"TRACK"
    struct.pack_into("<h", head, 36, 1)
    body = b"".join(struct.pack("<i", n) + struct.pack(f"<{4 * n}f", *[v for i in range(n) for v in (i, k, 0, 7 + i)]) for k, n in enumerate((3, 12, 5)))
    (tmp_path / "a.trk").write_bytes(bytes(head) + body)
    where = str(tmp_path / "s")
    main(["convert", str(tmp_path / "a.trk"), where, "--chunk-shape", "10,10,10", "--enrich", "--length-range", "3,20"])
    got = {r.object_id: (r.n, r.length, r.ax, r.bx) for r in store.read_objects(spark, where).collect()}
    assert got == {1: (12, 11.0, 0.0, 11.0), 2: (5, 4.0, 0.0, 4.0)}
    assert {tuple(r.scalars) for r in store.read_points(spark, where).where("seq = 2").collect()} == {(9.0,)}
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 2.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0)], "object_id long, seq long, x double, y double, z double")
    assert {r.object_id for r in enrich.within_length(p, high=2.0).collect()} == {1, 2} and enrich.within_length(p, 3.0).count() == 0


def test_trees(spark, tmp_path):
    (tmp_path / "t.swc").write_text("1 1 0 0 0 1 -1\n2 3 1 0 0 1 1\n3 3 2 0 0 1 2\n4 3 2 1 0 1 2\n")
    where = str(tmp_path / "s")
    main(["convert", str(tmp_path / "t.swc"), where, "--chunk-shape", "10,10,10", "--enrich"])
    got = {r.vertex_id: (r.depth, r.strahler, r.kind, r.type) for r in store.read_points(spark, where).collect()}
    assert got == {0: (0, 2, 0, 1), 1: (1, 2, 1, 3), 2: (2, 1, 3, 3), 3: (2, 1, 3, 3)}


GRAPHML = """<graphml><key id="d0" for="node" attr.name="x" attr.type="double"/><key id="d1" for="node" attr.name="size" attr.type="int"/>
<key id="d2" for="node" attr.name="name" attr.type="string"/><key id="w" for="edge" attr.name="weight" attr.type="double"/><graph>
<node id="a"><data key="d0">1.5</data><data key="d1">7</data><data key="d2">first</data></node><node id="b"><data key="d0">2</data></node>
<node id="c"><data key="d1">bad</data></node><node id="d"/>
<edge source="a" target="b"><data key="w">0.5</data></edge><edge source="b" target="c"/><edge source="c" target="a"/><edge source="a" target="unknown"/></graph></graphml>"""


def test_graphs(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    nodes, edges = formats.read_graphml_typed(spark, str(tmp_path / "g.graphml"))
    assert [t for _, t in nodes.select("x", "size", "name").dtypes] == ["double", "bigint", "string"]
    assert {r.id: (r.vertex_id, r.x, r["size"], r.name) for r in nodes.collect()} == {"a": (0, 1.5, 7, "first"), "b": (1, 2.0, 0, ""), "c": (2, 0.0, 0, ""), "d": (3, 0.0, 0, "")}
    assert {(r.v0, r.v1, r.weight) for r in edges.collect()} == {(0, 1, 0.5), (1, 2, 0.0), (2, 0, 0.0)}
    where = str(tmp_path / "s")
    main(["convert", str(tmp_path / "g.graphml"), where, "--chunk-shape", "10,10,10", "--enrich"])
    got = {r.id: (r.x, r.degree, r.component, r.clustering) for r in store.read_graph(spark, where)[0].collect()}
    assert got == {"a": (1.5, 2, 0, 1.0), "b": (2.0, 2, 0, 1.0), "c": (0.0, 2, 0, 1.0), "d": (0.0, 0, 3, 0.0)}
    assert store.read_graph(spark, where)[1].count() == 3


def test_unknown_format(spark, tmp_path):
    (tmp_path / "x.what").write_text("")
    with pytest.raises(SystemExit, match="unknown format"):
        main(["convert", str(tmp_path / "x.what"), str(tmp_path / "s"), "--chunk-shape", "1,1,1"])
