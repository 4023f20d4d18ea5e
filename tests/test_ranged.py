"""Files read by byte ranges against the readers of whole files."""

import math
import random
import struct

import pytest

from terravane.sources import binary, formats, ranged


def trk(tracks, scalars=0, properties=0, tail=b""):
    head = bytearray(1000)
    head[:6] = b"TRACK\0"
    struct.pack_into("<h", head, 36, scalars), struct.pack_into("<h", head, 238, properties)
    body = b"".join(struct.pack("<i", n) + struct.pack(f"<{len(v)}f", *v) for n, v in tracks)
    return bytes(head) + body + tail


def made(seed, count, scalars=0, properties=0, most=9):
    draw = random.Random(seed)
    sizes = [draw.randint(1, most) for _ in range(count)]
    return [(n, [float(draw.randint(-50, 50)) for _ in range(n * (3 + scalars) + properties)]) for n in sizes]


def rows(df):
    return sorted((r.file.rsplit("/", 1)[-1], *[tuple(v) if isinstance(v, list) else v for v in r[1:]]) for r in df.collect())


def test_tracks_by_ranges(spark, tmp_path):
    (tmp_path / "a.trk").write_bytes(trk(made(1, 300, 2, 3), 2, 3))
    (tmp_path / "b.trk").write_bytes(trk(made(2, 40, 2, 3), 2, 3, struct.pack("<i", 0) + b"junk after the end"))
    (tmp_path / "c.trk").write_bytes(trk([], 2, 3))
    (tmp_path / "d.trk").write_bytes(trk(made(3, 5, 2, 3), 2, 3)[:-4])  # its last record is cut short
    where = str(tmp_path / "*.trk")
    whole = rows(formats.read_trk(spark, str(tmp_path / "[abc].trk"), attributes=True))
    index = ranged.build_offset_index(spark, where, step=500)
    found = sorted(index.collect(), key=lambda r: (r.file, r.begin))
    assert sum(r.tracks for r in found) == 344 and len(found) > 30
    assert all(b.begin == a.end and b.first == a.first + a.tracks for a, b in zip(found, found[1:], strict=False) if a.file == b.file)
    got = rows(ranged.read_tracks(spark, where, attributes=True, step=500))
    assert [r for r in got if r[0] != "d.trk"] == whole
    assert {r[1] for r in got if r[0] == "d.trk"} == {0, 1, 2, 3}
    some = ranged.read_tracks(spark, where, parts=8, step=500)
    assert 4 <= some.rdd.getNumPartitions() <= 12 and rows(some) == [r[:-2] for r in got]
    plain = rows(formats.read_trk(spark, str(tmp_path / "a.trk")))
    assert rows(ranged.read_tracks(spark, str(tmp_path / "a.trk"))) == plain


def test_records_longer_than_a_window(tmp_path):
    long = [(5000, [1.0] * 15000), (2, [2.0] * 6), (7000, [3.0] * 21000)]
    (tmp_path / "l.trk").write_bytes(trk(long))
    found = list(ranged.scan_tracks(str(tmp_path / "l.trk"), step=10, window=64))
    assert [(r[3], r[4], r[5]) for r in found] == [(0, 1, 5000), (1, 1, 2), (2, 1, 7000)]
    part = ranged.Range(str(tmp_path / "l.trk"), found[0][1], found[-1][2], 0)
    small, ranged.STEP = ranged.STEP, 100
    try:
        batches = list(ranged.TrackReader({"path": "", "index": ""}).read(part))
    finally:
        ranged.STEP = small
    assert sum(b.num_rows for b in batches) == 12002 and [b.column("object_id")[0].as_py() for b in batches] == [0, 1, 2]


def test_one_file_in_many_tasks(spark, tmp_path):
    (tmp_path / "big.trk").write_bytes(trk(made(5, 3_000, most=60)))
    got = ranged.read_tracks(spark, str(tmp_path / "big.trk"), parts=32, step=1 << 12)
    assert got.rdd.getNumPartitions() == 32
    want = formats.read_trk(spark, str(tmp_path / "big.trk"))
    assert got.count() == want.count() and got.select("object_id", "seq", "x", "y", "z").exceptAll(want.select("object_id", "seq", "x", "y", "z")).isEmpty()


@pytest.mark.parametrize(("fmt", "width"), [(0, 20), (3, 34), (4, 57), (10, 67)])
def test_las_by_ranges(spark, tmp_path, fmt, width):
    head = bytearray(227)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 2, fmt
    struct.pack_into("<I", head, 96, 227), struct.pack_into("<HI", head, 105, width, 250)
    struct.pack_into("<3d", head, 131, 0.5, 0.5, 0.5), struct.pack_into("<3d", head, 155, 10, 0, 0)
    draw = random.Random(fmt)
    points = b"".join(struct.pack("<3iH", *(draw.randint(0, 99) for _ in range(4))) + bytes(draw.randint(0, 63) for _ in range(width - 14)) for _ in range(250))
    (tmp_path / "a.las").write_bytes(bytes(head) + points)
    got = ranged.read_las_parts(spark, str(tmp_path), 7)
    assert got.rdd.getNumPartitions() == 7
    assert rows(got) == rows(binary.read_las(spark, str(tmp_path / "a.las")))


def test_unknown_las_format():
    raw = bytearray(227)
    raw[:4], raw[104] = b"LASF", 33
    with pytest.raises(ValueError, match="format 33"):
        binary.las_header(bytes(raw))


@pytest.mark.parametrize(("kind", "letter"), [("Float32LE", "<f"), ("Float32BE", ">f"), ("Float64LE", "<d"), ("Float64BE", ">d")])
def test_track_datatypes(spark, tmp_path, kind, letter):
    text = f"mrtrix tracks\ndatatype: {kind}\nfile: . 60\nEND\n".encode().ljust(60)
    data = [1, 2, 3, 4, 5, 6, *[math.nan] * 3, 7, 8, 9, *[math.nan] * 3, *[math.inf] * 3]
    (tmp_path / "a.tck").write_bytes(text + struct.pack(f"{letter[0]}18{letter[1]}", *data))
    got = formats.read_tck(spark, str(tmp_path / "a.tck")).orderBy("object_id", "seq").collect()
    assert [(r.object_id, r.seq, r.x) for r in got] == [(0, 0, 1), (0, 1, 4), (1, 0, 7)]
