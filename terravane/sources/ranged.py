"""Large binary files read by many tasks: data sources whose partitions are byte ranges.

``spark.read.format("tracks")`` reads TrackVis files.  Their records differ in length,
so an *offset index* comes first: one pass over each file's point counts, written as a
table with a row for every ``step`` bytes of whole records.  Index rows are joined to
partitions of about equal bytes, and a task reads and parses its own range.
``spark.read.format("las")`` reads LAS files, whose records have one length: ranges
follow from the header.  Files are opened through Arrow's file systems, so local, HDFS
and object-store paths read alike; nothing but headers and index rows passes the driver.

Defined results
* A track record with no points or fewer ends its file, as does one cut short.
* ``object_id`` (track) and ``vertex_id`` (LAS point) count from 0 in each file, the same
  whatever the ranges.  An empty file, or one without records, has no partition.
* Options: ``path`` (a file, a folder, or a pattern for the last part), ``attributes``
  (tracks: scalars and properties too), ``parts`` (about how many partitions;
  without it one for every index row, or every ``rows`` points).  More than ``TASKS``
  ranges of tracks share partitions, so tasks follow the bytes and not the files.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terravane.plans import runtime
from terravane.sources.binary import las_columns, las_header
from terravane.sources.formats import parse_trk_header

#: Bytes of records to an index row, and of a file held while it is scanned.
STEP, WINDOW = 16 << 20, 8 << 20
#: Points of a LAS partition, and rows of an Arrow batch.
LAS_ROWS, BATCH = 1 << 19, 1 << 17
#: Tasks of small files: as many share the ranges, or one for every ``STEP`` bytes if that is more.
TASKS = 256

INDEX = "file string, begin long, end long, first long, tracks long, vertices long"
TRACKS = "file string, object_id long, seq long, x double, y double, z double"
LAS = "file string, vertex_id long, x double, y double, z double, intensity double, classification double, gps_time double, red double, green double, blue double"


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    local = re.sub(r"^file:/+", "/", path)
    if "://" in local:
        return pyarrow.fs.FileSystem.from_uri(local)
    return pyarrow.fs.LocalFileSystem(), local


def files(path: str) -> list[str]:
    """The files a path, folder or pattern names, in order."""
    system, at = located(path)
    folder, last = posixpath.split(at)
    if any(c in last for c in "*?["):
        found = system.get_file_info(pyarrow.fs.FileSelector(folder))
        found = [f for f in found if fnmatch.fnmatch(f.base_name, last)]
    else:
        info = system.get_file_info(at)
        found = system.get_file_info(pyarrow.fs.FileSelector(at)) if info.type == pyarrow.fs.FileType.Directory else [info]
    prefix = path[: len(path) - len(at)] if path.endswith(at) and "://" in path else ""
    return sorted(prefix + f.path for f in found if f.type == pyarrow.fs.FileType.File and not f.base_name.startswith(("_", ".")))


def write_documents(documents: DataFrame, folder: str, ending: str) -> int:
    """Write documents (name, content) as files ``name.ending`` (``name`` for an empty ending) of a
    shared folder, each by the task that holds it (a task that runs again writes the same file); returns how many."""

    def write(batches: Iterator[pd.DataFrame]):
        system, at = located(folder)
        system.create_dir(at, recursive=True)
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                with system.open_output_stream(f"{at}/{name}.{ending}" if ending else f"{at}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(b)]})

    return documents.select("name", "content").mapInPandas(write, "n long").agg({"n": "sum"}).first()[0] or 0


# -- tracks ------------------------------------------------------------------------


def _record(header: dict) -> tuple[int, int]:
    """Bytes of a point and of a track's properties."""
    return 4 * (3 + header["n_scalars"]), 4 * header["n_properties"]


def scan_tracks(path: str, step: int = STEP, window: int = WINDOW) -> Iterator[tuple[str, int, int, int, int, int]]:
    """Index rows of one file; what is held of it is a window, whatever its size."""
    system, at = located(path)
    with system.open_input_file(at) as file:
        size = file.size()
        point, rest = _record(parse_trk_header(file.read_at(min(1000, size), 0)))
        held, base = b"", 0
        begin = here = 1000
        first = tracks = vertices = 0
        while here + 4 <= size:
            if not base <= here <= base + len(held) - 4:
                held, base = file.read_at(min(window, size - here), here), here
            n = struct.unpack_from("<i", held, here - base)[0]
            end = here + 4 + n * point + rest
            if n <= 0 or end > size:
                break
            here, tracks, vertices = end, tracks + 1, vertices + n
            if here - begin >= step:
                yield path, begin, here, first, tracks, vertices
                begin, first, tracks, vertices = here, first + tracks, 0, 0
        if tracks:
            yield path, begin, here, first, tracks, vertices


def build_offset_index(spark: SparkSession, path: str, step: int = STEP) -> DataFrame:
    """file, begin, end (bytes of whole records), first (track number), tracks, vertices: files
    are scanned side by side, each by one task (many small ones share it)."""
    names = files(path)

    def rows(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for name in b["file"]:
                found = list(scan_tracks(name, step))
                if found:
                    yield pd.DataFrame(found, columns=[c.split()[0] for c in INDEX.split(", ")])

    listed = spark.createDataFrame([(n,) for n in names], "file string")
    return listed.repartition(max(1, min(len(names), TASKS))).mapInPandas(rows, INDEX)


def parse_tracks(raw: bytes, header: dict, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(track of each point, place in the track, values of each point, properties of each
    track) of a range of whole records."""
    width, properties = 3 + header["n_scalars"], header["n_properties"]
    whole = np.frombuffer(raw, "<i4")
    at, begins = 0, []
    while at < len(whole):
        begins.append(at)
        at += 1 + int(whole[at]) * width + properties
    begins = np.array(begins, np.int64)
    n = whole[begins].astype(np.int64)
    seq = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    from_ = np.repeat(begins + 1, n) + seq * width
    words = whole.view("<f4")
    values = words[from_[:, None] + np.arange(width)]
    tail = words[(begins + 1 + n * width)[:, None] + np.arange(properties)]
    return np.repeat(first + np.arange(len(n)), n), seq, values, tail


@dataclass
class Range(InputPartition):
    """A stretch of one file: bytes of records (tracks) or records (LAS)."""

    file: str
    begin: int
    end: int
    first: int


@dataclass
class Ranges(InputPartition):
    """Stretches of several files."""

    ranges: list[Range]


def _flag(options: dict, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


def balanced(sizes: list[int], parts: int | None) -> list[tuple[int, int]]:
    """Consecutive items as (from, to) of about equal sums, at most ``parts`` of them."""
    if parts is None or parts >= len(sizes):
        return [(k, k + 1) for k in range(len(sizes))]
    part = (np.cumsum(sizes) - 1) * parts // max(1, sum(sizes))
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


class TrackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.attributes = _flag(options, "attributes")

    def partitions(self) -> list[Ranges]:
        system, at = located(self.options["index"])
        rows = pyarrow.dataset.dataset(at, filesystem=system, format="parquet").to_table().to_pylist()
        wanted = set(files(self.options["path"]))
        by: dict[str, list[dict]] = {}
        for r in sorted(rows, key=lambda r: (r["file"], r["begin"])):
            if r["file"] in wanted:
                by.setdefault(r["file"], []).append(r)
        parts = int(self.options["parts"]) if "parts" in self.options else None
        whole = sum(r["end"] - r["begin"] for rs in by.values() for r in rs)
        out = []
        for name, rs in by.items():  # a range lies in one file
            sizes = [r["end"] - r["begin"] for r in rs]
            share = None if parts is None else max(1, round(parts * sum(sizes) / whole))
            out += [Range(name, rs[a]["begin"], rs[b - 1]["end"], rs[a]["first"]) for a, b in balanced(sizes, share)]
        tasks = max(TASKS if parts is None else parts, -(-whole // STEP))
        return [Ranges(out[a:b]) for a, b in balanced([r.end - r.begin for r in out], tasks)] if out else []

    def read(self, part: Range | Ranges | None) -> Iterator[pa.RecordBatch]:
        for one in getattr(part, "ranges", [part]):
            yield from self._range(one)

    def _range(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        system, at = located(part.file)
        with system.open_input_file(at) as file:
            header = parse_trk_header(file.read_at(1000, 0))
            point, rest = _record(header)
            here, first = part.begin, part.first
            while here < part.end:  # whole records of at least a step at a time
                raw = file.read_at(min(STEP, part.end - here), here)
                stop = whole = 0
                while stop + 4 <= len(raw):
                    end = stop + 4 + struct.unpack_from("<i", raw, stop)[0] * point + rest
                    if end > len(raw):
                        break
                    stop, whole = end, whole + 1
                if not whole:  # one record longer than a step
                    stop, whole = 4 + struct.unpack_from("<i", raw, 0)[0] * point + rest, 1
                    raw = file.read_at(stop, here)
                yield from self._batches(part.file, *parse_tracks(raw[:stop], header, first), first)
                here, first = here + stop, first + whole

    def _batches(self, name: str, track: np.ndarray, seq: np.ndarray, values: np.ndarray, tail: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(track), BATCH):
            t, s, v = track[a : a + BATCH], seq[a : a + BATCH], values[a : a + BATCH].astype(float)
            out = {"file": pa.array([name] * len(t), pa.string()), "object_id": pa.array(t), "seq": pa.array(s)} | {c: pa.array(v[:, k]) for k, c in enumerate("xyz")}
            if self.attributes:
                out |= {"scalars": _lists(v[:, 3:]), "properties": _lists(tail[t - first].astype(float))}
            yield pa.RecordBatch.from_pydict(out)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


class TrackSource(DataSource):
    """TrackVis files by ranges of an offset index (option ``index``: its table)."""

    @classmethod
    def name(cls) -> str:
        return "tracks"

    def schema(self) -> str:
        return TRACKS + (", scalars array<double>, properties array<double>" if _flag(self.options, "attributes") else "")

    def reader(self, schema) -> DataSourceReader:
        return TrackReader(dict(self.options))


def read_tracks(spark: SparkSession, path: str, attributes: bool = False, parts: int | None = None, index: DataFrame | None = None, step: int = STEP) -> DataFrame:
    """file, object_id, seq, x, y, z (and scalars, properties) of TrackVis files of any size.
    ``index``: a written offset index; without one it is built first."""
    if index is None or not hasattr(index, "written_at"):
        index = runtime.materialize(build_offset_index(spark, path, step) if index is None else index, "track-index")
    spark.dataSource.register(TrackSource)
    read = spark.read.format("tracks").option("index", index.written_at).option("attributes", str(attributes).lower())
    return (read if parts is None else read.option("parts", str(parts))).load(path)


# -- LAS ----------------------------------------------------------------------------


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Range]:
        out, heads = [], []
        for name in files(self.options["path"]):
            system, at = located(name)
            with system.open_input_file(at) as file:
                heads.append((name, las_header(file.read_at(min(375, file.size()), 0))))
        total = sum(h["count"] for _, h in heads)
        parts = int(self.options["parts"]) if "parts" in self.options else None
        each = int(self.options.get("rows", LAS_ROWS)) if parts is None else max(1, -(-total // parts))
        for name, h in heads:
            out += [Range(name, a, min(a + each, h["count"]), a) for a in range(0, h["count"], each)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        system, at = located(part.file)
        with system.open_input_file(at) as file:
            head = las_header(file.read_at(min(375, file.size()), 0))
            for a in range(part.begin, part.end, BATCH):
                n = min(BATCH, part.end - a)
                made = las_columns(file.read_at(n * head["width"], head["start"] + a * head["width"]), head, n)
                out = {"file": pa.array([part.file] * n, pa.string()), "vertex_id": pa.array(np.arange(a, a + n))}
                for c in [x.split()[0] for x in LAS.split(", ")][2:]:
                    out[c] = pa.array(made[c].astype(float)) if c in made else pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_pydict(out)


class LasSource(DataSource):
    """LAS files by ranges of points."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return LAS

    def reader(self, schema) -> DataSourceReader:
        return LasReader(dict(self.options))


def read_las_parts(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """The columns of ``binary.read_las``, of files of any size."""
    spark.dataSource.register(LasSource)
    read = spark.read.format("las")
    return (read if parts is None else read.option("parts", str(parts))).load(path)
