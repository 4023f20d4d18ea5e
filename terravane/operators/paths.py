"""Ordered paths (object_id, seq, x, y, z): measures, runs by chunk, thinning, simplification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions.vec3 import cells, norm, sub, vec
from terravane.plans import runtime
from terravane.plans.rows import side_by_side

CHUNK = ["cx", "cy", "cz"]


def ordered():
    """The window along each object."""
    return Window.partitionBy("object_id").orderBy("seq")


def steps(path: DataFrame) -> DataFrame:
    """Each vertex with ``step``, the distance from its predecessor (0 for the first)."""
    before = {f"p{a}": F.lag(a).over(ordered()) for a in "xyz"}
    apart = norm(sub(vec(), vec("p")))
    return path.withColumns(before).withColumn("step", F.coalesce(apart, F.lit(0.0))).drop("px", "py", "pz")


def lengths(path: DataFrame) -> DataFrame:
    """object_id, n, length: summed distances between consecutive vertices."""
    return steps(path).groupBy("object_id").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("length"))


def segments(path: DataFrame) -> DataFrame:
    """Consecutive vertex pairs as line segments: object_id, seq, x0, y0, z0, x1, y1, z1."""
    after = path.withColumns({f"{a}1": F.lead(a).over(ordered()) for a in "xyz"}).where("x1 IS NOT NULL")
    return after.select("object_id", "seq", *[F.col(a).alias(f"{a}0") for a in "xyz"], "x1", "y1", "z1")


def line_lengths(lines: DataFrame, drop_zero: bool = False) -> DataFrame:
    """Line segments with ``length``; optionally without those shorter than 1e-9."""
    out = lines.withColumn("length", norm(sub(vec(suffix="1"), vec(suffix="0"))))
    return out.where("length >= 1e-9") if drop_zero else out


def endpoints(path: DataFrame) -> DataFrame:
    """First and last vertex of each object, by one aggregate."""
    point = F.struct("x", "y", "z")
    both = path.groupBy("object_id").agg(F.min_by(point, "seq").alias("a"), F.max_by(point, "seq").alias("b"))
    return both.select("object_id", *[F.col(f"{p}.{a}").alias(f"{a}{k}") for k, p in enumerate("ab") for a in "xyz"])


def ranked(path: DataFrame) -> DataFrame:
    """Vertices with their place ``i`` in the object and the object's size ``n``."""
    whole = Window.partitionBy("object_id")
    return path.withColumns({"i": (F.row_number().over(ordered()) - 1).cast("long"), "n": F.count(F.lit(1)).over(whole)})


def representatives(path: DataFrame) -> DataFrame:
    """The vertex at place n // 2 of each object."""
    return ranked(path).where("i = n div 2").select("object_id", "seq", "x", "y", "z")


def decimate(path: DataFrame, stride: int) -> DataFrame:
    """Every stride-th vertex and the last one; all of them for n <= 2 or stride <= 1."""
    if stride <= 1:
        return path
    return ranked(path).where(f"n <= 2 OR i % {stride} = 0 OR i = n - 1").drop("i", "n")


def runs(path: DataFrame, shape: tuple, meta: str | None = None) -> DataFrame:
    """Vertices with chunk cx, cy, cz and run, the number of their maximal stretch in one
    chunk; with ``meta`` also pos, their place in the run once repeats of meta collapse."""
    placed = path.withColumns(cells(shape, "c"))
    moved = F.coalesce(F.struct(*CHUNK) != F.lag(F.struct(*CHUNK)).over(ordered()), F.lit(False)).cast("long")
    out = placed.withColumn("run", F.sum(moved).over(ordered()))
    if meta:
        inside = Window.partitionBy("object_id", "run").orderBy("seq")
        new = F.coalesce(F.col(meta) != F.lag(meta).over(inside), F.lit(False)).cast("long")
        out = out.withColumn("pos", F.sum(new).over(inside))
    return out


def collapsed_runs(path: DataFrame, shape: tuple, meta: str) -> DataFrame:
    """object_id, run, members: each run's metavertices, consecutive repeats once."""
    placed = runs(path, shape, meta)
    one = placed.groupBy("object_id", "run", "pos").agg(F.first(meta).alias("m"))
    return one.groupBy("object_id", "run").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("members"))


def fragments(path: DataFrame, shape: tuple) -> DataFrame:
    """One row per run: object_id, run, chunk, n, first_seq and its place (fragment) in the chunk."""
    each = runs(path, shape).groupBy("object_id", "run", *CHUNK).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    place = Window.partitionBy(*CHUNK).orderBy("object_id", "run")
    return each.withColumn("fragment", (F.row_number().over(place) - 1).cast("long"))


def fragment_starts(parts: DataFrame) -> DataFrame:
    """Fragments with ``start``: the vertices before them in their chunk."""
    before = Window.partitionBy(*CHUNK).orderBy("fragment").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def manifests(parts: DataFrame) -> DataFrame:
    """object_id and its ordered list of (chunk, fragment)."""
    item = F.struct("run", *CHUNK, "fragment")
    listed = F.transform(F.sort_array(F.collect_list(item)), lambda s: F.struct(s["cx"], s["cy"], s["cz"], s["fragment"]))
    return parts.groupBy("object_id").agg(listed.alias("manifest"))


def cross_links(path: DataFrame, shape: tuple) -> DataFrame:
    """Consecutive vertices in different chunks: object_id, seq0, seq1 and the chunk step."""
    placed = path.withColumns(cells(shape, "c"))
    after = {"seq1": F.lead("seq").over(ordered())} | {f"n{a}": F.lead(f"c{a}").over(ordered()) for a in "xyz"}
    both = placed.withColumns(after).where("seq1 IS NOT NULL AND NOT (nx = cx AND ny = cy AND nz = cz)")
    return both.select("object_id", F.col("seq").alias("seq0"), "seq1", *[(F.col(f"n{a}") - F.col(f"c{a}")).alias(f"d{a}") for a in "xyz"])


def link_cells(path: DataFrame, shape: tuple) -> DataFrame:
    """The distinct unordered pairs of chunks that a cross link joins: ax, ay, az, ox, oy, oz."""
    placed = path.withColumns(cells(shape, "c"))
    here, there = F.struct(*CHUNK), F.struct(*[F.lead(c).over(ordered()).alias(c) for c in CHUNK])
    both = placed.select(here.alias("h"), there.alias("t")).where("t.cx IS NOT NULL AND h <> t")
    pair = both.select(F.least("h", "t").alias("a"), F.greatest("h", "t").alias("b")).distinct()
    return pair.select(*[F.col(f"{s}.{c}").alias(f"{to}{c[1]}") for s, to in (("a", "a"), ("b", "o")) for c in CHUNK])


def read_chunks(path: DataFrame, shape: tuple, chunks: list[tuple]) -> DataFrame:
    """Vertices in the listed chunks; contiguous surviving stretches become paths of
    their own: object_id, part, seq, x, y, z."""
    placed = path.withColumns(cells(shape, "c"))
    keep = F.struct(*CHUNK).isin([F.struct(*[F.lit(int(v)).cast("long").alias(c) for c, v in zip(CHUNK, k, strict=True)]) for k in chunks])
    flagged = placed.withColumn("keep", keep)
    broke = (~F.coalesce(F.lag("keep").over(ordered()), F.lit(False)) & F.col("keep")).cast("long")
    return flagged.withColumn("part", F.sum(broke).over(ordered()) - 1).where("keep").select("object_id", "part", "seq", "x", "y", "z")


def subsample(path: DataFrame, shape: tuple, most: int, by: str = "longest") -> DataFrame:
    """The objects kept when each bin (of the middle vertex) keeps ``most`` of them:
    those with most vertices (the larger id among equals), or the first by id."""
    middle = ranked(path).where("i = n div 2").withColumns(cells(shape))
    order = [F.desc("n"), F.desc("object_id")] if by == "longest" else [F.asc("object_id")]
    place = F.row_number().over(Window.partitionBy("gx", "gy", "gz").orderBy(*order))
    return middle.withColumn("place", place).where(F.col("place") <= most).select("object_id")


def _apart(p, a, b) -> np.ndarray:
    """Squared distances of points from the span a-b."""
    d, q = b - a, p - a
    square = sum(d[k] * d[k] for k in range(len(d)))
    along = sum(d[k] * q[:, k] for k in range(len(d)))
    t = np.zeros(len(p)) if square < 1e-30 else np.minimum(1.0, np.maximum(0.0, along / square))
    return sum((q[:, k] - t * d[k]) ** 2 for k in range(len(d)))


def _kept(points: np.ndarray, epsilon: float) -> list[int]:
    """Places of the inner points that stay, of a span's points with both ends."""
    keep, todo = [], [(0, len(points) - 1)]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        apart = _apart(points[low + 1 : high], points[low], points[high])
        at = int(apart.argmax())
        if apart[at] > epsilon * epsilon:
            keep.append(low + 1 + at)
            todo += [(low, low + 1 + at), (low + 1 + at, high)]
    return sorted(keep)


def _finish(epsilon: float, dims: str):
    """Kernel over rows sorted by span: the inner vertices that stay, span by span.  A span
    that a batch cuts waits for the rest of it, so at most one is held besides a batch."""
    names = [f"p{c}" for c in dims]
    ends = [[f"{e}{c}" for c in dims] for e in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def spans(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            objects, lows = table.column("object_id").combine_chunks(), table.column("lo").to_numpy()
            alike = pc.or_(pc.equal(objects[1:], objects[:-1]).fill_null(False), pc.and_(objects[1:].is_null(), objects[:-1].is_null()))
            new = np.flatnonzero((lows[1:] != lows[:-1]) | ~alike.to_numpy(zero_copy_only=False)) + 1
            cuts = [0, *new.tolist(), table.num_rows]
            points = np.column_stack([table.column(c).to_numpy() for c in names])
            first, second = (np.column_stack([table.column(c).to_numpy() for c in e]) for e in ends)
            stay = [a - 1 + k for a, b in zip(cuts[: -1 if last else -2], cuts[1:], strict=False) for k in _kept(np.vstack([first[a], points[a:b], second[a]]), epsilon)]
            yield from table.select(["object_id", "i"]).take(pa.array(stay, pa.int64())).to_batches()
            yield table.slice(cuts[-1 if last else -2])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if table.num_rows:
                *done, held = spans(table, False)
                yield from done
        if held is not None and held.num_rows:
            yield from list(spans(held, True))[:-1]

    return run


def simplify(path: DataFrame, epsilon: float, dims: str = "xyz", whole: int = 16_384) -> DataFrame:
    """Douglas-Peucker.  Spans of at most ``whole`` vertices are finished by one task each;
    longer ones are split in rounds, all of them at once, each at its farthest vertex (the
    first among equals) if that is more than epsilon away.

    A vertex carries its span and the span's ends, so a round reads each open vertex once
    and joins it with its span's split; vertices of settled spans take no further part."""
    points = ranked(path).select("object_id", "i", "n", F.struct(*[F.col(a).cast("double").alias(a) for a in dims]).alias("p"))
    ends = points.groupBy("object_id").agg(F.min_by("p", "i").alias("a"), F.max_by("p", "i").alias("b"))
    kept = points.where("i = 0 OR i = n - 1").select("object_id", "i")
    inner = points.where("i > 0 AND i < n - 1").join(ends, "object_id")
    open_ = runtime.materialize(inner.select("object_id", "i", "p", F.lit(0).cast("long").alias("lo"), (F.col("n") - 1).alias("hi"), "a", "b"), "paths")
    d = {c: F.col(f"b.{c}") - F.col(f"a.{c}") for c in dims}
    q = {c: F.col(f"p.{c}") - F.col(f"a.{c}") for c in dims}
    square = sum(d[c] * d[c] for c in dims)
    t = F.when(square < 1e-30, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum(d[c] * q[c] for c in dims) / square)))
    apart = sum((q[c] - t * d[c]) * (q[c] - t * d[c]) for c in dims)
    flat = [F.col(f"{e}.{c}").alias(f"{e}{c}") for e in "pab" for c in dims]
    kind = path.schema["object_id"].dataType.simpleString()
    while True:
        small = open_.where(F.col("hi") - F.col("lo") <= whole).select("object_id", "i", "lo", *flat)
        sorted_ = small.repartition("object_id", "lo").sortWithinPartitions("object_id", "lo", "i")
        kept = kept.union(sorted_.mapInArrow(_finish(epsilon, dims), f"object_id {kind}, i long"))
        large = open_.where(F.col("hi") - F.col("lo") > whole)
        if large.isEmpty():
            return ranked(path).join(kept, ["object_id", "i"], "left_semi").drop("i", "n")
        far = large.groupBy("object_id", "lo").agg(F.max(F.struct(apart.alias("d"), (-F.col("i")).alias("m"), F.col("p"))).alias("f"))
        far = far.where(F.col("f.d") > epsilon * epsilon).select("object_id", "lo", (-F.col("f.m")).alias("at"), F.col("f.p").alias("mid"))
        cut = runtime.materialize(far, "splits")
        kept = kept.union(cut.select("object_id", F.col("at").alias("i")))
        after = F.col("i") > F.col("at")
        of = {"lo": ("at", "lo"), "hi": ("hi", "at"), "a": ("mid", "a"), "b": ("b", "mid")}
        split = large.join(cut, ["object_id", "lo"]).where("i <> at")
        open_ = runtime.materialize(split.select("object_id", "i", "p", *[F.when(after, F.col(x)).otherwise(F.col(y)).alias(n) for n, (x, y) in of.items()]), "paths")


def coarsen(path: DataFrame, epsilon: float | None = None, shape: tuple | None = None, most: int = 1, by: str = "longest", least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(paths, one row of figures): simplified, if epsilon is given, without those left with
    fewer than ``least`` vertices; then thinned to ``most`` a bin, if a shape is given.
    Figures: vertices, paths, simplification_ratio and subsampling_ratio (before / after)."""
    now = path
    if epsilon is not None:
        now = simplify(now, epsilon)
        whole = now.groupBy("object_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        now = now.join(whole.select("object_id"), "object_id", "left_semi")
    thin = now if shape is None else now.join(subsample(now, shape, most, by), "object_id", "left_semi")
    sizes = [d.agg(F.count(F.lit(1)).alias(f"v{k}"), F.count_distinct("object_id").alias(f"o{k}")) for k, d in enumerate((path, now, thin))]
    one = side_by_side(*sizes)
    ratio = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    figures = one.select(F.col("v2").alias("vertices"), F.col("o2").alias("paths"), ratio("v0", "v1").alias("simplification_ratio"), ratio("o1", "o2").alias("subsampling_ratio"))
    return thin, figures
