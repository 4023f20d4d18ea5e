"""Rooted forests as (vertex_id, parent) with parent -1 at roots.

A tree that fits a task (``plans.whole.MOST`` vertices) is solved in it, many trees a
batch: whole objects where the table has an ``object_id``, else the table if it is as
small as that.  Larger ones take rounds of pointer doubling over written tables; both
ways give the same results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.plans import runtime, whole


def rooted(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """vertex_id, parent from (child, parent) edges; the last edge of a child wins."""
    last = edges.groupBy(F.col("child").alias("vertex_id")).agg(F.max_by("parent", order).alias("parent"))
    tops = edges.select(F.col("parent").alias("vertex_id")).distinct().join(last, "vertex_id", "left_anti")
    return last.union(tops.select("vertex_id", F.lit(-1).cast("long")))


def child_counts(tree: DataFrame) -> DataFrame:
    """vertex_id, children for every vertex."""
    n = tree.where("parent >= 0").groupBy("parent").agg(F.count(F.lit(1)).alias("c"))
    return tree.join(n.withColumnRenamed("parent", "p"), F.col("vertex_id") == F.col("p"), "left").select(
        "vertex_id", F.coalesce("c", F.lit(0)).cast("long").alias("children")
    )


def kinds(tree: DataFrame) -> DataFrame:
    """vertex_id, kind: 0 root, 1 branch (two children or more), 2 continuation, 3 end."""
    n = tree.join(child_counts(tree), "vertex_id")
    kind = F.when(F.col("parent") < 0, 0).when(F.col("children") >= 2, 1).when(F.col("children") == 1, 2).otherwise(3)
    return n.select("vertex_id", kind.cast("long").alias("kind"))


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted id stands in ``ids``; -1 for those that do not."""
    order = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids[order], wanted), len(ids) - 1)
    return np.where(ids[order][at] == wanted, order[at], -1)


def _climbed(up: np.ndarray, hops: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers doubled until each has met a stop: (where, hops)."""
    up, hops, stop = up.copy(), hops.copy(), stop.copy()
    for _ in range(64):
        open_ = np.flatnonzero(~stop)
        if not len(open_):
            return up, hops
        ahead = up[open_]
        hops[open_], up[open_], stop[open_] = hops[open_] + hops[ahead], up[ahead], stop[ahead]
    raise RuntimeError("the parents hold a cycle")


def _nearest(rows: pa.Table) -> pa.Table:
    """Kernel of ``nearest_marked`` over whole trees."""
    ids, parent, marked = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("vertex_id", "parent", "marked"))
    at = _places(ids, parent)
    known = (parent < 0) | (at >= 0)  # a vertex whose way ends at an absent parent has no answer
    stop = (parent < 0) | ~known | marked.astype(bool)[at]
    # the last vertex before the stop, and the steps to it; the stop itself is its parent
    last, hops = _climbed(np.where(stop, np.arange(len(ids)), at), np.where(stop, 0, 1), stop)
    good = known[last]
    hops = hops + (parent[last] >= 0)
    return pa.table({"vertex_id": ids[good], "anchor": parent[last][good], "hops": hops[good].astype(np.int64)})


def nearest_marked(tree: DataFrame, marked: DataFrame, rounds: int = 64) -> DataFrame:
    """vertex_id, anchor, hops: the nearest marked vertex strictly above each vertex.
    Vertices without one have anchor -1 and the hops to their root."""
    small, large = whole.split(tree.select(*[c for c in ("object_id", "vertex_id", "parent") if c in tree.columns]))
    out = None
    if small is not None:
        flagged = small.join(marked.select("vertex_id", F.lit(True).alias("marked")).distinct(), "vertex_id", "left")
        out = whole.solve(flagged.select("object_id", "vertex_id", "parent", F.coalesce("marked", F.lit(False)).alias("marked")), _nearest, "vertex_id long, anchor long, hops long")
    if large is not None:
        doubled = _by_doubling(large, marked, rounds)
        out = doubled if out is None else out.union(doubled)
    return out


def _by_doubling(tree: DataFrame, marked: DataFrame, rounds: int = 64) -> DataFrame:
    """A round for each power of two of the longest gap."""
    flag = marked.select(F.col("vertex_id").alias("up"), F.lit(True).alias("stop"))
    start = tree.select("vertex_id", F.col("parent").alias("up"), F.when(F.col("parent") < 0, 0).otherwise(1).cast("long").alias("hops"))
    now = runtime.materialize(
        start.join(flag, "up", "left").select("vertex_id", "up", "hops", (F.coalesce("stop", F.lit(False)) | (F.col("up") < 0)).alias("stop")), "doubling"
    )
    for _ in range(rounds):
        if now.where("NOT stop").isEmpty():
            break
        # an unfinished pointer leads to a vertex whose own pointer continues the way
        ahead = now.select(F.col("vertex_id").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("stop").alias("stop2"))
        open_, done = now.where("NOT stop"), now.where("stop")
        jump = open_.join(ahead, "up").select("vertex_id", F.col("up2").alias("up"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("stop2").alias("stop"))
        past, now = now, runtime.materialize(done.union(jump), "doubling")
        runtime.forget(past)
    else:
        raise RuntimeError("the parents hold a cycle")
    return now.select("vertex_id", F.col("up").alias("anchor"), "hops")


def depths(tree: DataFrame) -> DataFrame:
    """vertex_id, depth (roots 0), by pointer doubling."""
    none = tree.where("false").select("vertex_id")
    return nearest_marked(tree, none).select("vertex_id", F.col("hops").alias("depth"))


def _orders(rows: pa.Table) -> pa.Table:
    """Kernel of ``strahler`` over whole trees: depth by depth, the deepest first."""
    ids, parent = (rows.column(c).to_numpy() for c in ("vertex_id", "parent"))
    at = _places(ids, parent)
    top = at < 0
    depth = _climbed(np.where(top, np.arange(len(ids)), at), np.where(top, 0, 1), top)[1]
    best, twice = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    order = np.argsort(-depth, kind="stable")
    for here in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        best[here] = np.where(best[here] == 0, 1, best[here] + twice[here])
        mine = here[~top[here]]
        np.maximum.at(best, at[mine], best[mine])
        above, n = np.unique(at[mine[best[mine] == best[at[mine]]]], return_counts=True)
        twice[above] = n > 1
    return pa.table({"vertex_id": ids, "strahler": best})


def strahler(tree: DataFrame) -> DataFrame:
    """vertex_id, strahler: 1 at ends; else the children's maximum, plus one if two or
    more children share it."""
    small, large = whole.split(tree.select(*[c for c in ("object_id", "vertex_id", "parent") if c in tree.columns]))
    out = whole.solve(small, _orders, "vertex_id long, strahler long") if small is not None else None
    if large is not None:
        rounds = _strahler_by_anchors(large)
        out = rounds if out is None else out.union(rounds)
    return out


def _strahler_by_anchors(tree: DataFrame) -> DataFrame:
    """A vertex with one child has its child's number, so only ends, branching vertices and
    roots are worked out, from the deepest of these up: as many rounds as branching
    vertices follow each other."""
    tree = tree.select("vertex_id", "parent")
    fixed = runtime.materialize(anchors(tree), "strahler-anchors")
    few = runtime.materialize(collapse(tree, fixed), "strahler-tree")
    done = runtime.materialize(_strahler_by_level(few), "strahler-done")
    inner = tree.join(fixed, "vertex_id", "left_anti")
    below = nearest_below(tree, fixed, inner).select("vertex_id", F.col("object_id").alias("low"))
    chained = below.join(done.select(F.col("vertex_id").alias("low"), "strahler"), "low").select("vertex_id", "strahler")
    return done.union(runtime.materialize(chained, "strahler-chained"))


def _strahler_by_level(tree: DataFrame) -> DataFrame:
    tree = tree.select("vertex_id", "parent")
    deep = runtime.materialize(tree.join(depths(tree), "vertex_id").join(child_counts(tree), "vertex_id"), "strahler")
    top = deep.agg(F.max("depth")).first()[0]
    done = None
    for level in range(top if top is not None else -1, -1, -1):
        here = deep.where(F.col("depth") == level)
        ends = here.where("children = 0").select("vertex_id", "parent", F.lit(1).cast("long").alias("strahler"))
        if done is None:
            now = ends
        else:
            order = below.groupBy("parent", "strahler").agg(F.count(F.lit(1)).alias("n"))
            most = order.groupBy("parent").agg(F.max(F.struct("strahler", "n")).alias("m"))
            value = F.col("m.strahler") + (F.col("m.n") >= 2).cast("long")
            inner = here.where("children > 0").join(most.withColumnRenamed("parent", "v"), F.col("vertex_id") == F.col("v"))
            now = ends.union(inner.select("vertex_id", "parent", value.alias("strahler")))
        below = runtime.materialize(now, "strahler-level")
        done = below if done is None else done.union(below)
        if level % 16 == 0:  # keeps the plan of a deep tree short
            done = runtime.materialize(done, "strahler-done")
    if done is None:
        return tree.select("vertex_id", F.lit(0).cast("long").alias("strahler"))
    return done.select("vertex_id", "strahler")


def anchors(tree: DataFrame) -> DataFrame:
    """Roots, ends and branching vertices: all but those with one parent and one child."""
    return kinds(tree).where("kind <> 2").select("vertex_id")


def anchor_distance(tree: DataFrame) -> DataFrame:
    """vertex_id, anchor, hops: anchors themselves at 0 hops, others to the nearest above."""
    fixed = runtime.materialize(anchors(tree), "anchors")
    up = nearest_marked(tree, fixed).join(fixed.withColumn("own", F.lit(True)), "vertex_id", "left")
    return up.select(
        "vertex_id", F.when(F.col("own"), F.col("vertex_id")).otherwise(F.col("anchor")).alias("anchor"), F.when(F.col("own"), 0).otherwise(F.col("hops")).cast("long").alias("hops")
    )


def decimated(tree: DataFrame, stride: int, forced: DataFrame | None = None) -> DataFrame:
    """The vertices kept: anchors, every stride-th vertex below an anchor (none for a
    stride of 1 or less), and the forced ones."""
    far = anchor_distance(tree)
    keep = far.where("hops = 0" if stride <= 1 else f"hops % {stride} = 0").select("vertex_id")
    return keep if forced is None else keep.union(forced.select("vertex_id")).distinct()


def collapse(tree: DataFrame, kept: DataFrame, attributes: dict[str, str] | None = None, values: DataFrame | None = None) -> DataFrame:
    """The kept vertices with their nearest kept ancestor as parent; attributes (name ->
    max, min, mean, sum or first) are taken over each vertex and those it stands for."""
    kept = runtime.materialize(kept.select("vertex_id").distinct(), "kept")
    up = runtime.materialize(nearest_marked(tree, kept), "kept-above")
    out = up.join(kept, "vertex_id", "left_semi").select("vertex_id", F.col("anchor").alias("parent"))
    if not attributes:
        return out
    rules = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}
    owner = up.join(kept.withColumn("own", F.lit(True)), "vertex_id", "left").select("vertex_id", F.when(F.col("own"), F.col("vertex_id")).otherwise(F.col("anchor")).alias("owner"))
    made = [F.min_by(c, "vertex_id").alias(c) if r == "first" else rules[r](c).alias(c) for c, r in attributes.items()]
    gathered = values.join(owner, "vertex_id").groupBy("owner").agg(*made)
    return out.join(gathered.withColumnRenamed("owner", "vertex_id"), "vertex_id", "left")


def simplify(tree: DataFrame, positions: DataFrame, tolerance: float) -> DataFrame:
    """The vertices kept by Douglas-Peucker on each chain between anchors; anchors stay."""
    from terravane.operators import paths

    fixed = runtime.materialize(anchors(tree), "anchors")
    up = runtime.materialize(nearest_marked(tree, fixed), "chains")
    # a chain is named by its lower anchor; its vertices climb from there to the upper one
    above = up.join(fixed, "vertex_id", "left_semi").where("anchor >= 0").select(F.col("vertex_id").alias("object_id"), "anchor", F.col("hops").alias("n"))
    parent = tree.select("vertex_id", "parent")
    walk = above.select("object_id", F.col("object_id").alias("vertex_id"), "n", F.lit(0).cast("long").alias("seq"))
    inner = up.join(fixed, "vertex_id", "left_anti")
    child = parent.join(inner.select("vertex_id"), "vertex_id", "left_semi")
    lower = nearest_below(parent, fixed, child)
    chain = lower.join(up.select("vertex_id", "hops"), "vertex_id").join(above.select("object_id", "n"), "object_id")
    rows = chain.select("object_id", "vertex_id", (F.col("n") - F.col("hops")).alias("seq"))
    rows = rows.union(walk.select("object_id", "vertex_id", "seq")).union(above.select("object_id", F.col("anchor").alias("vertex_id"), F.col("n").alias("seq")))
    placed = runtime.materialize(rows.join(positions.select("vertex_id", "x", "y", "z"), "vertex_id"), "chain-points")
    return paths.simplify(placed, tolerance).select("vertex_id").union(fixed).distinct()


def _lower(rows: pa.Table) -> pa.Table:
    """Kernel of ``nearest_below`` over whole trees."""
    ids, parent, fixed, inner = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("vertex_id", "parent", "fixed", "inner"))
    at = _places(ids, parent)
    has = np.flatnonzero(at >= 0)
    has = has[inner.astype(bool)[at[has]]]
    down = np.full(len(ids), -1)
    down[at[has]] = has
    start = np.flatnonzero(down >= 0)
    stop = fixed.astype(bool) | (down < 0)
    to = _climbed(np.where(stop, np.arange(len(ids)), down), np.where(stop, 0, 1), stop)[0]
    return pa.table({"object_id": ids[to[start]], "vertex_id": ids[start]})


def nearest_below(parent: DataFrame, fixed: DataFrame, inner: DataFrame) -> DataFrame:
    """object_id, vertex_id: for each continuation vertex the anchor that ends its chain below."""
    small, large = whole.split(parent.select("vertex_id", "parent"))
    if small is None:
        return _below_by_doubling(large, fixed, inner)
    flag = lambda df, name: df.select("vertex_id", F.lit(True).alias(name)).distinct()
    flagged = small.join(flag(fixed, "fixed"), "vertex_id", "left").join(flag(inner, "inner"), "vertex_id", "left").fillna(False, ["fixed", "inner"])
    return whole.solve(flagged.select("object_id", "vertex_id", "parent", "fixed", "inner"), _lower, "object_id long, vertex_id long")


def _below_by_doubling(parent: DataFrame, fixed: DataFrame, inner: DataFrame) -> DataFrame:
    """By doubling along only children."""
    only = parent.where("parent >= 0").join(inner.select(F.col("vertex_id").alias("parent")), "parent", "left_semi")
    down = only.select(F.col("parent").alias("vertex_id"), F.col("vertex_id").alias("to"))
    stop = fixed.select(F.col("vertex_id").alias("to"), F.lit(True).alias("stop"))
    now = runtime.materialize(down.join(stop, "to", "left").select("vertex_id", "to", F.coalesce("stop", F.lit(False)).alias("stop")), "below")
    while not now.where("NOT stop").isEmpty():
        ahead = now.select(F.col("vertex_id").alias("to"), F.col("to").alias("to2"), F.col("stop").alias("stop2"))
        jump = now.where("NOT stop").join(ahead, "to").select("vertex_id", F.col("to2").alias("to"), F.col("stop2").alias("stop"))
        past, now = now, runtime.materialize(now.where("stop").union(jump), "below")
        runtime.forget(past)
    return now.select(F.col("to").alias("object_id"), "vertex_id")
