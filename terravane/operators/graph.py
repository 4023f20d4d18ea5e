"""Graphs as edge tables (v0, v1, optional weight): search, components, cores, communities.

Iterative algorithms advance a whole frontier per round; each round's state is a
written table, and only counts come back to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from terravane.operators import communities, filters
from terravane.plans import components as stars
from terravane.plans import numbering, runtime
from terravane.plans.rows import side_by_side


#: Links (both directions count) of a block of vertices, which a task relaxes until it settles,
#: and rounds after which what they reached is put together.
BLOCK, ROUNDS = 1 << 20, 8
REACHED = "half int, vertex_id long, cost double, hops long, sent boolean"


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(1.0))


def adjacency(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """a, b, w: every edge in both directions; repeated edges stay, a loop is listed twice."""
    w = _weight(weight)
    return edges.select(F.col("v0").alias("a"), F.col("v1").alias("b"), w.alias("w")).union(
        edges.select(F.col("v1").alias("a"), F.col("v0").alias("b"), w.alias("w"))
    )


def degrees(edges: DataFrame, simple: bool = False) -> DataFrame:
    """vertex_id, degree; with ``simple`` repeated edges count once and loops not at all."""
    both = adjacency(edges).select("a", "b")
    if simple:
        both = both.where("a <> b").distinct()
    return both.groupBy(F.col("a").alias("vertex_id")).agg(F.count(F.lit(1)).alias("degree"))


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """vertex_id, component: the least vertex of each component (isolated ones too, if
    ``vertices`` is given)."""
    found = stars.connected_components(edges, "v0", "v1").select(F.col("node").alias("vertex_id"), "component")
    if vertices is None:
        return found
    return vertices.select("vertex_id").join(found, "vertex_id", "left").select("vertex_id", F.coalesce("component", "vertex_id").alias("component"))


def within_bbox(vertices: DataFrame, edges: DataFrame, low: tuple, high: tuple) -> tuple[DataFrame, DataFrame]:
    """(vertices in the closed box, edges both of whose ends are among them)."""
    kept = filters.by_bbox(vertices, low, high)
    return kept, filters.edges_within(edges, kept)


def sizes(labels: DataFrame, label: str = "component") -> DataFrame:
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _known(both: DataFrame, source: int) -> None:
    if both.where(F.col("a") == source).isEmpty():
        raise ValueError(f"no edge has vertex {source}")


def bfs(edges: DataFrame, source: int, max_distance: int | None = None) -> DataFrame:
    """vertex_id, distance, predecessor (the least of those one step nearer; -1 at the source).
    A source that no edge has raises ValueError, here and in the searches below."""
    best, both = _relaxed(edges, source, None, max_distance)
    near = best.select(F.col("vertex_id").alias("a"), F.col("cost").alias("ca"))
    far = best.select(F.col("vertex_id").alias("b"), F.col("cost").alias("cb"))
    before = both.join(near, "a").join(far, "b").where("ca + 1 = cb").groupBy(F.col("b").alias("vertex_id")).agg(F.min("a").alias("predecessor"))
    found = best.join(before, "vertex_id", "left")
    return found.select("vertex_id", F.col("cost").cast("long").alias("distance"), F.coalesce("predecessor", F.lit(-1)).cast("long").alias("predecessor"))


def _least(at: np.ndarray, cost: np.ndarray, hops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each place once, with its least (cost, hops)."""
    order = np.lexsort((hops, cost, at))
    at = at[order]
    first = order[np.flatnonzero(np.diff(at, prepend=-1))]
    return at[np.flatnonzero(np.diff(at, prepend=-1))], cost[first], hops[first]


def _settled(lows: np.ndarray, names: np.ndarray, most: float, reached: float) -> Callable:
    """The kernel of a block: its links and what is known of its vertices to what improves of
    them, and to the least offers to vertices of other blocks."""

    def settle(links: pa.Table, known: pa.Table) -> pa.Table:
        a, b, w, h = (links.column(c).to_numpy() for c in ("a", "b", "w", "h"))
        order = np.argsort(a, kind="stable")
        b, w, h = b[order], w[order], h[order]
        ids, begin = np.unique(a[order], return_index=True)
        n, begin = len(ids), np.append(begin, len(a))
        at = np.minimum(np.searchsorted(ids, b), max(0, n - 1))
        away = ids[at] != b if n else np.zeros(0, bool)
        others, slot = np.unique(b[away], return_inverse=True)
        at[away] = n + slot.ravel()
        cost, hops, changed = np.full(n + len(others), np.inf), np.zeros(n + len(others), np.int64), np.zeros(n + len(others), bool)

        def offer(to: np.ndarray, c: np.ndarray, k: np.ndarray) -> np.ndarray:
            to, c, k = _least(to, c, k)
            better = (c < cost[to]) | ((c == cost[to]) & (k < hops[to]))
            to = to[better]
            cost[to], hops[to] = c[better], k[better]
            return to

        place, c, k, fresh = (known.column(x).to_numpy() for x in ("vertex_id", "cost", "hops", "fresh"))
        place = np.searchsorted(ids, place)
        offer(place[~fresh], c[~fresh], k[~fresh])
        front = offer(place[fresh], c[fresh], k[fresh])
        while len(front):
            size = begin[front + 1] - begin[front]
            e = np.repeat(begin[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            c, k = np.repeat(cost[front], size) + w[e], np.repeat(hops[front] + 1, size)
            worth = (c <= most) & (c + h[e] <= reached)
            to = offer(at[e[worth]], c[worth], k[worth])
            changed[to] = True
            front = to[to < n]
        mine, theirs = np.flatnonzero(changed[:n]), n + np.flatnonzero(changed[n:])
        vertex = np.concatenate([ids[mine], others[theirs - n]])
        half = names[np.searchsorted(lows, vertex, "right") - 1]
        both = np.concatenate([mine, theirs])
        columns = [pa.array(half, pa.int32()), pa.array(vertex, pa.int64()), pa.array(cost[both]), pa.array(hops[both], pa.int64()), pa.array(both >= n)]
        return pa.Table.from_arrays(columns, names=[c.split()[0] for c in REACHED.split(", ")])

    return settle


def _relaxed(edges: DataFrame, source: int, weight: str | None, max_distance: float | None = None, target: int | None = None, bound: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertex_id, cost, hops; a, b, w): least sums of non-negative weights from the source,
    with the fewest edges among these.  Vertices with neighbouring ids make blocks of about
    ``BLOCK`` links; a round takes the blocks that got offers, each in a task that relaxes
    it until nothing in it improves, so rounds follow the blocks a path passes and not its
    edges.  Every other round blocks begin half a block later, so what one round cuts apart
    lies together in the next.  With a target, offers that cannot beat its cost so far are dropped: ``bound``
    (vertex_id, h) gives a lower bound of each vertex's distance to it."""
    both = adjacency(edges, weight).where("a IS NOT NULL AND b IS NOT NULL").groupBy(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).agg(F.min("w").alias("w"))
    both = runtime.materialize(both, "sssp-edges")
    _known(both, source)
    links = both.withColumn("h", F.lit(0.0))
    if bound is not None:
        links = both.join(bound.select(F.col("vertex_id").alias("b"), F.col("h").cast("double").alias("h")), "b", "left").withColumn("h", F.coalesce("h", F.lit(0.0)))
    links = links.repartitionByRange(2 * runtime.parts_for(both.count(), BLOCK), "a").withColumn("half", F.spark_partition_id())
    links = runtime.materialize(links, "sssp-blocks")
    halves = links.groupBy("half").agg(F.min("a").alias("low")).orderBy("low").collect()  # two rows a block
    lows, names = (np.array([r[c] for r in halves], np.int64) for c in ("low", "half"))
    active = [int(names[np.searchsorted(lows, source, "right") - 1])]
    most, reached = np.inf if max_distance is None else float(max_distance), 0.0 if source == target else np.inf
    past, fresh = [], runtime.materialize(edges.sparkSession.createDataFrame([(active[0], int(source), 0.0, 0, True)], REACHED), "sssp", "none")
    columns, shift = ["half", "vertex_id", "cost", "hops"], 0
    while active:
        taken = {(half + shift) // 2 for half in active}
        here = F.lit(True) if len(active) == len(names) else F.col("half").isin([int(n) for n in names if (n + shift) // 2 in taken])
        block = F.expr(f"(half + {shift}) div 2")
        known = fresh.where(here).select(*columns, F.col("sent").alias("fresh"))
        for table in past:
            known = known.union(table.where(here).select(*columns, F.lit(False)))
        offers = links.where(here).groupBy(block).cogroup(known.groupBy(block)).applyInArrow(_settled(lows, names, most, reached), REACHED)
        past, fresh, shift = [*past, fresh], runtime.materialize(offers, "sssp", "none"), 1 - shift
        row = fresh.agg(F.collect_set(F.when(F.col("sent"), F.col("half"))).alias("halves"), F.min(F.when(F.col("vertex_id") == F.lit(target), F.col("cost"))).alias("cost")).first()
        active = sorted(row["halves"])
        if row["cost"] is not None:
            reached = min(reached, row["cost"])
        if len(past) == ROUNDS:
            past = [_together(past)]
    best = _together([*past, fresh])
    runtime.forget(links)
    return best.select("vertex_id", "cost", "hops"), both


def _together(tables: list[DataFrame]) -> DataFrame:
    """The least (cost, hops) of every vertex in tables of rounds, which are deleted."""
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.union(table)
    least = rows.groupBy("half", "vertex_id").agg(F.min(F.struct("cost", "hops")).alias("b"))
    best = runtime.materialize(least.select("half", "vertex_id", "b.cost", "b.hops", F.lit(False).alias("sent")), "sssp-best")
    runtime.forget(*tables)
    return best


def shortest_distances(edges: DataFrame, source: int, weight: str | None = None, max_distance: float | None = None) -> DataFrame:
    """vertex_id, cost: least sum of non-negative weights from the source."""
    return _relaxed(edges, source, weight, max_distance)[0].select("vertex_id", "cost")


def shortest_path(edges: DataFrame, source: int, target: int, weight: str | None = None, heuristic: DataFrame | None = None) -> DataFrame:
    """step, vertex_id, cost along one shortest path (the least predecessor at every
    step); empty if the target is not reached.  ``heuristic`` (vertex_id, h) is a lower
    bound of the distance to the target and spares the search what cannot be on the path.

    A predecessor is nearer by its edge's weight; over an edge of weight 0 it must have
    fewer edges to the source, so predecessors form a tree.  The path is the target's
    ancestors in it, found by pointer doubling.
    """
    cost, both = _relaxed(edges, source, weight, None, target, heuristic)
    near = cost.select(F.col("vertex_id").alias("a"), F.col("cost").alias("ca"), F.col("hops").alias("ha"))
    far = cost.select(F.col("vertex_id").alias("b"), F.col("cost").alias("cb"), F.col("hops").alias("hb"))
    tight = both.join(near, "a").join(far, "b").where("ca + w = cb AND (w > 0 OR ha < hb)").where(F.col("b") != source)
    up = runtime.materialize(tight.groupBy("b").agg(F.min("a").alias("a")), "path-parents")
    on = runtime.materialize(cost.where(F.col("vertex_id") == target).select("vertex_id", F.lit(0).cast("long").alias("back")), "path")
    stride = 1
    while True:
        more = on.join(up, F.col("vertex_id") == F.col("b")).select(F.col("a").alias("vertex_id"), (F.col("back") + stride).alias("back"))
        more = runtime.materialize(more, "path-more")
        if more.isEmpty():
            break
        on, stride = runtime.materialize(on.union(more), "path"), 2 * stride
        again = up.select(F.col("b").alias("a"), F.col("a").alias("top"))
        old, up = up, runtime.materialize(up.join(again, "a").select("b", F.col("top").alias("a")), "path-parents")
        runtime.forget(old)
    last = on.agg(F.max("back").alias("last"))
    return on.join(last).join(cost, "vertex_id").select((F.col("last") - F.col("back")).alias("step"), "vertex_id", "cost")


def k_core(edges: DataFrame) -> DataFrame:
    """vertex_id, core: the h-index iteration.  Each round a vertex takes the largest h
    such that h of its neighbours (repeats counted) have at least h; it settles on the
    coreness."""
    both = runtime.materialize(adjacency(edges.where("v0 <> v1")).select("a", "b"), "core-edges")
    now = past = runtime.materialize(both.groupBy("a").agg(F.count(F.lit(1)).alias("h")), "core")
    rank = Window.partitionBy("a").orderBy(F.desc("hb"), "b")
    while True:
        seen = both.join(now.select(F.col("a").alias("b"), F.col("h").alias("hb")), "b")
        new = seen.withColumn("r", F.row_number().over(rank)).groupBy("a").agg(F.max(F.least("r", "hb")).cast("long").alias("nh"))
        after = runtime.materialize(now.join(new, "a").select("a", F.least("h", "nh").alias("h"), (F.col("nh") < F.col("h")).alias("fell")), "core")
        runtime.forget(past)
        now, past = after.select("a", "h"), after
        if after.where("fell").isEmpty():
            return now.select(F.col("a").alias("vertex_id"), F.col("h").alias("core"))


def label_propagation(edges: DataFrame, max_iter: int = 20) -> DataFrame:
    """vertex_id, label: synchronous rounds in which a vertex takes the most frequent
    label of its neighbours, the least among equals."""
    both = runtime.materialize(adjacency(edges.where("v0 <> v1")).select("a", "b"), "lpa-edges")
    now = past = runtime.materialize(both.select("a").distinct().select("a", F.col("a").alias("label")), "lpa")
    for _ in range(max_iter):
        votes = both.join(now.select(F.col("a").alias("b"), "label"), "b").groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        new = votes.groupBy("a").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("new"))
        after = runtime.materialize(now.join(new, "a").select("a", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")), "lpa")
        runtime.forget(past)
        now, past = after.select("a", "label"), after
        if after.where("moved").isEmpty():
            break
    return now.select(F.col("a").alias("vertex_id"), "label")


def modularity(edges: DataFrame, labels: DataFrame, weight: str | None = None, label: str = "label") -> DataFrame:
    """One row: q = inside / 2m - sum of (degree of community / 2m) squared; 0 without edges."""
    both = adjacency(edges, weight)
    marked = both.join(labels.select(F.col("vertex_id").alias("a"), F.col(label).alias("la")), "a").join(
        labels.select(F.col("vertex_id").alias("b"), F.col(label).alias("lb")), "b"
    )
    each = marked.groupBy("la").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = each.agg(F.sum("k").alias("m"), F.sum("inside").alias("i"), F.sum(F.col("k") * F.col("k")).alias("s"))
    return total.select(F.coalesce(F.when(F.col("m") > 0, F.col("i") / F.col("m") - F.col("s") / (F.col("m") * F.col("m"))), F.lit(0.0)).alias("q"))


def louvain(edges: DataFrame, weight: str | None = None, max_levels: int = 10, sweeps: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """vertex_id, label: greedy modularity in levels.  In a sweep vertices of one hash
    half at a time move to the neighbouring community with the largest gain (the least
    label among equals); communities then become vertices.  Stops when a level adds
    less than ``tolerance`` of modularity.

    Links lie packed in blocks of vertices with neighbouring ids (``communities``): in a sweep
    each block hears the communities of the vertices it has links to and judges its own.  A level
    of one block settles in its task."""
    kind, spark = edges.schema["v0"].dataType, edges.sparkSession
    links = edges.select(F.col("v0").cast("long").alias("v0"), F.col("v1").cast("long").alias("v1"), _weight(weight).alias("w"))
    links = runtime.materialize(links, "louvain-links")
    member = links.select(F.explode(F.array("v0", "v1")).alias("vertex_id")).where("vertex_id IS NOT NULL").groupBy("vertex_id").agg(F.count(F.lit(1)).alias("links"))
    member = runtime.materialize(member.withColumn("label", F.col("vertex_id")), "louvain")
    whole = links.where("v0 IS NOT NULL AND v1 IS NOT NULL")
    m2 = 2.0 * (whole.agg(F.sum("w")).first()[0] or 0.0)

    def begins(each: DataFrame) -> np.ndarray:
        """The least vertex of every block, from (a, links) of each vertex."""
        mark = runtime.mark()
        each = numbering.prefix_sums(each, ["a"], F.col("links"), "before")
        lows = each.groupBy(F.floor(F.col("before") / communities.BLOCK)).agg(F.min("a").alias("low")).orderBy("low").collect()
        runtime.release(spark, runtime.since(mark))
        return np.array([r["low"] for r in lows], np.int64)

    def heard(placed: DataFrame) -> GroupedData:
        """What every block hears of vertices (block, a, c, tot)."""
        return routes.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(communities.tell, communities.TOLD).groupBy("block")

    def survey(state: DataFrame) -> DataFrame:
        """a, c, k, tot (weight of its community), pick (the community a vertex would move to), inside
        (weight of its links into its own, loops apart), links (their number) of a state (block, a, c, k)."""
        placed = state.select("block", "a", "c", F.sum("k").over(Window.partitionBy("c")).alias("tot"))
        seen = blocks.groupBy("block").cogroup(heard(placed)).applyInArrow(communities.judge(m2), communities.STATE)
        return runtime.materialize(seen, "louvain-state")

    def half(pair: int) -> Column:
        return F.pmod(F.xxhash64("a", F.lit(pair)), F.lit(2))

    def quality(seen: DataFrame) -> float:
        r = seen.agg(F.sum("inside").alias("i"), F.sum(F.col("k") * F.col("tot")).alias("s")).first()
        return (r["i"] + loops) / m2 - r["s"] / (m2 * m2)

    if m2:
        lows = begins(member.select(F.col("vertex_id").alias("a"), "links"))
        pieces = whole.mapInArrow(communities.dealt(lows), communities.PIECES)
    for _ in range(max_levels if m2 else 0):
        blocks = runtime.materialize(pieces.groupBy("block").applyInArrow(communities.packed, communities.PACKED), "louvain-blocks")
        routes = runtime.materialize(blocks.groupBy("block").applyInArrow(communities.routes(lows), communities.ROUTES), "louvain-routes")
        runtime.forget(links)
        loops = blocks.agg(F.sum("loops")).first()[0]
        state = survey(blocks.where("piece = 0").select("block", "ids", "k").mapInArrow(communities.alone, communities.ALONE))
        before = best = quality(state)
        if len(lows) == 1:
            turns = state.select("block", "a", F.array(*[half(i) for i in range(max(1, (sweeps + 1) // 2))]).alias("halves"))
            joined = blocks.groupBy("block").cogroup(turns.groupBy("block"))
            past, state = state, runtime.materialize(joined.applyInArrow(communities.settled(m2, sweeps, tolerance), communities.STATE), "louvain-state")
            runtime.forget(past)
            best = quality(state)
        for sweep in range(sweeps if len(lows) > 1 else 0):
            turn = half(sweep // 2) == sweep % 2
            after = survey(state.select("block", "a", F.when(turn, F.col("pick")).otherwise(F.col("c")).alias("c"), "k"))
            now = quality(after)
            if now > best + tolerance:
                past, best, state = state, now, after
                runtime.forget(past)
            else:
                runtime.forget(after)
                if sweep % 2:
                    break
        if best - before < tolerance:
            break
        past = member, blocks, routes, state
        moved = member.join(state.select(F.col("a").alias("label"), "c"), "label", "left")
        member = runtime.materialize(moved.select("vertex_id", F.coalesce("c", "label").alias("label")), "louvain")
        lows = begins(state.groupBy(F.col("c").alias("a")).agg(F.sum("links").alias("links")))
        joined = blocks.groupBy("block").cogroup(heard(state.select("block", "a", "c", F.lit(0.0).alias("tot"))))
        pieces = links = runtime.materialize(joined.applyInArrow(communities.contracted(lows), communities.PIECES), "louvain-links")
        runtime.forget(*past)
    return member.select(F.col("vertex_id").cast(kind), F.col("label").cast(kind))


def clustering(edges: DataFrame) -> DataFrame:
    """vertex_id, triangles, coefficient 2T / (k (k - 1)) over simple undirected edges."""
    simple = edges.where("v0 <> v1").select(F.least("v0", "v1").alias("u"), F.greatest("v0", "v1").alias("v")).distinct()
    simple = runtime.materialize(simple, "simple-edges")
    degree = adjacency(simple.select(F.col("u").alias("v0"), F.col("v").alias("v1"))).groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    # edges point from the end of lower degree, so a hub starts few wedges
    ranked = simple.join(degree.select(F.col("a").alias("u"), F.col("k").alias("ku")), "u").join(degree.select(F.col("a").alias("v"), F.col("k").alias("kv")), "v")
    forward = F.struct("ku", "u") < F.struct("kv", "v")
    out = ranked.select(F.when(forward, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(forward, F.col("v")).otherwise(F.col("u")).alias("t"))
    wedge = out.alias("p").join(out.alias("q"), F.col("p.s") == F.col("q.s")).where("p.t < q.t").select(F.col("p.s").alias("s"), F.col("p.t").alias("u"), F.col("q.t").alias("v"))
    closed = wedge.join(simple, ["u", "v"])
    corners = closed.select(F.explode(F.array("s", "u", "v")).alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("t"))
    per = degree.join(corners, "a", "left").withColumn("t", F.coalesce("t", F.lit(0)).cast("long"))
    value = F.when(F.col("k") > 1, 2.0 * F.col("t") / (F.col("k") * (F.col("k") - 1)).cast("double")).otherwise(0.0)
    return per.select(F.col("a").alias("vertex_id"), F.col("t").alias("triangles"), value.alias("coefficient"))


def summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree 2E / N, components, size of the largest."""
    labels = connected_components(edges, vertices)
    comp = sizes(labels).agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("largest"))
    counts = vertices.agg(F.count(F.lit(1)).alias("nodes"))
    links = edges.agg(F.count(F.lit(1)).alias("edges"))
    one = side_by_side(counts, links, comp)
    return one.select("nodes", "edges", (2.0 * F.col("edges") / F.col("nodes")).alias("mean_degree"), "n_components", "largest")


def split_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """vertex_id, component, depth, parent: every component as a tree of shortest hops
    from its least vertex (the least parent among equals; -1 at the root)."""
    labels = runtime.materialize(connected_components(edges, vertices), "split")
    both = runtime.materialize(adjacency(edges.where("v0 <> v1")).select("a", "b").distinct(), "split-edges")
    roots = labels.where("vertex_id = component").select("vertex_id", F.lit(0).cast("long").alias("depth"), F.lit(-1).cast("long").alias("parent"))
    seen = frontier = runtime.materialize(roots, "split-seen")
    step = 0
    while True:
        step += 1
        new = frontier.join(both, F.col("vertex_id") == F.col("a")).groupBy(F.col("b").alias("vertex_id")).agg(F.min("a").alias("parent"))
        new = new.join(seen.select("vertex_id"), "vertex_id", "left_anti").select("vertex_id", F.lit(step).cast("long").alias("depth"), "parent")
        frontier = runtime.materialize(new, "split-frontier")
        if frontier.isEmpty():
            break
        seen = runtime.materialize(seen.union(frontier), "split-seen")
    return labels.join(seen, "vertex_id")
