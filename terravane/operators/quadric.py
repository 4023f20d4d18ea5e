"""Mesh simplification by quadric edge collapse, object by object.

A collapse depends on those before it in its connected part only, so the parts of an
object are worked out on their own, spread over tasks.  Each logs its collapses with the
largest key it has met; in the order of these keys they stand as one run over the whole
object makes them, and those that bring the object to its share of faces are carried out.
A task holds one connected part.  For a single one too large for a task use
``binning.coarsen_mesh_to``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.plans import components, numbering, runtime, whole

LOG = "component long, object_id long, seq long, cost double, ka long, kb long, removed long, a long, b long, x double, y double, z double"
FACE = "object_id long, face_id long, v0 long, v1 long, v2 long, " + ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz")
XYZ = [f"{a}{k}" for k in range(3) for a in "xyz"]


def _place(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """The cheapest position for a merged vertex, and its cost."""
    options = [a, b, (a + b) / 2]
    if abs(np.linalg.det(q[:3, :3])) > 1e-10:
        options.append(np.linalg.solve(q[:3, :3], -q[:3, 3]))
    costs = [float((h := np.append(p, 1.0)) @ q @ h) for p in options]
    best = int(np.argmin(costs))
    return max(0.0, costs[best]), options[best]


def collapse(v: np.ndarray, f: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and faces with about ``target`` faces.  Collapses that would turn a face
    over, or join vertices with other than two common neighbours inside the surface, are
    passed over; border edges carry an extra plane that holds them in place."""
    v, faces = v.astype(float).copy(), {i: tuple(t) for i, t in enumerate(f.tolist()) if len(set(t)) == 3}
    for _ in _steps(v, faces, target):
        pass
    return v, np.array(list(faces.values()), np.int64).reshape(-1, 3)


def _steps(v: np.ndarray, faces: dict[int, tuple], target: int) -> Iterator[tuple]:
    """Collapses, carried out in ``v`` and ``faces``: (largest (cost, a, b) taken from the heap
    so far, faces removed, a, b, position)."""
    q, around, seen = np.zeros((len(v), 4, 4)), [set() for _ in v], {}
    for i, t in faces.items():
        n = np.cross(v[t[1]] - v[t[0]], v[t[2]] - v[t[0]])
        size = np.linalg.norm(n)
        plane = np.append(n, -n @ v[t[0]]) / (size or 1.0)
        for k in t:
            q[k] += size / 2 * np.outer(plane, plane)
            around[k].add(i)
        for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            seen.setdefault((min(a, b), max(a, b)), []).append((n / (size or 1.0), i))
    for (a, b), sides in seen.items():
        if len(sides) == 1:
            n = np.cross(v[b] - v[a], sides[0][0])
            n = n / (np.linalg.norm(n) or 1.0)
            plane = np.append(n, -n @ v[a])
            for k in (a, b):
                q[k] += 100 * np.dot(v[b] - v[a], v[b] - v[a]) * np.outer(plane, plane)
    stamp, heap = [0] * len(v), []

    def push(a: int, b: int) -> None:
        a, b = min(a, b), max(a, b)
        cost, p = _place(q[a] + q[b], v[a], v[b])
        heapq.heappush(heap, (cost, a, b, stamp[a], stamp[b], tuple(p)))

    for a, b in sorted(seen):
        push(a, b)
    top = (-1.0, -1, -1)
    while len(faces) > target and heap:
        cost, a, b, sa, sb, p = heapq.heappop(heap)
        top = max(top, (cost, a, b))
        if stamp[a] != sa or stamp[b] != sb or not around[a] or not around[b]:
            continue
        common = around[a] & around[b]
        ring = [{k for i in around[x] for k in faces[i]} - {a, b} for x in (a, b)]
        if not common or len(ring[0] & ring[1]) != len(common):
            continue
        p, turned = np.array(p), False
        for x in (a, b):
            for i in around[x] - common:
                t = faces[i]
                new = [p if k == x else v[k] for k in t]
                old_n, new_n = np.cross(v[t[1]] - v[t[0]], v[t[2]] - v[t[0]]), np.cross(new[1] - new[0], new[2] - new[0])
                if old_n @ new_n <= 0.2 * np.linalg.norm(old_n) * np.linalg.norm(new_n):
                    turned = True
        if turned:
            continue
        for i in common:
            for k in faces.pop(i):
                around[k].discard(i)
        for i in around[b]:
            faces[i] = tuple(a if k == b else k for k in faces[i])
        around[a] |= around[b]
        around[b] = set()
        v[a], q[a] = p, q[a] + q[b]
        stamp[a] += 1
        stamp[b] += 1
        for k in sorted({k for i in around[a] for k in faces[i]} - {a}):
            push(a, k)
        yield top, len(common), a, b, p


def _groups(rows: pa.Table, order: str) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each component, its rows by ``order``."""
    columns = {c: rows.column(c).to_numpy() for c in rows.column_names}
    place = np.lexsort((columns[order], columns["component"]))
    for at in np.split(place, np.flatnonzero(np.diff(columns["component"][place])) + 1):
        yield {c: values[at] for c, values in columns.items()}


def _shape(g: dict[str, np.ndarray], own: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertex ids, positions, faces as places among them)."""
    corners = np.column_stack([g[f"v{k}"][own] for k in range(3)])
    ids, at = np.unique(corners, return_inverse=True)
    v = np.empty((len(ids), 3))
    v[at.ravel()] = np.column_stack([g[c][own] for c in XYZ]).reshape(-1, 3)
    return ids, v, at.reshape(-1, 3)


def _logged(rows: pa.Table) -> pa.Table:
    """Kernel: the collapses of whole components, as far as the object could need them."""
    out = []
    for g in _groups(rows, "face_id"):
        ids, v, f = _shape(g)
        faces = {i: tuple(t) for i, t in enumerate(f.tolist()) if len(set(t)) == 3}
        for n, ((cost, ka, kb), removed, a, b, p) in enumerate(_steps(v, faces, len(faces) - int(g["need"][0]))):
            out.append((g["component"][0], g["object_id"][0], n, cost, ids[ka], ids[kb], removed, ids[a], ids[b], *p))
    names = [c.split()[0] for c in LOG.split(", ")]
    kinds = [pa.float64() if c.endswith("double") else pa.int64() for c in LOG.split(", ")]
    return pa.table({name: pa.array(values, kind) for name, values, kind in zip(names, zip(*out) if out else [[]] * len(names), kinds, strict=True)})


def _carried_out(rows: pa.Table) -> pa.Table:
    """Kernel: the faces that are left of whole components after logged collapses, which
    stand among the faces as rows with ``seq``, merged vertices and their position."""
    parts = []
    for g in _groups(rows, "seq"):
        own = g["seq"] < 0
        ids, v, f = _shape(g, own)
        up, whole_ = np.arange(len(ids)), (f[:, 0] != f[:, 1]) & (f[:, 1] != f[:, 2]) & (f[:, 0] != f[:, 2])
        a, b = (np.searchsorted(ids, g[c][~own]) for c in ("v0", "v1"))
        up[b] = a
        for k, p in zip(a, np.column_stack([g[c][~own] for c in XYZ[:3]]), strict=True):
            v[k] = p
        while (up[up] != up).any():
            up = up[up]
        f = up[f]
        left = whole_ & (f[:, 0] != f[:, 1]) & (f[:, 1] != f[:, 2]) & (f[:, 0] != f[:, 2])
        parts.append(np.rec.fromarrays([g["object_id"][own][left], g["face_id"][own][left], *ids[f[left]].T, *v[f[left]].reshape(-1, 9).T]))
    names = [c.split()[0] for c in FACE.split(", ")]
    return pa.table({name: np.concatenate([part[f"f{k}"] for part in parts]) for k, name in enumerate(names)})


def simplify(vertices: DataFrame, faces: DataFrame, ratio: float = 0.25) -> DataFrame:
    """object_id, face, corner, vertex_id, x, y, z: the corners of each object's remaining
    faces, about ``ratio`` of them."""
    corners = faces.select("object_id", "face_id", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vertex_id"))
    placed = corners.join(vertices.select("vertex_id", *[F.col(a).cast("double").alias(a) for a in "xyz"]), "vertex_id")
    placed = runtime.materialize(placed, "quadric-corners")
    nodes = numbering.number_rows(placed.select("object_id", "vertex_id").distinct(), ["object_id", "vertex_id"], "n")
    at = lambda c, k: F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{c}{k}")
    wide = placed.join(nodes, ["object_id", "vertex_id"]).withColumnRenamed("vertex_id", "v").groupBy("object_id", "face_id").agg(*[at(c, k) for k in range(3) for c in ("v", "n", *"xyz")])
    wide = runtime.materialize(wide, "quadric-faces")
    part = components.connected_components(wide.selectExpr("inline(array(struct(n0 AS a, n1 AS b), struct(n1 AS a, n2 AS b)))"))
    solid = F.sum(F.expr("cast(v0 <> v1 AND v1 <> v2 AND v0 <> v2 AS long)"))
    need = wide.groupBy("object_id").agg((solid - F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(float(ratio)))).cast("long")).alias("need"))
    need = runtime.materialize(need.select("object_id", F.greatest("need", F.lit(0)).alias("need")), "quadric-need")
    rows = wide.join(part.withColumnRenamed("node", "n0"), "n0", "left").withColumn("component", F.coalesce("component", "n0")).join(need, "object_id")
    rows = runtime.materialize(rows.select("component", "object_id", "face_id", "need", *[f"v{k}" for k in range(3)], *XYZ), "quadric-parts")
    spread = runtime.parts_for(rows.count(), 1 << 14, int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    log = runtime.materialize(whole.solve(rows, _logged, LOG, "component", parts=spread), "quadric-log")
    run = runtime.materialize(numbering.prefix_sums(log, ["object_id", "cost", "ka", "kb", "component", "seq"], F.col("removed"), "before"), "quadric-run")
    begin = run.groupBy("object_id").agg(F.min("before").alias("begin"))
    used = run.join(begin, "object_id").join(need, "object_id").where("before - begin < need")
    steps = used.selectExpr("component", "object_id", "0L AS face_id", "seq", "a AS v0", "b AS v1", "-1L AS v2", "x AS x0", "y AS y0", "z AS z0", *[f"0D AS {c}" for c in XYZ[3:]])
    both = rows.drop("need").withColumn("seq", F.lit(-1).cast("long")).unionByName(steps)
    left = runtime.materialize(whole.solve(both, _carried_out, FACE, "component", parts=spread), "quadric-left")
    numbered = runtime.materialize(numbering.number_rows(left, ["object_id", "face_id"], "face"), "quadric-numbered")
    first = numbered.groupBy("object_id").agg(F.min("face").alias("first"))
    each = [F.struct(F.lit(k).cast("long").alias("corner"), F.col(f"v{k}").alias("vertex_id"), *[F.col(f"{a}{k}").alias(a) for a in "xyz"]) for k in range(3)]
    return numbered.join(first, "object_id").select("object_id", (F.col("face") - F.col("first")).alias("face"), F.inline(F.array(*each)))
