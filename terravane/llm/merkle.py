r"""Merkle manifest of a table: one tree a language, one tree over the languages' roots.

A leaf is the SHA-256 of a row's named columns, each ``-`` if null, else its UTF-8 byte
count, ``:`` and the value.  Nodes are digests of up to ``fanout`` consecutive nodes'
lowercase hex, without padding: a short last run, of one node too, is hashed like any
other, and what remains alone is the root.

Leaves are dealt by range into *indexed partitions* of some ``rows`` of them, which know
their first leaf's place in its tree.  A partition takes its nodes in order onto a
stack; whenever the top completes a run (``fanout`` siblings, or fewer at the tree's
end) the run is replaced by its parent, a carry in base ``fanout``.  Every node made is
a record; what is left on the stack are the partition's peaks, among them nodes at its
edges whose runs began in the partition before or end in the one after.  Peaks are
few (twice the tree's height a partition) and are nodes in order again: they are dealt
into partitions and merged in the same way, until every tree is whole.  Proofs go the
way back: a peak that has its path to the root hands it down to all nodes under it.
No task holds more than one partition's records, and what goes from one pass to the
next shrinks by the factor ``rows`` / (2 height).

Defined results
* Leaves of a tree ascend by doc_id (null first), then by digest; equal rows are leaves
  of their own, and as they have equal digests their order is without effect.
* null lang: a tree of its own, before the others.  Null and empty values differ.
* Empty table: no leaves and no root.  Only the named columns are read, whatever other
  columns there are.
* A tampered row has 1 added to n_chars (null stays null); rows without doc_id never are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terravane.plans import runtime

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Leaves or peaks in an indexed partition.
ROWS = 1 << 13

_NODE = "part int, tree string, level int, at long, total long, digest string, peak boolean, top boolean, item boolean"
_PATH = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def node_digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def widths(total: int, fanout: int) -> list[int]:
    """Nodes at each level of a tree of so many leaves, the root last."""
    out = [total]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


def climb(nodes: list[tuple[int, int, str]], total: int, fanout: int) -> Iterator[tuple[int, int, str, bool]]:
    """(level, at, digest, peak) of nodes in order and of all that they complete."""
    wide, stack = widths(total, fanout), []
    for node in nodes:
        stack.append(node)
        while True:
            level, at, _ = stack[-1]
            if wide[level] == 1:
                break
            first = at - at % fanout
            size = min(fanout, wide[level] - first)
            run = stack[-size:]
            if at != first + size - 1 or len(run) < size or run[0][:2] != (level, first):
                break
            del stack[-size:]
            for k, i, digest in run:
                yield k, i, digest, False
            stack.append((level + 1, first // fanout, node_digest([d for _, _, d in run])))
    for k, i, digest in stack:
        yield k, i, digest, True


def _trees(table: pa.Table, keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each tree, in the order of ``keys``."""
    rows = table.take(pc.sort_indices(table, sort_keys=[(k, "ascending") for k in ["tree", *keys]], null_placement="at_start"))
    trees, begun = rows.column("tree").to_pylist(), 0
    for k in range(1, len(trees) + 1):
        if k == len(trees) or trees[k] != trees[begun]:
            yield rows.slice(begun, k - begun)
            begun = k


def _schema(ddl: str, payload: dict[str, str]) -> tuple[str, pa.Schema]:
    whole = ", ".join([ddl, *(f"`{n}` {kind}" for n, kind in payload.items())])
    return whole, to_arrow_schema(T.StructType.fromDDL(whole))


def _records(schema: pa.Schema, part: int, trees: Iterator[tuple[int, list[tuple[int, int, str]], pa.Table]], fanout: int) -> pa.Table:
    """Node records of a partition, from each tree's total, nodes and rows; the columns
    of ``rows`` that the schema names after the node's own go with the items."""
    own, payload = schema.names[:9], schema.names[9:]
    out: dict[str, list] = {n: [] for n in schema.names}
    for total, nodes, rows in trees:
        tree = rows.column("tree")[0].as_py()
        carried = {c: rows.column(c).to_pylist() for c in payload}
        place = {node[:2]: k for k, node in enumerate(nodes)}
        root = len(widths(total, fanout)) - 1
        for level, at, digest, peak in climb(nodes, total, fanout):
            k = place.get((level, at))
            for n, v in zip(own, (part, tree, level, at, total, digest, peak, peak and level == root, k is not None), strict=True):
                out[n].append(v)
            for c in payload:
                out[c].append(None if k is None else carried[c][k])
    return pa.table(out, schema=schema)


def _deal(nodes: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Nodes with ``part``: ranges of about ``rows`` of them; ``nodes`` is a written table."""
    n = nodes.count()
    if n <= rows:
        return nodes.withColumn("part", F.lit(0))
    dealt = nodes.repartitionByRange(runtime.parts_for(n, rows), *order).withColumn("part", F.spark_partition_id())
    return runtime.materialize(dealt, "merkle-dealt")


def _first_pass(leaves: DataFrame, keys: list[str], payload: dict[str, str], fanout: int, rows: int) -> DataFrame:
    """Node records of the leaves (tree, digest, keys, payload) by indexed partitions."""
    order = [*keys, "digest", "__row"]
    # a row's number splits equal rows between ranges; it is written, so it stays as it is
    written = runtime.materialize(leaves.withColumn("__row", F.monotonically_increasing_id()), "merkle-leaves")
    dealt = _deal(written, ["tree", *order], rows)
    sizes = dealt.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n"))
    along, whole = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("tree")
    index = sizes.select("part", "tree", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("first"), F.sum("n").over(whole).alias("total"))
    ddl, schema = _schema(_NODE, payload)

    def run(key: tuple, mine: pa.Table, places: pa.Table) -> pa.Table:
        at = {r["tree"]: (r["first"], r["total"]) for r in places.to_pylist()}

        def trees() -> Iterator[tuple[int, list[tuple[int, int, str]], pa.Table]]:
            for tree in _trees(mine, order):
                first, total = at[tree.column("tree")[0].as_py()]
                yield total, [(0, first + k, d) for k, d in enumerate(tree.column("digest").to_pylist())], tree

        return _records(schema, key[0].as_py(), trees(), fanout)

    return runtime.materialize(dealt.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(run, ddl), "merkle-nodes")


def _next_pass(open_peaks: DataFrame, fanout: int, rows: int) -> DataFrame:
    """Node records of peaks that are not yet roots; ``home`` is a peak's former partition."""
    peaks = open_peaks.withColumn("begin", F.col("at").cast("decimal(38,0)") * F.pow(F.lit(float(fanout)), "level").cast("decimal(38,0)"))
    peaks = runtime.materialize(peaks.select(F.col("part").alias("home"), "tree", "level", "at", "total", "digest", "begin"), "merkle-peaks")
    ddl, schema = _schema(_NODE, {"home": "int"})

    def run(key: tuple, mine: pa.Table) -> pa.Table:
        def trees() -> Iterator[tuple[int, list[tuple[int, int, str]], pa.Table]]:
            for tree in _trees(mine, ["begin"]):
                nodes = list(zip(*(tree.column(c).to_pylist() for c in ("level", "at", "digest")), strict=True))
                yield tree.column("total")[0].as_py(), nodes, tree

        return _records(schema, key[0].as_py(), trees(), fanout)

    return runtime.materialize(_deal(peaks, ["tree", "begin"], rows).groupBy("part").applyInArrow(run, ddl), "merkle-nodes")


def _hand_down(records: DataFrame, known: DataFrame, payload: dict[str, str], fanout: int) -> DataFrame:
    """Paths of a pass's items, from those of its peaks."""
    ddl, schema = _schema(f"tree string, level int, at long, digest string, subroot string, root string, path {_PATH}", payload)
    kind = schema.field("path").type

    def run(mine: pa.Table, solved: pa.Table) -> pa.Table:
        ends = {(r["tree"], r["level"], r["at"]): (r["subroot"], r["root"], [(x["left"], x["right"]) for x in r["path"]]) for r in solved.to_pylist()}
        out: dict[str, list] = {c: [] for c in schema.names if c != "path"}
        lefts, rights, offsets = [], [], [0]
        for tree in _trees(mine, ["level"]):
            rows = tree.to_pylist()
            digest = {(r["level"], r["at"]): r["digest"] for r in rows}
            paths: dict[tuple[int, int], tuple] = {}
            for r in reversed(rows):  # parents before children
                node = level, at = r["level"], r["at"]
                if r["peak"]:
                    paths[node] = ends[r["tree"], level, at]
                else:
                    first = at - at % fanout
                    left = "".join([digest[level, i] for i in range(first, at)])
                    right = "".join([digest[level, i] for i in range(at + 1, first + fanout) if (level, i) in digest])
                    subroot, root, above = paths[level + 1, at // fanout]
                    paths[node] = subroot, root, [(left, right), *above]
                if r["item"]:
                    subroot, root, path = paths[node]
                    lefts += [x for x, _ in path]
                    rights += [x for _, x in path]
                    offsets.append(len(lefts))
                    for c, v in {"subroot": subroot, "root": root}.items():
                        out[c].append(v)
                    for c in ("tree", "level", "at", "digest", *payload):
                        out[c].append(r[c])
                    if level == 0:
                        del paths[node]
        steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(kind.value_type))
        made = {c: pa.array(v, schema.field(c).type) for c, v in out.items()}
        made["path"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps, type=kind)
        return pa.table([made[c] for c in schema.names], schema=schema)

    return records.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(run, ddl)


@dataclass
class Manifest:
    """``passes``: tables of node records, the leaves' first."""

    passes: list[DataFrame]
    payload: dict[str, str]
    fanout: int

    def nodes(self) -> DataFrame:
        """tree, level, at, digest: every node once."""
        found = [p.where("true" if k == 0 else "NOT item").select("tree", "level", "at", "digest") for k, p in enumerate(self.passes)]
        return reduce(DataFrame.union, found)

    def roots(self) -> DataFrame:
        """tree, digest, total: one row a tree."""
        return reduce(DataFrame.union, [p.where("top").select("tree", "digest", "total") for p in self.passes])

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """One row a leaf: tree, at, digest, payload, subroot (its tree's root), root and
        path: the siblings left and right, level by level.  ``above`` (tree, root, path)
        continues each tree's path; without it root is the subroot."""
        solved = None
        for k, records in reversed(list(enumerate(self.passes))):
            ends = records.where("top").select("part", "tree", "level", "at", F.col("digest").alias("subroot"))
            if above is None:
                known = ends.select("*", F.col("subroot").alias("root"), F.array().cast(_PATH).alias("path"))
            else:
                known = ends.join(above.withColumnRenamed("tree", "__tree"), F.col("tree").eqNullSafe(F.col("__tree"))).drop("__tree")
            known = known if solved is None else known.unionByName(solved)
            known = known.select(*[F.col(c).alias(c) for c in known.columns])  # columns of its own, apart from those of records
            solved = _hand_down(records, known, {"home": "int"} if k else self.payload, self.fanout)
            if k:
                solved = runtime.materialize(solved.drop("digest").withColumnRenamed("home", "part"), "merkle-paths")
        return solved.drop("level")


def grow(leaves: DataFrame, keys: list[str], payload: dict[str, str], fanout: int = 2, rows: int = ROWS) -> Manifest:
    """The trees of ``leaves`` (tree, digest, keys, payload: name -> type), each tree's in
    the order of ``keys``, then digest."""
    if fanout < 2:
        raise ValueError("a node has two children or more")
    passes = [_first_pass(leaves, keys, payload, fanout, rows)]
    before = None
    while n := (left := passes[-1].where("peak AND NOT top")).count():
        if before is not None and 2 * n > before:  # partitions smaller than a few times the trees' height
            rows *= 4
        passes, before = [*passes, _next_pass(left, fanout, rows)], n
    return Manifest(passes, payload, fanout)


def manifest(docs: DataFrame, fields: list[str], tree: str, key: str, payload: dict[str, Column] | None = None, fanout: int = 2, rows: int = ROWS) -> tuple[Manifest, Manifest]:
    """(the trees of the values of column ``tree``, the tree over their roots)."""
    carried = {key: docs[f"`{key}`"]} | (payload or {})
    leaves = docs.select(docs[f"`{tree}`"].cast("string").alias("tree"), leaf_digest([docs[f"`{f}`"] for f in fields]).alias("digest"), *[c.alias(n) for n, c in carried.items()])
    kinds = {n: leaves.schema[n].dataType.simpleString() for n in carried}
    trees = grow(leaves, [key], kinds, fanout, rows)
    # the roots in the order of their trees' names, under one tree without a name
    tops = trees.roots().select(F.lit(None).cast("string").alias("tree"), "digest", F.col("tree").alias("name"))
    return trees, grow(tops, ["name"], {"name": "string"}, fanout, rows)


def proofs(trees: Manifest, top: Manifest) -> DataFrame:
    """Every leaf with the path to the root over all trees."""
    above = top.proofs().select(F.col("name").alias("tree"), "root", "path")
    return trees.proofs(above)


def proof_digest(path: Column) -> Column:
    """Digest of a path's siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda d, x: F.sha2(F.concat(x["left"], d, x["right"]), 256))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = leaf_digest([more if f == "n_chars" else F.col(f) for f in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, changed)
    trees, top = manifest(docs, FIELDS, "lang", "doc_id", {"tampered": tampered})
    root = folded(F.coalesce("tampered", "digest"), F.col("path"))
    return proofs(trees, top).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"), (root == F.col("root")).alias("verified")
    )


_ENC = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = "sha256(" + " || ".join(_ENC.format(f) for f in FIELDS) + ")"
# crc32 by bits: a byte is joined, then eight shifts follow
_CRC = """xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))]),
             lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""

OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_LEAF} AS leaf,
         CASE WHEN {_CRC} % 7 = 0 THEN {_LEAF.replace("n_chars", "(n_chars + 1)")} END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
t(lang, level, pos, wide, digest) AS (
  SELECT lang, 0, pos, n, leaf FROM p
  UNION ALL
  SELECT * FROM (SELECT lang, level + 1, pos // 2, (wide + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE wide > 1 GROUP BY lang, level, pos // 2, wide)),
s AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE wide = 1),
u(level, pos, wide, digest) AS (
  SELECT 0, pos, n, subroot FROM s
  UNION ALL
  SELECT * FROM (SELECT level + 1, pos // 2, (wide + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE wide > 1 GROUP BY level, pos // 2, wide)),
-- a leaf's way: its place at each level of its language's tree, then at each of the upper one
w AS (
  SELECT p.rid, t.level, (p.pos >> t.level) % 2 AS side, (SELECT any_value(x.digest) FROM t AS x WHERE x.lang IS NOT DISTINCT FROM p.lang AND x.level = t.level AND x.pos = xor(p.pos >> t.level, 1)) AS sibling
  FROM p JOIN (SELECT DISTINCT lang, level FROM t WHERE wide > 1) AS t ON t.lang IS NOT DISTINCT FROM p.lang
  UNION ALL
  SELECT p.rid, 1000 + u.level, (s.pos >> u.level) % 2, (SELECT any_value(x.digest) FROM u AS x WHERE x.level = u.level AND x.pos = xor(s.pos >> u.level, 1))
  FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT DISTINCT level FROM u WHERE wide > 1) AS u),
y AS (SELECT rid, list(coalesce(sibling, '') ORDER BY level) AS siblings, list(side ORDER BY level) AS sides FROM w GROUP BY rid),
z AS (SELECT p.rid, coalesce(siblings, []) AS siblings, coalesce(sides, []) AS sides, coalesce(tampered, leaf) AS digest FROM p LEFT JOIN y USING (rid)),
f(rid, k, siblings, sides, digest) AS (
  SELECT rid, 1, siblings, sides, digest FROM z
  UNION ALL
  SELECT rid, k + 1, siblings, sides, sha256(CASE sides[k] WHEN 1 THEN siblings[k] || digest ELSE digest || siblings[k] END) FROM f WHERE k <= len(siblings)),
r AS (SELECT digest AS root FROM u WHERE wide = 1)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(array_to_string(z.siblings, '')) AS proof_sha256, f.digest AS folded_root, f.digest = r.root AS verified
FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN r JOIN z USING (rid) JOIN f ON f.rid = p.rid AND f.k = len(z.siblings) + 1
"""
