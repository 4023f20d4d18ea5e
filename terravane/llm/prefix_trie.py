r"""Conversation prefix trie: every distinct run of first turns, with members and savings.

Conversations are sequences of turns (role, text); every distinct sequence of their
first d turns is a node of depth d, under a root of depth 0 without text.  A node is
known by the sums, in two lanes of 60 bits, of its turns' digests, each taken with its
depth: sums can be made along a conversation in pieces, so a conversation is cut into
stretches of ``STRETCH`` turns and no task needs more than a stretch at a time.

1. *Partial tries.*  Each task combines the rows of a node that it meets (a partial
   aggregate before any exchange): members, least member, last text's bytes.
2. *Tree merges.*  The partial node tables are merged by node and one of ``FAN`` salts,
   then by node, so a node that all conversations share meets in a few rows.
   The lists of conversations that end at a node are merged in ascending order: runs of
   ids, ranged by node and id, become texts of at most ``RUN`` ids each, and a node's
   texts pass through its digest one after the other; no list is ever whole in memory.
3. *Bottom-up rollup.*  A node with one member has nothing to sum up below it.  The others
   hand their sums to the ancestor one step up, then two, four, ... steps up, until the
   root has all: rounds grow with the logarithm of the depth.

Defined results
* Turns are ordered by turn (null first), then role, then text; equal rows are turns of
  their own.  null role or text: empty.
* A conversation without turns ends at the root.  The null conv_id is a member too: it
  counts in n_convs, is never the least while others are there, and leaves no id in
  the list of ends.
* Empty table: no node.  Only conv_id, turn, role and text are read, whatever other
  columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.plans import numbering, runtime

#: Turns in a stretch of a conversation, and ids in a text of ends.
STRETCH, RUN = 4096, 16_384
#: Salts of the first merge of a node's partial rows.
FAN = 16

_KEY = ["k0", "k1"]
_NUMBER = "decimal(38,0)"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, i (0, 1, ... in the order of turns), role, text."""
    clean = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    # a row's number splits equal rows between ranges; it is written, so it stays as it is
    written = runtime.materialize(clean.withColumn("row", F.monotonically_increasing_id()), "trie-turns")
    placed = runtime.materialize(numbering.number_rows(written, ["conv_id", "turn", "role", "text", "row"], "__n"), "trie-numbered")
    first = placed.groupBy("conv_id").agg(F.min("__n").alias("first")).withColumnRenamed("conv_id", "c")
    return placed.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", (F.col("__n") - F.col("first")).alias("i"), "role", "text")


def _lane(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast(_NUMBER)


def partial_tries(turns: DataFrame, members: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row a member and depth: k0, k1 (the node), p0, p1 (its parent; null at the root),
    conv_id, depth, bytes.

    ``turns``: conv_id, depth (1, 2, ...), digest (of role and text), bytes; ``members``:
    conv_id, n_turns."""
    own = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest"), 256)
    lanes = turns.select("conv_id", "depth", "bytes", F.floor((F.col("depth") - 1) / stretch).cast("long").alias("stretch"), *[_lane(own, k).alias(f"d{k}") for k in (0, 1)])
    lanes = runtime.materialize(lanes, "trie-lanes")
    # sums of the stretches before, for conversations of more than one
    whole = lanes.groupBy("conv_id", "stretch").agg(*[F.sum(f"d{k}").cast(_NUMBER).alias(f"s{k}") for k in (0, 1)])
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = whole.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), *[F.sum(f"s{k}").over(before).cast(_NUMBER).alias(f"b{k}") for k in (0, 1)]).where("s > 0")
    along = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = lanes.withColumns({f"i{k}": F.sum(f"d{k}").over(along).cast(_NUMBER) for k in (0, 1)})
    joined = summed.join(earlier, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s")), "left")
    keyed = joined.select("conv_id", "depth", "bytes", *[(F.col(f"i{k}") + F.coalesce(f"b{k}", F.lit(0))).cast(_NUMBER).alias(f"k{k}") for k in (0, 1)], "d0", "d1")
    nodes = keyed.select("conv_id", "depth", "bytes", *_KEY, *[(F.col(f"k{k}") - F.col(f"d{k}")).cast(_NUMBER).alias(f"p{k}") for k in (0, 1)])
    zero, none = F.lit(0).cast(_NUMBER), F.lit(None).cast(_NUMBER)
    roots = members.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), zero.alias("k0"), zero.alias("k1"), none.alias("p0"), none.alias("p1"))
    return nodes.unionByName(roots)


def merge_tries(rows: DataFrame) -> DataFrame:
    """Node tables merged by node and salt, then by node: k0, k1, p0, p1, depth, bytes,
    conv_id (least member), n_convs."""
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(FAN))
    whole = [*_KEY, "p0", "p1", "depth", "bytes"]  # all but the key follow from it
    first = rows.groupBy(*whole, salt.alias("salt")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    return first.groupBy(*whole).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"))


def merge_ends(rows: DataFrame, run: int = RUN) -> DataFrame:
    """k0, k1, ends_sha256 of the ids (k0, k1, conv_id) that end at each node, ascending."""
    spark = rows.sparkSession
    ids = runtime.materialize(rows.where("conv_id IS NOT NULL").select(*_KEY, "conv_id"), "trie-ends")
    parts = runtime.parts_for(ids.count(), 1 << 20, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = ids.repartitionByRange(parts, *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a node's ids as one text each."""
        for batch in batches:
            k0, k1, ids = (batch.column(k).to_pylist() for k in range(3))
            begun = 0
            out: dict[str, list] = {"k0": [], "k1": [], "conv_id": [], "text": []}
            for k in range(1, len(ids) + 1):
                if k == len(ids) or (k0[k], k1[k]) != (k0[begun], k1[begun]) or k - begun == run:
                    for name, value in zip(out, (k0[begun], k1[begun], ids[begun], ",".join(map(str, ids[begun:k]))), strict=True):
                        out[name].append(value)
                    begun = k
            yield pa.RecordBatch.from_arrays([pa.array(out["k0"], batch.schema.field(0).type), pa.array(out["k1"], batch.schema.field(1).type), pa.array(out["conv_id"], pa.int64()), pa.array(out["text"], pa.string())], names=list(out))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One digest a node, its texts taken in order."""
        node, state, kind = None, None, None

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node[0]], kind), pa.array([node[1]], kind), pa.array([state.hexdigest()], pa.string())], names=[*_KEY, "ends_sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(3), strict=True):
                if key != node:
                    if node is not None:
                        yield ended()
                    node, state = key, hashlib.sha256(text.as_py().encode())
                else:
                    state.update(b"," + text.as_py().encode())
        if node is not None:
            yield ended()

    runs = runtime.materialize(ranged.mapInArrow(texts, f"k0 {_NUMBER}, k1 {_NUMBER}, conv_id long, text string"), "trie-runs")
    dealt = runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id")
    return dealt.mapInArrow(digests, f"k0 {_NUMBER}, k1 {_NUMBER}, ends_sha256 string")


def rollup(nodes: DataFrame) -> DataFrame:
    """k0, k1, n_leaves, saved_tokens over each node's subtree; ``nodes`` is a written table."""
    children = nodes.where("p0 IS NOT NULL").groupBy(F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone")
    )
    placed = runtime.materialize(nodes.join(children, _KEY, "left").fillna(0, ["n_children", "lone"]), "trie-children")
    # a node of one member ends a rollup: it has one leaf below and saves nothing
    shared = placed.where("n_convs > 1").select(
        *_KEY, "p0", "p1", (F.col("lone") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
    )
    now = runtime.materialize(shared, "trie-rollup")
    totals = [F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")]
    while not (climbing := now.where("p0 IS NOT NULL")).isEmpty():
        handed = climbing.select(F.col("p0").alias("k0"), F.col("p1").alias("k1"), "n_leaves", "saved_tokens")
        summed = now.select(*_KEY, "n_leaves", "saved_tokens").union(handed).groupBy(*_KEY).agg(*totals)
        above = now.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("p0").alias("q0"), F.col("p1").alias("q1")).where("q0 IS NOT NULL")
        # many nodes may stand on one: this join is written as it is, so its large keys can be split
        ahead = runtime.materialize(climbing.select(*_KEY, "p0", "p1").join(above, ["p0", "p1"]).select(*_KEY, F.col("q0").alias("p0"), F.col("q1").alias("p1")), "trie-ahead")
        after = runtime.materialize(summed.join(ahead, _KEY, "left").select(*_KEY, "p0", "p1", "n_leaves", "saved_tokens"), "trie-rollup")
        runtime.forget(now, ahead)
        now = after
    lone = placed.where("n_convs = 1").select(*_KEY, F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    sums = now.select(*_KEY, "n_leaves", "saved_tokens").union(lone)
    return placed.drop("lone").join(sums, _KEY)


def build(turns: DataFrame, members: DataFrame, stretch: int = STRETCH, run: int = RUN) -> DataFrame:
    """The trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  ``turns``: conv_id, depth, digest, bytes; ``members``:
    conv_id, n_turns (0 too)."""
    rows = runtime.materialize(partial_tries(turns, members, stretch), "trie-partial")
    nodes = runtime.materialize(merge_tries(rows), "trie-nodes")
    last = members.select(F.col("conv_id").alias("c"), F.col("n_turns").alias("d"))
    ends = merge_ends(rows.join(last, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("depth") == F.col("d"))), run)
    whole = runtime.materialize(rollup(nodes).join(ends, _KEY, "left"), "trie-whole")
    parents = nodes.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parents, ["p0", "p1"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )


def turn_digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def grafted(turns: DataFrame, family: int = 5, span: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of the conversations rebuilt: conversation c takes its first h turns
    from conversation c - c % family (h = crc32(c) % span), then goes on with its own
    turns after its first h.  ``turns``: conv_id, i, role, text."""
    brief = turns.select("conv_id", "i", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    brief = runtime.materialize(brief, "trie-brief")
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % span, F.lit(0))
    convs = runtime.materialize(brief.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.pmod("conv_id", F.lit(family))}), "trie-convs")
    held = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = convs.join(held, "base", "left").select("conv_id", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"))
    plan = runtime.materialize(plan.withColumn("n_turns", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "trie-plan")
    to = plan.select(F.col("conv_id").alias("c"), "base", "h", "taken")
    tail = brief.join(to, F.col("conv_id").eqNullSafe(F.col("c"))).where("i >= h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h") + 1).alias("depth"), "digest", "bytes")
    head = brief.where(f"i < {span}").withColumnRenamed("conv_id", "base").join(to, "base").where("i < taken").select(F.col("c").alias("conv_id"), (F.col("i") + 1).alias("depth"), "digest", "bytes")
    return tail.union(head), plan.select("conv_id", "n_turns")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return build(*grafted(turns))


OP11_SQL = """
WITH o AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS n,
         xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
             lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))]),
             lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h
  FROM o GROUP BY conv_id),
r AS (
  SELECT c.conv_id, 0 AS own, o.i, o.role, o.text FROM c JOIN o ON o.conv_id = c.base AND o.i < c.h
  UNION ALL
  SELECT c.conv_id, 1, o.i, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.i >= c.h),
k AS (
  SELECT conv_id, text, row_number() OVER w AS depth, sha256(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '' ) OVER (w ROWS UNBOUNDED PRECEDING)) AS node
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, i)),
m AS (
  SELECT conv_id, 0 AS depth, 'root' AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS bytes FROM c
  UNION ALL
  SELECT conv_id, depth, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), 'root'), strlen(text) FROM k),
e AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
      FROM (SELECT conv_id, arg_max(node, depth) AS node FROM m GROUP BY conv_id) GROUP BY node),
n AS (SELECT node, parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM m GROUP BY node, parent, depth),
q AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
-- a node's subtree: the nodes whose least member has it among its prefixes
u AS (SELECT m.node, sum(CASE WHEN q.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
      FROM n LEFT JOIN q USING (node) JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(q.n_children, 0) AS BIGINT) AS n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n AS p ON p.node = n.parent LEFT JOIN q ON q.node = n.node JOIN u ON u.node = n.node LEFT JOIN e ON e.node = n.node
"""
