r"""MinHash near-dedup with min-max signatures, confirmed on full shingle sets.

Sketch.  A text's set holds its distinct five-word shingles (fewer words: the
whole sequence as one).  Each permutation of the shingle hashes contributes both
its minimum and its maximum, two unbiased and negatively correlated estimates for
one evaluation.  Bands of ``rows`` minima, and of the same permutations' maxima,
are the bucket keys; with 6 rows and 32 bands a pair at similarity 0.85 shares no
bucket with probability 3e-7.

Confirmation, without comparing all pairs of a bucket:
1. Documents with equal sets are one class; only classes go on.
2. In every bucket the member that meets most others (its hub) is compared with
   each other member on the full sets.  D(m) is the symmetric difference of member
   m and hub.
3. Components of the links so far are found by alternating stars.  A link that would
   join two of them has an end that is not linked with the hub, and then the two D must
   overlap: |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|.  A prefix filter over the
   elements of the D (``_live``) leaves the members that may have such a partner; a
   family of texts that only share a template with the hub ends here, at a cost in
   proportion to its D.
4. The members left are compared through an inverted index of their D, which decides
   exactly.  Hubs with many members left are cut into blocks; a task holds two at most.
   The components are then closed once more.

No link between documents that share a bucket is lost, and none is unconfirmed
(shingles are 64-bit hashes of their words, sets 128-bit ones).

Defined results
* null or empty text, or no word: n_shingles 0, linked with nothing.
* Ties and repeated rows: rows with equal sets share a component, whose id is its
  smallest doc_id; a group with only null ids has a null component and is kept.
* Empty table: empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm import tokens
from terravane.plans import components, runtime

SHINGLE = 5
_P = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([1, 2], np.uint64) * _P


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each text plus the end): each text's distinct shingles, ascending."""
    padded, starts, lengths, first = tokens.words(data, offsets, tokens.NOT_SPACE)
    w = tokens.hashes(padded, starts, lengths)
    n = np.diff(first)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    place = np.repeat(first[:-1] - at[:-1], many) + np.arange(at[-1])
    wide = np.concatenate([w, np.zeros(size, np.uint64)])
    left = np.minimum(np.repeat(first[1:], many) - place, size)
    h = tokens.mix(left.astype(np.uint64) + _P)
    for k in range(size):
        h = h * _P + np.where(left > k, wide[place + k], np.uint64(0))
    h = tokens.mix(h)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][many > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[at]


def set_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bytes for each set: two sums of scrambled elements; zeros if empty."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, 2), np.uint64)
    if len(some):
        for c in (0, 1):
            out[some, c] = tokens.mix(np.add.reduceat(tokens.mix(h + _SALTS[c]), first[:-1][some]))
    return out


def bands_of(h: np.ndarray, first: np.ndarray, rows: int, bands: int, seed: int = 7) -> np.ndarray:
    """Bucket keys of each non-empty set: ``bands`` of them, half from minima."""
    groups = bands // 2
    draw = np.random.default_rng(seed)
    odd = draw.integers(0, 1 << 63, (groups, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = draw.integers(0, 1 << 63, (groups, rows), dtype=np.uint64)
    at = first[:-1][np.diff(first) > 0]
    out = np.empty((len(at), bands), np.uint64)
    for g in range(groups):
        low, high = np.full(len(at), np.uint64(2 * g + 1)), np.full(len(at), np.uint64(2 * g + 2))
        for r in range(rows):
            v = (h ^ flip[g, r]) * odd[g, r]
            low = tokens.mix(low * _P + np.minimum.reduceat(v, at))
            high = tokens.mix(high * _P + np.maximum.reduceat(v, at))
        out[:, 2 * g], out[:, 2 * g + 1] = low, high
    return out


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of 16 bytes as binary values; all-zero rows are null."""
    raw = np.ascontiguousarray(rows).tobytes()
    null = ~rows.any(axis=1)
    values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(rows), [None, pa.py_buffer(raw)]).cast(pa.binary())
    return pa.compute.if_else(pa.array(null), pa.scalar(None, pa.binary()), values)


_SKETCH = T.StructType(
    [T.StructField("n_shingles", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType(), False))]
)


def sketches(docs: DataFrame, text_col: str = "text", rows: int = 6, bands: int = 32, keep_text: bool = False) -> DataFrame:
    """Input columns plus n_shingles, node (the set's id, null if empty) and bands."""

    def sketch(data, offsets, batch):
        h, first = shingle_sets(data, offsets)
        n = np.diff(first)
        keys = bands_of(h, first, rows, bands) if len(h) else np.zeros((0, bands), np.uint64)
        at = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
        return {
            "n_shingles": pa.array(n, pa.int64()),
            "node": _fixed(set_ids(h, first)),
            "bands": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
        }

    return tokens.add_columns(docs, sketch, _SKETCH, text_col, keep_text, most=2 << 20)


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, shingles (binary, ascending) of the wanted (id, text_hash, node) rows; an id may be null."""
    added = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    def fill(data, offsets, batch):
        h, first = shingle_sets(data, offsets)
        at = pa.array(first * 8, pa.int64())
        raw = pa.py_buffer(h.tobytes())
        sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, at.buffers()[1], raw]).cast(pa.binary())
        return {"node": _fixed(set_ids(h, first)), "shingles": sets}

    # the wanted rows build the hash table, so texts are shuffled but not sorted
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    built = wanted.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("node").alias("wanted"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    some = some.join(built.hint("shuffle_hash"), same)
    made = tokens.add_columns(some.select("wanted", "text"), fill, added, "text", False, most=2 << 20)
    return made.where("wanted = node").groupBy("node").agg(F.first("shingles").alias("shingles"))


_COMPARED = T.StructType(
    [
        T.StructField("hub", T.BinaryType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("n", T.LongType()),
        T.StructField("n_hub", T.LongType()),
        T.StructField("linked", T.BooleanType()),
        T.StructField("apart", T.ArrayType(T.LongType(), False)),
    ]
)


def _compare(low: int, high: int):
    """Kernel: exact comparison of hub and member sets; 100 * |a & b| >= 85 * |a | b|
    is ``high * |a ^ b| <= low * (|a| + |b|)`` with low 15 and high 185."""

    def run(batches):
        for batch in batches:
            hub, node, a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("hub", "node", "a", "b"))
            n, n_hub, linked, apart = [], [], [], []
            for x, y in zip(a, b, strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                d = np.setxor1d(u, v, assume_unique=True)
                n.append(len(v)), n_hub.append(len(u)), apart.append(d.view(np.int64))
                linked.append(high * len(d) <= low * (len(u) + len(v)))
            at = np.concatenate([[0], np.cumsum([len(d) for d in apart])])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *apart])))
            yield pa.RecordBatch.from_arrays(
                [hub, node, pa.array(n, pa.int64()), pa.array(n_hub, pa.int64()), pa.array(linked, pa.bool_()), lists], names=_COMPARED.names
            )

    return run


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of 0..n-1 reaches over edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _lookup(low: int, high: int):
    """Kernel for one (hub, block, block): links between members not linked with
    the hub (side y) and all members (side x), reduced to a spanning set."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = np.array(table.column("side").to_pylist())
        names = table.column("node").to_pylist()
        size = table.column("n").to_numpy()
        column = table.column("apart").combine_chunks()
        values, ends = column.values.to_numpy(), column.offsets.to_numpy()
        sets = [np.sort(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        xs, ys = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        number = {name: i for i, name in enumerate(dict.fromkeys(names))}
        of = np.array([number[x] for x in names], np.int64)
        apart = np.array([len(s) for s in sets], np.int64)
        element = np.concatenate([sets[i] for i in xs] or [np.zeros(0, np.int64)])
        owner = np.repeat(xs, apart[xs])
        order = np.argsort(element, kind="stable")
        element, owner = element[order], owner[order]
        ends_a, ends_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for y in ys:
            lo, hi = np.searchsorted(element, sets[y], "left"), np.searchsorted(element, sets[y], "right")
            count = np.zeros(len(of), np.int64)
            for k in range(0, len(lo), 4096):
                a, b = lo[k : k + 4096], hi[k : k + 4096]
                m = b - a
                at = np.repeat(a - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(int(m.sum()))
                count += np.bincount(owner[at], minlength=len(of))
            x = np.flatnonzero(count)
            x = x[(of[x] != of[y]) & (high * (apart[x] + apart[y] - 2 * count[x]) <= low * (size[x] + size[y]))]
            ends_a.append(np.full(len(x), of[y])), ends_b.append(of[x])
        label = _least_labels(len(number), np.concatenate(ends_a), np.concatenate(ends_b))
        own = list(number)
        joined = np.flatnonzero(label != np.arange(len(own)))
        return pa.table({"a": pa.array([own[i] for i in joined], pa.binary()), "b": pa.array([own[label[i]] for i in joined], pa.binary())})

    return run


def _live(here: DataFrame, low: int, high: int) -> DataFrame:
    """hub, node of the members that may have a link across components which is not yet known.

    here: hub, node, component, n, n_hub, linked, apart of hubs whose members fall into
    several components.  A link with a member that is not linked with the hub needs
    |D(x) & D(y)| >= (v(x) + v(y)) / 2 for v(m) = |D(m)| - low / high * |m|, and v is more
    than low / high * |hub| for those not linked with the hub, at most that for the
    others.  So with all D in one order, rarest elements first, the two share an element
    within a prefix of each: a short one for the member with the smaller v, a long one for
    the other.  Elements that lie in no short prefix, or in one component only, are dead,
    and so are members without a live one.  What is shuffled grows with the D themselves.
    """
    member = here.select("hub", "node", "component", "linked", "n", "n_hub", F.size("apart").alias("d"))
    each = here.select("hub", "node", F.explode("apart").alias("e"))
    common = each.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = each.join(common, ["hub", "e"]).groupBy("hub", "node").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("es"))
    # twice high times the least overlap, in whole numbers; elements held by one member come first and match nothing
    v = f"({high} * d - {low} * n)"
    short = f"CASE WHEN linked THEN d - greatest(1, ceil(({v} + {low} * n_hub) / {2 * high}D)) + 1 ELSE d - greatest(1, ceil({v} / {high}D)) + 1 END"
    long = f"CASE WHEN linked THEN 0 ELSE d - greatest(1, ceil(({v} - {low} * n_hub) / {2 * high}D)) + 1 END"
    sized = member.join(shared, ["hub", "node"]).selectExpr("hub", "node", "component", "es", f"{short} - (d - size(es)) AS short", f"{long} - (d - size(es)) AS long")
    heads = sized.where("greatest(short, long) > 0").selectExpr(
        "hub", "node", "component", "short", "posexplode(slice(es, 1, cast(greatest(short, long) AS int))) AS (place, z)"
    ).selectExpr("hub", "node", "component", "z.e AS e", "place < short AS near")
    heads = runtime.materialize(heads, "near-heads", "none")
    live = heads.groupBy("hub", "e").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.max("near").alias("near")).where("near AND a <> b")
    return heads.join(live.select("hub", "e"), ["hub", "e"], "left_semi").select("hub", "node").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, text_hash, n_shingles, component_id and kept, one row per input row."""
    return _grouped(docs, id_col, text_col, **options).drop("group")


def _grouped(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    rows: int = 6,
    bands: int = 32,
    block_members: int = 1024,
    block_elements: int = 1 << 23,
) -> DataFrame:
    """The columns of ``near_duplicates``, and group: the least node of the row's group (null without words)."""
    low, high = 100 - percent, 100 + percent
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketched = runtime.materialize(sketches(ids, "text", rows, bands), "near-sketches", "none")
    # equal sets are one class, known by the set's id
    classes = runtime.materialize(
        sketched.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "text_hash")).alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .select("node", "least.id", "least.text_hash", "n", "bands"),
        "near-classes", "none",
    )
    keyed = classes.select("node", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    members = runtime.materialize(keyed.join(crowded, "key"), "near-buckets", "none")
    met = members.groupBy("node").agg(F.sum("crowd").alias("known"))
    hubs = members.join(met, "node").groupBy("key").agg(F.max(F.struct("known", "node")).alias("h")).select("key", F.col("h.node").alias("hub"))
    pairs = runtime.materialize(members.join(hubs, "key").where("node <> hub").select("hub", "node").distinct(), "near-pairs", "none")
    involved = pairs.select("node").union(pairs.select(F.col("hub").alias("node"))).distinct()
    wanted = classes.select("node", "id", "text_hash").join(involved, "node", "left_semi")
    sets = runtime.materialize(_sets_of(docs, wanted, id_col, text_col), "near-sets", "none")
    both = pairs.join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("a")), "hub").join(
        sets.select("node", F.col("shingles").alias("b")), "node"
    )
    compared = runtime.materialize(both.select("hub", "node", "a", "b").mapInArrow(_compare(low, high), _COMPARED), "near-compared", "none")
    direct = compared.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    known = components.connected_components(direct)
    # hubs whose members fall into several components, and the members of these that may join them
    both_ends = compared.join(known.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    both_ends = both_ends.join(known.select(F.col("node").alias("hub"), F.col("component").alias("of_hub")), "hub", "left")
    placed = runtime.materialize(both_ends.withColumn("of_hub", F.coalesce("of_hub", "hub")), "near-placed", "none")
    apart = placed.where("component <> of_hub").groupBy("hub").agg(F.count(F.lit(1)).alias("loose"))
    here = placed.join(apart.select("hub"), "hub", "left_semi")
    left = runtime.materialize(here.join(_live(here, low, high), ["hub", "node"], "left_semi"), "near-left", "none")
    # of those, members outside the hub's component against all others, block by block, a block
    # being bounded by its members and by the elements of their differences together;
    # the counts are a table of their own, so that the join with them can be split where a hub is large
    counts = (
        left.groupBy("hub")
        .agg(
            F.count(F.lit(1)).alias("all"),
            F.sum((F.col("component") != F.col("of_hub")).cast("long")).alias("loose"),
            F.sum(F.size("apart").cast("long")).alias("size_all"),
            F.sum(F.when(F.col("component") != F.col("of_hub"), F.size("apart").cast("long")).otherwise(0)).alias("size_loose"),
        )
        .where("loose > 0 AND all > 1")
        .select(
            "hub",
            *[F.greatest(F.ceil(F.col(n) / block_members), F.ceil(F.col(f"size_{n}") / block_elements)).alias(b) for n, b in (("all", "nx"), ("loose", "ny"))],
        )
    )
    groups = runtime.materialize(counts, "near-groups", "none")
    some = left.join(groups, "hub").select("hub", "node", "n", "apart", "nx", "ny", F.expr("component <> of_hub").alias("loose"), F.xxhash64("node").alias("h"))
    xs = some.select("hub", "node", "n", "apart", F.lit(0).alias("side"), F.expr("pmod(h, nx)").alias("bx"), F.explode(F.expr("sequence(0L, ny - 1)")).alias("by"))
    ys = some.where("loose").select(
        "hub", "node", "n", "apart", F.lit(1).alias("side"), F.explode(F.expr("sequence(0L, nx - 1)")).alias("bx"), F.expr("pmod(h, ny)").alias("by")
    )
    # dealt by block: the join above leaves rows dealt by hub, which would keep all blocks of a hub in one task
    blocks = xs.unionByName(ys).repartition("hub", "bx", "by")
    further = runtime.materialize(blocks.groupBy("hub", "bx", "by").applyInArrow(_lookup(low, high), "a binary, b binary"), "near-further", "none")
    grouped = known if further.isEmpty() else components.connected_components(direct.union(further))
    least = grouped.join(classes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("component_id"))
    merged = grouped.join(least, "component").select("node", "component", "component_id")
    final = runtime.materialize(
        classes.select("node", "id")
        .join(merged, "node", "left")
        .select("node", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("component", "node").alias("group")),
        "near-components", "none",
    )
    out = sketched.select("id", "text_hash", "n_shingles", "node").join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    done = out.select("id", "text_hash", "n_shingles", component.alias("component_id"), "group")
    return done.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, one of each group, with their own columns.

    Where the kept id stands for several texts, or for none, the one with the least
    hash stays; of rows that repeat its id and text any one.  Rows without words all stay.
    """
    kept = _grouped(docs, **options).where("kept")
    same_text = kept.where("group IS NOT NULL").groupBy("group", "id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    one = same_text.groupBy("group").agg(F.min(F.struct("text_hash", "id", "n")).alias("c")).select("c.id", "c.text_hash", "c.n")
    empty = kept.where("group IS NULL").select("id", "text_hash").distinct().withColumn("n", F.lit(1).cast("long"))
    found = runtime.materialize(one.union(empty).toDF("__id", "__hash", "__n"), "near-kept", "none")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    single = docs.join(found.where("__n = 1").hint("shuffle_hash"), same, "left_semi")
    repeated = found.where("__n > 1")
    if repeated.isEmpty():
        return single
    several = docs.join(repeated.hint("shuffle_hash"), same, "left_semi").withColumn("__hash", F.xxhash64("text"))
    return single.union(several.dropDuplicates(["doc_id", "__hash"]).drop("__hash"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[p:p + 4], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
ee AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, l) USING KEY (v) AS (
  SELECT a, a FROM (SELECT DISTINCT a FROM ee)
  UNION
  SELECT ee.b, min(r.l) FROM r JOIN ee ON ee.a = r.v JOIN recurring.r x ON x.v = ee.b
  WHERE r.l < x.l GROUP BY ee.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(r.l, d.doc_id) AS component_id,
       coalesce(r.l, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.v = d.doc_id
"""
