"""Pruning of skeletons: short branches that end in a leaf are taken off until none is left.

A branch runs from a leaf (one neighbour) to the next vertex with three or more.  Runs of
vertices with two neighbours are contracted to one link that carries their count and
length, so a round costs the same for long and for short branches, and later rounds work
on the links that are left.  A vertex stays a branching one only while it has three
links: of its short branches those with the least leaves go until two links are left,
and what then runs through it is judged as one branch in the next round.  A short path
between two leaves goes whole.  Cycles without branches stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions.vec3 import norm, sub, vec
from terravane.operators import filters
from terravane.plans import components, numbering, runtime


@dataclass
class Pruned:
    """``vertices``: those kept, with ``new_id`` 0, 1, ... in the order of vertex_id; ``edges``:
    edges between them, with their ends' new ids n0 and n1; ``removed``: branches taken off
    (a path between two leaves counts twice, once for each)."""

    vertices: DataFrame
    edges: DataFrame
    removed: int


@dataclass
class _Round:
    """A contraction (link -> chain, vertex -> chain) and the chains and leaves removed after it."""

    links: DataFrame
    inner: DataFrame
    chains: DataFrame
    leaves: DataFrame


def _ends(links: DataFrame) -> DataFrame:
    """v, degree (a loop counts twice), loop."""
    return links.select(F.explode(F.array("a", "b")).alias("v"), (F.col("a") == F.col("b")).alias("loop")).groupBy("v").agg(F.count(F.lit(1)).alias("degree"), F.max("loop").alias("loop"))


def _contract(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chains: e, a, b, n, length; link -> chain; inner vertex -> chain).  A chain is named by
    its least link; one without ends, a cycle by itself, is left out."""
    middle = runtime.materialize(_ends(links).where("degree = 2 AND NOT loop").select("v"), "prune-middle")
    both = links.join(middle.withColumnRenamed("v", "a"), "a", "left_semi").join(middle.withColumnRenamed("v", "b"), "b", "left_semi")
    joined = components.connected_components(both.select("a", "b"))
    named = runtime.materialize(middle.join(joined.withColumnRenamed("node", "v"), "v", "left").select("v", F.coalesce("component", "v").alias("c")), "prune-named")
    of = lambda end: named.select(F.col("v").alias(end), F.col("c").alias(f"c{end}"))
    placed = links.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("c", F.coalesce("ca", "cb"))
    placed = runtime.materialize(placed.withColumn("alone", F.when(F.col("c").isNull(), F.col("e"))), "prune-placed")
    outer = [F.when(F.col(f"c{x}").isNull(), F.col(x)) for x in "ab"]
    inside = F.sum(F.col("ca").isNotNull().cast("long") + F.col("cb").isNotNull().cast("long"))  # every inner vertex is met twice
    whole = placed.groupBy("c", "alone").agg(
        F.min("e").alias("chain"), F.min(F.least(*outer)).alias("a"), F.max(F.greatest(*outer)).alias("b"), (F.sum("n") + inside / 2).cast("long").alias("n"), F.sum("length").alias("length")
    )
    whole = runtime.materialize(whole, "prune-chains")
    link_of = placed.join(whole.select("c", "chain"), "c").select("e", "chain").union(placed.where("c IS NULL").select("e", F.col("e").alias("chain")))
    inner_of = named.join(whole.select("c", "chain"), "c").select("v", "chain")
    return whole.where("a IS NOT NULL").select(F.col("chain").alias("e"), "a", "b", "n", "length"), link_of, inner_of


def _short_ones(chains: DataFrame, short: Column) -> DataFrame:
    """e, leaf, other (the second leaf of a path between two): the chains that go in this round."""
    degree = runtime.materialize(_ends(chains).select("v", "degree"), "prune-degree")
    of = lambda end: degree.select(F.col("v").alias(end), F.col("degree").alias(f"d{end}"))
    ended = chains.join(of("a"), "a").join(of("b"), "b").where("da = 1 OR db = 1").where(short)
    ended = runtime.materialize(ended, "prune-ended")
    paths = ended.where("da = 1 AND db = 1").select("e", F.col("a").alias("leaf"), F.col("b").alias("other"))
    first = F.col("da") == 1
    twigs = ended.where("da > 1 OR db > 1").select("e", F.when(first, F.col("a")).otherwise(F.col("b")).alias("leaf"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("stop"), F.greatest("da", "db").alias("degree"))
    # two links must be left: where too many are short, the one or two with the largest leaves stay
    last = twigs.withColumn("place", F.row_number().over(Window.partitionBy("stop").orderBy(F.desc("leaf")))).where("place <= 2")
    many = twigs.groupBy("stop").agg((F.count(F.lit(1)) - F.max("degree") + 2).alias("spared"))
    spared = last.join(many, "stop").where("place <= spared").select("e")
    gone = twigs.join(spared, "e", "left_anti").select("e", "leaf", F.lit(None).cast("long").alias("other"))
    return paths.union(gone)


def _vertices_of(rounds: list[_Round]) -> DataFrame:
    """All vertices of the chains removed: from the last round's chains down to the first's."""
    gone, chains, above = rounds[0].leaves, None, None
    for r in reversed(rounds):
        chains = r.chains if above is None else r.chains.union(above.links.join(chains.withColumnRenamed("e", "chain"), "chain", "left_semi").select("e"))
        chains = runtime.materialize(chains, "prune-gone")
        gone = gone.union(r.leaves).union(r.inner.join(chains.withColumnRenamed("e", "chain"), "chain", "left_semi").select("v"))
        above = r
    return gone.distinct()


def prune(vertices: DataFrame, edges: DataFrame, min_length: float = 0.0, min_vertices: int = 0) -> Pruned:
    """Branches shorter than ``min_length`` or of fewer than ``min_vertices`` vertices (the
    branching one not counted) go; a bound of 0 is none.  ``vertices``: vertex_id, x, y, z
    (only needed for a length) and attributes; ``edges``: v0, v1 (repeats count once)."""
    pairs = edges.where("v0 <> v1").select(F.least("v0", "v1").alias("a"), F.greatest("v0", "v1").alias("b")).distinct()
    length = F.lit(0.0)
    if min_length > 0:
        at = lambda end, k: vertices.select(F.col("vertex_id").alias(end), *[F.col(c).cast("double").alias(f"{c}{k}") for c in "xyz"])
        pairs, length = pairs.join(at("a", 0), "a").join(at("b", 1), "b"), norm(sub(vec(suffix="1"), vec(suffix="0")))
    links = pairs.select(F.monotonically_increasing_id().alias("e"), "a", "b", F.lit(0).cast("long").alias("n"), length.alias("length"))
    now, rounds, removed = runtime.materialize(links, "prune-links"), [], 0
    short = F.lit(False)
    if min_length > 0:
        short = short | (F.col("length") < min_length)
    if min_vertices > 0:
        short = short | (F.col("n") + 1 < min_vertices)
    while True:
        chains, link_of, inner_of = _contract(now)
        found = runtime.materialize(_short_ones(chains, short), "prune-short")
        tally = found.agg(F.count("leaf").alias("one"), F.count("other").alias("two")).first()
        if not tally["one"]:
            break
        removed += tally["one"] + tally["two"]
        leaves = found.select(F.col("leaf").alias("v")).union(found.where("other IS NOT NULL").select("other"))
        rounds.append(_Round(link_of, inner_of, found.select("e"), leaves))
        now = runtime.materialize(chains.join(found.select("e"), "e", "left_anti"), "prune-links")
    kept = vertices
    if rounds:
        kept = vertices.join(_vertices_of(rounds).withColumnRenamed("v", "vertex_id"), "vertex_id", "left_anti")
    kept = runtime.materialize(numbering.number_rows(kept, ["vertex_id"], "new_id"), "pruned")
    number = lambda k: kept.select(F.col("vertex_id").alias(f"v{k}"), F.col("new_id").alias(f"n{k}"))
    left = filters.edges_within(edges, kept).join(number(0), "v0").join(number(1), "v1")
    return Pruned(kept, left, removed)
