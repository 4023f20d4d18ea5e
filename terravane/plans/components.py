"""Connected components of an edge table by alternating stars.

Each half-round rewrites the edges so that nodes hang on the least node of their
neighbourhood (first larger neighbours, then the others); it ends when the edges
are stars around the least node of each component.  Rounds grow with the
logarithm of the component sizes, hubs are pre-aggregated before they are
shuffled, and every round is a written table, so nothing is held on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.plans import runtime


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """node, component: every node of an edge with the least node it reaches.

    Nodes may be of any orderable type.  Loops are ignored (a node with only a
    loop is not returned), as are rows with a null end.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = runtime.materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc", "none")
    before = _mark(now)
    for _ in range(rounds):
        # larger neighbours of a go to the least node of a's neighbourhood
        both = _both(now)
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # then a and its smaller neighbours to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        after = runtime.materialize(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "cc", "none")
        done = _mark(after)
        runtime.forget(now)
        now = after
        if done == before:
            break
        before = done
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
