"""Consecutive numbers and running sums over a global order, without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.plans import runtime


def range_parts(df: DataFrame, rows: int = 1 << 20) -> int:
    """Ranges of about ``rows`` rows each, as many as the session's shuffle partitions at least."""
    return runtime.parts_for(df.count(), rows, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def prefix_sums(df: DataFrame, keys: list[str], value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before, in the order of
    ``keys`` (a total order).

    Rows are range-partitioned and written; each range adds up on its own from an
    offset, the sum of the ranges before it (one row per range).
    """
    n = partitions or range_parts(df)
    ranged = df.withColumn("__v", value).repartitionByRange(n, *keys)
    cut = runtime.materialize(ranged.withColumn("__range", F.spark_partition_id()), "prefix")
    sums = cut.groupBy("__range").agg(F.sum("__v").alias("__sum"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sums.select("__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
        .join(offsets, "__range")
        .withColumn(name, (F.col("__before") + F.col("__in")).cast("long"))
        .drop("__range", "__in", "__before", "__v")
    )


def number_rows(df: DataFrame, keys: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order of ``keys`` (a total order)."""
    return prefix_sums(df, keys, F.lit(1).cast("long"), name, partitions)
