"""Choosing which objects or points a coarser level keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions.vec3 import cells
from terravane.plans.numbering import number_rows

BIN = ["gx", "gy", "gz"]


#: Up to so many rows a bounded heap per task keeps the first ones; beyond, rows are numbered by ranges.
HEAP = 10_000


def first(rows: DataFrame, keys: list, k: int, heap: int = HEAP) -> DataFrame:
    """The first k rows in the order of ``keys`` (a total order)."""
    if k <= heap:
        return rows.orderBy(*keys).limit(k)
    return number_rows(rows, keys, "__nth").where(F.col("__nth") < k).drop("__nth")


def top(objects: DataFrame, column: str, k: int, largest: bool = True, heap: int = HEAP) -> DataFrame:
    """The k objects with the largest (or smallest) value; ties by object_id."""
    return first(objects, [F.desc(column) if largest else F.asc(column), F.asc("object_id")], k, heap)


def sample(objects: DataFrame, k: int, seed: int = 0, heap: int = HEAP) -> DataFrame:
    """k objects drawn by a seeded hash of their ids: the least MD5 digests of ``seed:id``."""
    return first(objects, [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("object_id").cast("string"))).asc(), F.asc("object_id")], k, heap)


def thin(points: DataFrame, shape: tuple, id_col: str = "vertex_id", seed: int | None = None) -> DataFrame:
    """One point per bin: the lowest id, or with a seed the lowest hash."""
    rank = F.struct(F.xxhash64(id_col, F.lit(seed)), id_col) if seed is not None else F.col(id_col)
    best = points.withColumns(cells(shape)).groupBy(*BIN).agg(F.min_by(id_col, rank).alias(id_col))
    return best.select(id_col)


def cover(points: DataFrame, shape: tuple, k: int, id_col: str = "object_id") -> DataFrame:
    """k points spread over the bins: one from each bin (bins by their lowest id), then
    the rest in proportion to the bins' further members, what is left over by weight."""
    placed = points.withColumns(cells(shape))
    member = Window.partitionBy(*BIN).orderBy(id_col)
    ranked = placed.withColumn("place", F.row_number().over(member))
    bins = placed.groupBy(*BIN).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("lead"))
    row = bins.agg(F.count(F.lit(1)).alias("bins"), F.sum(F.col("n") - 1).alias("more")).first()
    if k <= row["bins"]:
        return first(bins, [F.asc("lead")], k).select(F.col("lead").alias(id_col))
    spare, more = min(k - row["bins"], row["more"]), max(1, row["more"])
    share = bins.withColumn("extra", F.floor(F.lit(spare) * (F.col("n") - 1) / F.lit(float(more))).cast("long"))
    left = spare - share.agg(F.sum("extra")).first()[0]
    # left < number of bins: one more for each of the heaviest bins
    lucky = first(share, [F.desc(F.col("n") - 1), F.asc("lead")], max(0, left)).select(*BIN, F.lit(1).cast("long").alias("one"))
    allowed = share.join(lucky, BIN, "left").select(*BIN, (F.lit(1) + F.col("extra") + F.coalesce("one", F.lit(0))).alias("take"))
    return ranked.join(allowed, BIN).where("place <= take").select(id_col)


def kept_count(total: int, share: float) -> int:
    """max(1, total * share rounded half to even), at most total."""
    return min(total, max(1, round(total * share)))


def apply_sparsity(objects: DataFrame, share: float, strategy: str = "random", column: str | None = None, points: DataFrame | None = None, shape: tuple | None = None, seed: int = 0, basis: int | None = None) -> DataFrame:
    """The objects that stay when a share of ``basis`` (by default: of those given) is kept."""
    if share >= 1.0:
        return objects.select("object_id")
    total = objects.count()
    k = min(total, kept_count(basis or total, share)) if basis else kept_count(total, share)
    if strategy == "random":
        return sample(objects, k, seed).select("object_id")
    if strategy in ("length", "attribute"):
        if column is None:
            raise ValueError(f"strategy {strategy!r} needs a column")
        return top(objects, column, k).select("object_id")
    if strategy in ("coverage", "thinning"):
        if points is None or shape is None:
            raise ValueError(f"strategy {strategy!r} needs points and a bin shape")
        if strategy == "coverage":
            return cover(points, shape, k)
        return first(thin(points, shape, "object_id"), [F.asc("object_id")], k)
    raise ValueError(f"unknown strategy {strategy!r}")
