"""Groups that fit a task solved in it: many of them a batch, none larger than a bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group that one task may hold, and rows gathered before a kernel runs over whole groups.
MOST, GATHERED = 1 << 18, 1 << 16


def split(df: DataFrame, key: str = "object_id", most: int = MOST) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of groups of at most ``most`` rows, rows of larger ones); either is None where
    there is none.  A table without the key column is one group, of key 0."""
    if key not in df.columns:
        keyed = df.withColumn(key, F.lit(0).cast("long"))
        return (keyed, None) if df.count() <= most else (None, df)
    large = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col(key).alias("__large"))
    if large.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("__large"))
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def solve(df: DataFrame, kernel: Callable[[pa.Table], pa.Table], schema: str, key: str = "object_id", gathered: int = GATHERED, parts: int | None = None) -> DataFrame:
    """``kernel`` over tables of whole groups.  Rows come sorted by group; a task holds what it
    has gathered, one batch and the group that the batch cuts.  ``parts`` fixes how many tasks
    share the groups, for kernels whose work is not in proportion to bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < gathered:
                continue
            table = pa.concat_tables(held).combine_chunks()
            k = table.column(key)
            last = k[-1].as_py()
            other = pc.is_valid(k) if last is None else pc.invert(pc.equal(k, last).fill_null(False))
            cut = int(np.count_nonzero(other.to_numpy()))  # sorted, so the last group is a tail
            if cut:
                yield from kernel(table.slice(0, cut)).to_batches()
            held = [table.slice(cut)]
        if held:
            yield from kernel(pa.concat_tables(held).combine_chunks()).to_batches()

    spread = df.repartition(key) if parts is None else df.repartition(parts, key)
    return spread.sortWithinPartitions(key).mapInArrow(run, schema)
