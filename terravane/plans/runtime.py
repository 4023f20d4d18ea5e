"""Lineage cuts in storage that every executor shares, and input sizing.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``; a
machine-local folder is used only where that setting is absent (tests on one
machine).  Nothing here relies on executor-local copies, so losing an executor
only costs the recomputation of its own tasks.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
#: Bytes of a table's files up to which a round may broadcast it.  Files of ids are several
#: times smaller than their rows, and a broadcast passes through the driver.
BROADCAST_BYTES = 1 << 20
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, read from the session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="terravane-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _bytes(text: str) -> int:
    """A size as Spark's settings write it: 10485760b, 256k, 10MB, -1."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", text.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit[:1]]


@contextmanager
def _round_settings(spark: SparkSession):
    """Shuffle files of the enclosed writes go when each write has ended, and their joins
    broadcast tables of at most ``BROADCAST_BYTES``."""
    before = {name: spark.conf.get(name, None) for name in (_CLEANUP, _BROADCAST)}
    try:
        spark.conf.set(_CLEANUP, "true")
        spark.conf.set(_BROADCAST, str(min(BROADCAST_BYTES, _bytes(before[_BROADCAST] or "10m"))))
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    ``compression`` "none" suits hashes and the many small files of short rounds: they do
    not get smaller, and codecs hold buffers outside the heap for each file."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    with _round_settings(spark):
        df.write.parquet(path, compression=compression)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no result reads any more: the states of past rounds."""
    for table in tables:
        if getattr(table, "written_at", None) in _written:
            release(table.sparkSession, [table.written_at])


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables of ``materialize``; all of them, or those named.

    Call it only when every result that reads them has been written.
    """
    jvm = spark.sparkContext._jvm
    for path in list(_written if paths is None else paths):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in _written:
            _written.remove(path)


def mark() -> int:
    """Position in the list of written tables, for ``since``."""
    return len(_written)


def since(position: int) -> list[str]:
    """Tables written after ``mark`` returned ``position``."""
    return _written[position:]


def text_volume(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of a text column, from one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(column).cast("string"))).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def parts_for(volume: int, each: int, least: int = 1) -> int:
    """How many parts of ``each`` units hold ``volume`` units."""
    return max(least, -(-volume // each))
