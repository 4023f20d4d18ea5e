"""Vectorised word kernels over Arrow text, and the operator frame they share.

Texts are taken as UTF-8 bytes straight from Arrow buffers.  Word classes here
are unions of ASCII characters and "all of non-ASCII", so cutting bytes cuts
characters.  A word is known by a 64-bit hash of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes: all but space and \x09-\x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Word bytes: digits, lower-case letters, everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_LONG = 512  # bytes from which a word is hashed on its own
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) and each text's start, plus the end."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if at is not None else np.zeros(1, np.int64)
    offsets = offsets if len(offsets) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``most`` bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with padding, word starts, word lengths, first word of each text plus the end)."""
    size = len(data)
    padded = np.zeros(size + 16, dtype=np.uint8)
    padded[:size] = LOWER[data] if lower else data
    if not size:
        none = np.zeros(0, np.int64)
        return padded, none, none, np.zeros(len(offsets), np.int64)
    inside = table[padded[:size]]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside
    last[:-1] &= ~(inside[1:] & ~first[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return padded, starts, ends - starts, np.searchsorted(starts, offsets)


def hashes(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, never 0."""
    eight = np.ndarray((len(padded) - 7,), np.dtype("<u8"), buffer=padded, strides=(1,))
    h = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    short = np.minimum(lengths, 8)
    h = mix(h ^ (eight[starts] & _KEEP[short]))
    left = np.flatnonzero((lengths > 8) & (lengths <= _LONG))
    done = 8
    while len(left):
        here = eight[starts[left] + done] & _KEEP[np.minimum(lengths[left] - done, 8)]
        h[left] = mix(h[left] ^ here)
        done += 8
        left = left[lengths[left] > done]
    for i in np.flatnonzero(lengths > _LONG):
        h[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : starts[i] + lengths[i]].tobytes(), digest_size=8).digest(), "little")
    h[h == 0] = 1
    return h


def per_text(counts_before: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's words."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype != bool else np.int64), np.cumsum(values)])
    return total[counts_before[1:]] - total[counts_before[:-1]]


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: str = "8m") -> None:
    """Arrow batches of at most ``most`` bytes (or one row) from here on in this session,
    unless a limit other than Spark's default is set; long texts then come few at a time."""
    if spark.conf.get(_BATCH, None) in (None, "67108864b", "64MB", "64m"):
        spark.conf.set(_BATCH, most)


def set_aside(df: DataFrame, made: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns that are named like made ones renamed, and the way back."""
    clash = {c: f"__own_{c}" for c in df.columns if c in made}
    return df.withColumnsRenamed(clash), {v: k for k, v in clash.items()}


def add_columns(
    df: DataFrame,
    kernel: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], dict[str, pa.Array]],
    added: T.StructType,
    text_col: str = "text",
    keep_text: bool = True,
    most: int = 4 << 20,
) -> DataFrame:
    """``df`` with columns computed from whole texts, about ``most`` bytes at a time.

    ``kernel(bytes, offsets, rows)`` returns the added columns.  Columns of the
    input that have an added column's name are replaced.
    """
    bound_batches(df.sparkSession)
    names = [f.name for f in added]
    kept = [c for c in df.columns if c not in names and (keep_text or c != text_col)]
    read = list(dict.fromkeys([*kept, text_col]))
    schema = T.StructType([df.schema[c] for c in kept] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            for i, j in slices(offsets, most):
                rows = batch.slice(i, j - i)
                made = kernel(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rows)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index(c)) for c in kept] + [made[n] for n in names], names=[*kept, *names]
                )

    return df.select(*[f"`{c}`" for c in read]).mapInArrow(run, schema)
