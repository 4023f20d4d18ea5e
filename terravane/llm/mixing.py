r"""Mixing sources to target weights, block by block.

The words of a source, document after document, are packed into blocks of
``block_words``.  The mix is a row of slots, cut into output shards.  All target slots
form a pool; the pool is laid out by a pseudorandom permutation, and the stretch that
falls to a shard is its draw: how many of its slots go to which source.  These are
multinomial counts conditioned on the sources' totals (drawn without replacement), so
shards vary as with free multinomial draws, while every source meets its target to
the word (its last slot is cut short).  A source's slots are mapped through
pseudorandom permutations of its block numbers, one permutation per pass over the
source, and slots and blocks meet in an equi-join on (source, block).  Permutations
are evaluated element by element, so any task finds any slot by itself, at every size
in the same way, and reruns agree.

Documents are numbered inside a source by (bucket, doc_id, text hash); a bucket
holds about ``bucket_rows`` documents whatever their source, so a source with a
third of all rows is spread over many tasks, and so are its slots.  What is known of
each source is a table; the driver reads sums over all sources only.

Defined results
* Words: runs of ``[^\x20\x09-\x0D]``; null or empty text: size 0, taken 0.
* Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating.
* A source of size 0 has target 0.  Repeated rows are documents of their own.
* Empty table: empty result.  Input columns named like an output column (size,
  source_no, source_size, target, first_word, taken) are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.plans import runtime
from terravane.plans.numbering import number_rows, prefix_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
FACTOR = 1.5  # words of the mix, as a multiple of all words
PASSES = 2  # most times a source is gone through


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class IndexPermutation:
    """A pseudorandom permutation of 0..n-1: a four-round Feistel network over
    the next even number of bits, walked until the value is below n."""

    def __init__(self, n: int, *key: int):
        self.n, self.half = n, max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        seed = np.zeros(1, np.uint64)
        for k in key:
            seed = _mix(seed + np.uint64(k & (1 << 64) - 1) + np.uint64(0x9E3779B97F4A7C15))
        self.keys = [_mix(seed + np.uint64(r + 1)) for r in range(4)]

    def _round(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & self.mask)
        return right << np.uint64(self.half) | left

    def _walk(self, x, keys) -> np.ndarray:
        out = self._round(np.asarray(x, np.uint64), keys)
        while (far := np.flatnonzero(out >= np.uint64(self.n))).size:
            out[far] = self._round(out[far], keys)
        return out.astype(np.int64)

    def at(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys)

    def where(self, y: np.ndarray) -> np.ndarray:
        """The inverse of ``at``: the network swaps its halves at the end, so it
        is its own inverse under the reversed keys."""
        return self._walk(y, self.keys[::-1])


def with_targets(sources: DataFrame, weights: tuple[float, ...], factor: float, passes: float = PASSES) -> DataFrame:
    """Sources (source_no, size) with ``target``: weighted shares of factor * the sum of
    sizes, none above passes * its size; what a capped source leaves is shared by weight
    among the others.  Each round is one aggregate: the caps can only grow in number."""
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("source_no", F.lit(len(weights))).cast("int"))
    cap = F.lit(float(passes)) * F.col("size")
    left = factor * float(sources.agg(F.sum("size")).first()[0] or 0)
    free, total, capped = left, float(sources.where("size > 0").agg(F.sum(weight)).first()[0] or 0), 0
    while total:
        share = F.lit(free) * weight / F.lit(total)
        over = (F.col("size") > 0) & (share > cap)
        row = sources.where("size > 0").agg(
            F.sum(over.cast("long")).alias("n"), F.sum(F.when(over, cap).otherwise(0.0)).alias("caps"), F.sum(F.when(over, 0.0).otherwise(weight)).alias("w")
        ).first()
        if row["n"] == capped:
            return sources.withColumn("target", F.when(F.col("size") == 0, 0.0).when(over, cap).otherwise(share))
        free, total, capped = left - row["caps"], row["w"], row["n"]
    return sources.withColumn("target", F.when(F.col("size") == 0, 0.0).otherwise(cap))


def slots_of(number: int, size: int, target: float, block_words: int, seed: int) -> tuple[int, int, int]:
    """(blocks, slots, words the last slot takes) of a source."""
    blocks, words = -(-size // block_words), round(target)
    short = size - (blocks - 1) * block_words

    def before(j: int) -> int:
        """Words of the first j slots."""
        full, rest = divmod(j, blocks)
        place = int(IndexPermutation(blocks, seed, number, full).where(np.array([blocks - 1]))[0])
        return full * size + rest * block_words - (block_words - short) * (place < rest)

    if not words:
        return blocks, 0, 0
    low, high = 0, PASSES * blocks + 1  # the fewest slots that hold all words
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if before(mid) >= words else (mid + 1, high)
    return blocks, low, words - before(low - 1)


def with_slots(sources: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Sources (source_no, size, target) with blocks, slots and last, a row at a time."""

    def fill(batches):
        for rows in batches:
            made = [slots_of(int(k), int(n), float(t), block_words, seed) for k, n, t in zip(rows["source_no"], rows["size"], rows["target"], strict=True)]
            yield rows.assign(**{c: [m[i] for m in made] for i, c in enumerate(("blocks", "slots", "last"))})

    schema = T.StructType([*sources.schema, *[T.StructField(c, T.LongType()) for c in ("blocks", "slots", "last")]])
    return sources.mapInPandas(fill, schema)


def slots_frame(sources: DataFrame, total: int, block_words: int, shard_slots: int, seed: int, chunk: int = 1 << 16) -> DataFrame:
    """shard, slot, source_no, block, take: every slot of the mix once.

    sources: source_no, blocks, slots, last and first_slot (the slots of the sources
    before); total: all slots.  A source's slots are made ``chunk`` at a time, each chunk
    wherever it is dealt."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(chunk).cast("long"))).alias("begin")
    runs = sources.where("slots > 0").select("source_no", "blocks", "slots", "last", "first_slot", starts).repartition("source_no", "begin")

    def fill(batches):
        pool = IndexPermutation(total, seed)
        for rows in batches:
            for r in rows.itertuples(index=False):
                nth = np.arange(r.begin, min(r.begin + chunk, r.slots))
                slot, block = pool.at(r.first_slot + nth), np.empty(len(nth), np.int64)
                turns = nth // r.blocks
                for turn in np.unique(turns):
                    some = turns == turn
                    block[some] = IndexPermutation(r.blocks, seed, r.source_no, int(turn)).at(nth[some] % r.blocks)
                take = np.where(nth == r.slots - 1, r.last, block_words)
                yield pd.DataFrame({"shard": slot // shard_slots, "slot": slot, "source_no": np.int64(r.source_no), "block": block, "take": take})

    return runs.mapInPandas(fill, "shard long, slot long, source_no long, block long, take long")


@dataclass(frozen=True)
class Mix:
    """documents: input columns plus size, source_no, first_word, source_size and
    target; slots: the output order; sources: source, source_no, size, target, blocks,
    slots and last, a row for each."""

    documents: DataFrame
    slots: DataFrame
    sources: DataFrame
    block_words: int

    def counts(self) -> DataFrame:
        """shard, source_no, n: the draw of each output shard."""
        return self.slots.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n"))

    def pieces(self, text_col: str | None = None) -> DataFrame:
        """What each document gives to each block: source_no, block, doc_id, source,
        first_word (of the document), from_word (of the piece, in the document), words,
        at (the piece's place in the block), and with ``text_col`` the piece's text.  A
        text is cut into words once, whatever its length."""
        d = self.documents.where("size > 0").select("source_no", "doc_id", "source", "first_word", "size", *([text_col] if text_col else []))
        if text_col:
            spaced = F.regexp_replace(F.concat(F.lit(" "), F.col(text_col)), r"[\x20\x09-\x0D]+", " ")
            d = d.withColumn("__words", F.split(F.trim(spaced), " ")).drop(text_col)
        size = self.block_words

        def piece(block):
            start = F.greatest(F.col("first_word"), block * size)
            end = F.least(F.col("first_word") + F.col("size"), (block + 1) * size)
            own = [block.alias("block"), (start - F.col("first_word")).alias("from_word"), (end - start).alias("words"), (start - block * size).alias("at")]
            if text_col:
                part = F.slice("__words", (start - F.col("first_word") + 1).cast("int"), (end - start).cast("int"))
                own.append(F.array_join(part, " ").alias("text"))
            return F.struct(*own)

        blocks = F.sequence(F.floor(F.col("first_word") / size), F.floor((F.col("first_word") + F.col("size") - 1) / size))
        return d.select("source_no", "doc_id", "source", "first_word", F.explode(F.transform(blocks, piece)).alias("p")).select(
            "source_no", "doc_id", "source", "first_word", "p.*"
        )

    def _placed(self, text_col: str | None = None) -> DataFrame:
        # slots grow with the corpus: they are shuffled, and build the hash tables
        slots = self.slots.hint("shuffle_hash")
        return slots.join(self.pieces(text_col), ["source_no", "block"]).where("at < take").withColumn("n", F.least(F.col("words"), F.col("take") - F.col("at")))

    def mixed(self, text_col: str = "text") -> DataFrame:
        """The mix: shard, slot, source, doc_id, from_word, words and text of each
        piece, in the order of slot and at."""
        cut = F.array_join(F.slice(F.split("text", " "), 1, F.col("n").cast("int")), " ")
        return self._placed(text_col).select(
            "shard", "slot", "at", "source", "doc_id", "from_word", F.col("n").alias("words"), F.when(F.col("n") < F.col("words"), cut).otherwise(F.col("text")).alias("text")
        )

    def taken(self) -> DataFrame:
        """The documents with ``taken``: words the mix takes of each, repeats counted."""
        sums = self._placed().groupBy("source_no", "first_word").agg(F.sum("n").alias("__taken"))
        own = F.when(F.col("size") > 0, F.coalesce("__taken", F.lit(0))).otherwise(0).cast("long")
        return self.documents.join(sums, ["source_no", "first_word"], "left").withColumn("taken", own).drop("__taken")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    factor: float = FACTOR,
    block_words: int = 256,
    shard_slots: int = 4096,
    seed: int = 20240607,
    bucket_rows: int = 4000,
    text_col: str = "text",
    keep_text: bool = True,
) -> Mix:
    """Plan the mix of ``docs`` (doc_id, source and text are read).  Without
    ``keep_text`` the texts are read once, for their sizes, and then left out."""
    buckets = runtime.parts_for(docs.count(), bucket_rows)
    sized = docs.drop("size", "source_no", "source_size", "target", "first_word", "taken").withColumns(
        {
            "size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
            "__order": F.xxhash64(text_col),
            "__source": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")),  # null stands apart
            "__bucket": F.pmod(F.xxhash64("doc_id", text_col), F.lit(buckets)),
        }
    )
    if not keep_text:
        sized = runtime.materialize(sized.drop(text_col), "mix-sizes")
    sums = sized.groupBy("__source", "__bucket").agg(F.sum("size").alias("__n"), F.first("source").alias("source"))
    # words before each bucket, over all sources in one order; a source's own begin at its least
    upto = prefix_sums(sums, ["__source", "__bucket"], F.col("__n"), "__upto")
    each = upto.groupBy("__source").agg(F.first("source").alias("source"), F.sum("__n").alias("size"), F.min("__upto").alias("__start"))
    named = number_rows(each.withColumn("__last", F.isnull("source")), ["__last", "source"], "source_no")
    sources = runtime.materialize(with_slots(with_targets(named.drop("__last"), weights, factor), block_words, seed), "mix-sources")
    before = upto.select("__source", "__bucket", "__upto").join(
        sources.select("__source", "__start", "source_no", F.col("size").alias("source_size"), "target"), "__source"
    )
    inside = Window.partitionBy("__source", "__bucket").orderBy("doc_id", "__order").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sized.withColumn("__within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = numbered.join(before, ["__source", "__bucket"]).withColumn("first_word", F.col("__upto") - F.col("__start") + F.col("__within"))
    documents = placed.drop("__order", "__source", "__bucket", "__within", "__upto", "__start")
    laid = prefix_sums(sources.select("source_no", "blocks", "slots", "last"), ["source_no"], F.col("slots"), "first_slot")
    total = int(sources.agg(F.sum("slots")).first()[0] or 0)
    return Mix(documents, slots_frame(laid, total, block_words, shard_slots, seed), sources.drop("__source", "__start"), block_words)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs, keep_text=False).taken().select("doc_id", "size", "source_size", "target", "taken")
