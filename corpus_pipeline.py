"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's docs.  The first four keep the columns of documents;
the last returns the mix, one row per piece of a document in it.

Defined results
* null or empty text: no letters, so the first stage drops the row.
* Repeated rows and ids: each is judged by itself; the second stage leaves one row of
  a group of copies.  Null ids, languages and sources are kept as they are.
* Empty table: every stage returns an empty table.  Further columns pass through the
  first four stages, whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import decontaminate, language_id, mixing, near_dedup, secret_scan, tokens
from terravane.plans import runtime

#: SQL cannot express the first and the last stage; tests hold a brute-force run against this one.
ORACLE_SQL = None


#: Least posterior of a kept document's language, and most bits its model may need for a byte of
#: the text (of 8): beyond it the text is in none of the languages that were learned.
MIN_SCORE, MAX_BITS = 0.3, 5.0

_left: list[str] = []


def _stage(function):
    """A stage whose predecessor's helper tables go when it begins: by then the
    predecessor's result is a written table.  The first stage lets those of an earlier
    run's last stage be, as that run's result may still be read from them."""

    @functools.wraps(function)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if staged is not STAGES[0][1]:
            runtime.release(spark, _left)
        begun = runtime.mark()
        out = function(spark, docs, sf_dir)
        _left[:] = runtime.since(begun)
        return out

    return staged


@_stage
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letters, whose language stays wide open, or that are in
    none of the languages known (the best model codes them hardly better than any bytes)."""
    ready, back = tokens.set_aside(docs, ["lang_pred", "score", "bits_per_byte"])
    found = language_id.predict(ready, language_id.learn(docs))
    known = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE) & (F.col("bits_per_byte") <= MAX_BITS))
    return known.select(*ready.columns).withColumnsRenamed(back)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, at similarity 0.8 or more; with 5 rows
    and 40 bands a pair at 0.8 shares no bucket with probability 1e-7."""
    return near_dedup.deduplicate(docs, percent=80, rows=5, bands=40)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which a secret was found."""
    ready, back = tokens.set_aside(docs, secret_scan.MADE)
    found = secret_scan.scan_secrets(ready).select(*ready.columns, F.size("found").alias("__n"))
    # written first: a filter over the scan itself would be pushed through it and hold its expressions once for each use
    counted = runtime.materialize(found, "pipeline-spans")
    return counted.where("__n = 0").select(*ready.columns).withColumnsRenamed(back)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: shard, slot, at, source, doc_id, from_word, words, text."""
    return mixing.mix_sources(docs).mixed()


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scans", drop_secrets),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's result is a written table, deleted once the next one's is
    there.  The last table and the mix's own stay, as the result is read from them, until
    ``runtime.release``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        past, docs = docs, runtime.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        runtime.forget(past)
    return STAGES[-1][1](spark, docs, sf_dir)
