"""Quality rules: one threshold table compiled into one projection.

All figures are built-in expressions over whole texts.  Three-word windows that
occur twice are found by sorting a text's own window hashes (64-bit) with their
positions, so a text of n words costs n log n whatever it repeats, and no row
leaves its task.

Defined results
* null or empty text, or only separators: all figures 0 and ``kept`` false.
* Fewer than three words: no windows, so no repeated words.
* Repeated rows are judged row by row; empty table: empty result; input columns
  named like an output column are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"

#: Frequent function words of the supported languages, in lower case.
STOP_WORDS = (
    "the of and to in a is that it for was on are with as at by an or be this "
    "le la les de des et un une en que qui pour dans du au pas "
    "der die das und zu den von nicht ein ist mit im auf "
    "el los las y por con para del se una como"
).split()


@dataclass(frozen=True)
class Threshold:
    """``low * of <= 100 * figure <= high * of``; None leaves a side open."""

    name: str
    figure: str
    of: str
    low: int | None = None
    high: int | None = None


#: The verdict's table: each ratio in hundredths.
THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", low=200, high=1500),
    Threshold("symbols", "n_symbols", "n_words", high=10),
    Threshold("stop_words", "n_stop_words", "n_words", low=2),
    Threshold("dup_lines", "n_dup_lines", "n_lines", high=50),
)


def compile_thresholds(table=THRESHOLDS) -> str:
    """The table as one SQL predicate over the figures."""
    tests = []
    for t in table:
        if t.low is not None:
            tests.append(f"100 * {t.figure} >= {t.low} * {t.of}")
        if t.high is not None:
            tests.append(f"100 * {t.figure} <= {t.high} * {t.of}")
    return "(" + " AND ".join(tests or ["true"]) + ")"


def quality_rules(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Input columns plus the figures, ``base_failed`` and ``kept``."""
    stops = ", ".join(f"'{w}', '{w.capitalize()}', '{w.upper()}'" for w in dict.fromkeys(STOP_WORDS))
    figures = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words"]
    made = [*figures, "base_failed", "kept"]
    rest = [c for c in docs.columns if c not in made]
    body = docs.select(*rest, F.col(text_col).alias("__text")) if text_col in docs.columns else docs
    # the arrays are attributes of their own projections: lambdas below read them, not recompute them
    cut = body.selectExpr(
        *[f"`{c}`" for c in rest],
        "__text",
        "btrim(__text, ' \\t\\n\\u000b\\f\\r') AS __trimmed",
    ).selectExpr(
        *[f"`{c}`" for c in rest],
        "__text",
        rf"CASE WHEN __trimmed = '' OR __trimmed IS NULL THEN cast(array() AS array<string>) ELSE split(__trimmed, '{SPACES.replace(chr(92), chr(92) * 2)}', -1) END AS __words",
        r"filter(split(coalesce(__text, ''), '\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]') AS __lines",
    )
    keyed = cut.selectExpr(
        "*",
        """CASE WHEN size(__words) < 3 THEN cast(array() AS array<struct<h:bigint,p:int>>)
           ELSE sort_array(transform(sequence(0, size(__words) - 3),
                i -> struct(xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2)) AS h, i AS p))) END AS __keys""",
    )
    twice = keyed.selectExpr(
        "*",
        """sort_array(transform(filter(__keys, (x, i) -> x.h = get(__keys, i - 1).h OR x.h = get(__keys, i + 1).h), x -> x.p)) AS __at""",
    )
    spaces = SPACES.replace("\\", "\\\\")
    counted = twice.selectExpr(
        *[f"`{c}`" for c in rest],
        "cast(size(__words) AS bigint) AS n_words",
        f"cast(length(regexp_replace(coalesce(__text, ''), '{spaces}', '')) AS bigint) AS word_chars",
        "cast(length(regexp_replace(coalesce(__text, ''), '[^#*$%&|<>]+', '')) AS bigint) AS n_symbols",
        "cast(size(__lines) AS bigint) AS n_lines",
        "cast(size(__lines) - size(array_distinct(__lines)) AS bigint) AS n_dup_lines",
        f"cast(size(filter(__words, w -> w IN ({stops}))) AS bigint) AS n_stop_words",
        """CASE WHEN size(__at) = 0 THEN 0L ELSE
           aggregate(transform(__at, (p, i) -> least(3, coalesce(get(__at, i + 1), p + 3) - p)), 0L, (a, x) -> a + x) END AS n_repeat_words""",
    )
    failed = f"(n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words)"
    return counted.selectExpr("*", f"{failed} AS base_failed", f"(NOT {failed} AND {compile_thresholds(thresholds)}) AS kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = quality_rules(docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "base_failed", "kept")


OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
g AS (
  SELECT rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3)),
m AS (
  SELECT rid, count(DISTINCT p + o) AS n
  FROM (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c >= 2),
       (VALUES (0), (1), (2)) AS t(o)
  GROUP BY rid),
f AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(ws, lambda x: x IN ({", ".join(f"'{w}', '{w.capitalize()}', '{w.upper()}'" for w in dict.fromkeys(STOP_WORDS))}))) AS BIGINT) AS n_stop_words,
         CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN m ON w.rid = m.rid),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, base_failed,
       (NOT base_failed AND {compile_thresholds()}) AS kept FROM b
"""
