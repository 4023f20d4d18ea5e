"""URL filter: host-suffix and path-prefix expressions matched by digest prefix.

Every distinct (host, path) of the input expands into the expressions a rule
could be written as: its last k labels joined to the first l characters of its
path, for those (k, l) that occur among the rules.  The expressions meet the
rules in an equi-join on a short prefix of their SHA-256 digest; the full digest
confirms a hit, and the most specific rule decides.

Defined results
* null url, or one without ``://``: empty host and path; no rule fits unless a
  rule has an empty host.
* Several rules fit: the longest (host and path together), then the longest
  host, then block before allow.  The same rule given twice counts once.
* Repeated rows: each gets its own verdict.  Empty table: empty result.
* Input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a table."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW, prefix_chars: int = 8) -> DataFrame:
    """Input columns plus host, path, rule (null if none fits) and verdict.

    The shapes (labels, path length) of the rules are read once; there are at
    most as many as a rule's path and host are long, whatever the rule count.
    """
    known = rules.select(
        "verdict",
        F.col("host").alias("rule_host"),
        F.concat("host", "path").alias("rule"),
        F.size(F.split("host", r"\.", -1)).alias("labels"),
        F.length("path").alias("chars"),
    )
    shapes = sorted((r["labels"], r["chars"]) for r in known.select("labels", "chars").distinct().collect())
    rows = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    keys = rows.select("host", "path").distinct().withColumn("__labels", F.size(F.split("host", r"\.", -1)))
    expressions = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col("__labels") >= k) & (F.length("path") >= n),
                    F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n)),
                )
                for k, n in shapes
            ],
            F.lit(None).cast("string"),
        )
    )
    wanted = keys.select("host", "path", F.explode(expressions).alias("expression")).withColumn("__digest", _digest(F.col("expression")))
    wanted = wanted.withColumn("__prefix", F.substring("__digest", 1, prefix_chars))
    # a rule given twice, or with both verdicts, counts once: block wins
    table = known.groupBy("rule", "rule_host").agg(F.max(F.col("verdict") == BLOCK).alias("blocks"))
    table = table.withColumn("__full", _digest(F.col("rule"))).withColumn("__prefix", F.substring("__full", 1, prefix_chars))
    hits = wanted.join(table, "__prefix").where(F.col("__digest") == F.col("__full"))
    best = (
        hits.groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("a"), F.length("rule_host").alias("b"), "blocks", "rule")).alias("__best"))
        .select("host", "path", F.col("__best.rule").alias("__rule"), F.when(F.col("__best.blocks"), BLOCK).otherwise(ALLOW).alias("__verdict"))
    )
    out = rows.join(best, ["host", "path"], "left")
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(
        *kept, "host", "path", F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit(default)).alias("verdict")
    )


#: The rules of op8: (verdict, host, path).
QUERY_RULES = [
    (BLOCK, "net", "/"),
    (ALLOW, "example.net", "/en/"),
    (BLOCK, "example.com", "/de/"),
    (ALLOW, "org", "/fr/"),
]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    judged = judge_urls(pages, rules_frame(spark, QUERY_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*(/[^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('block','net','/'), ('allow','example.net','/en/'),
                            ('block','example.com','/de/'), ('allow','org','/fr/')),
j AS (
  SELECT u.*, (SELECT {'rule': h || p, 'verdict': r.verdict} FROM r
               WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
               ORDER BY length(h || p) DESC LIMIT 1) AS best
  FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM j
"""
