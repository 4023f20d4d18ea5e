"""What SQL can express of op4, op7, op9 and op10: their queries' exact columns, with SQL.

The other columns of these queries (words taken, model scores, added spans) depend on
draws or trained models; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import lm_score, mixing, pii, secret_scan

_WORD = r"[^\x20\x09-\x0D]+"


def contract_op4_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
s AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
      FROM (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source)),
t AS (SELECT 1.5::DOUBLE * sum(size) AS whole, sum(w) FILTER (size > 0) AS w FROM s),
r(k, free, total, n) AS (
  SELECT 0, whole, w, CAST(0 AS BIGINT) FROM t
  UNION ALL
  SELECT k + 1, whole - caps, left_, m FROM (
    SELECT r.k, r.n, any_value(t.whole) AS whole, count(*) FILTER (r.free * s.w / r.total > 2 * s.size) AS m,
           coalesce(sum(2.0::DOUBLE * s.size) FILTER (r.free * s.w / r.total > 2 * s.size), 0) AS caps,
           sum(s.w) FILTER (NOT r.free * s.w / r.total > 2 * s.size) AS left_
    FROM r, s, t WHERE s.size > 0 GROUP BY r.k, r.n) WHERE m > n AND left_ > 0),
z AS (SELECT free, total FROM r ORDER BY k DESC LIMIT 1),
g AS (SELECT source, size, CASE WHEN size = 0 THEN 0.0::DOUBLE WHEN free * w / total > 2 * size THEN 2.0::DOUBLE * size ELSE free * w / total END AS target FROM s, z)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, g.size AS source_size, g.target FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
"""


def contract_op7_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.op7_lm_scoring(spark, sf_dir)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


# crc32 by bits: a byte is joined, then eight shifts follow
OP7_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
             lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))]),
             lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 5 = 1 AS held_out,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws
  FROM documents),
k AS (SELECT rid, held_out, unnest(list_append(ws, '')) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM k WHERE NOT held_out GROUP BY w),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c),
b AS (SELECT rid, count(*) AS n_tokens, count(c.c) AS n_known,
             sum(log10((coalesce(c.c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)))) AS base
      FROM k CROSS JOIN n LEFT JOIN c ON c.w = k.w GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 3) AS base_score FROM d JOIN b USING (rid) CROSS JOIN n
"""


def _spans_sql(kinds: list[tuple[str, str, str]]) -> str:
    """Columns n_<kind> and base_sha256, from (kind, pattern, SQL test of the match m)."""
    found = " UNION ALL ".join(
        f"""SELECT rid, {k} AS k, s, e FROM (
          SELECT rid, i, m, CAST(sum(len(g) + len(m)) OVER w - len(m) AS BIGINT) AS s, CAST(sum(len(g) + len(m)) OVER w AS BIGINT) AS e FROM (
            SELECT rid, i, ms[i] AS m, gs[i] AS g FROM (
              SELECT rid, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
                SELECT rid, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS gs FROM d)))
          WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE {test}"""
        for k, (_, p, test) in enumerate(kinds)
    )
    names = "[" + ", ".join(f"'{n}'" for n, *_ in kinds) + "]"
    counts = ", ".join(f"CAST(count(*) FILTER (k = {k}) AS BIGINT) AS n_{n}" for k, (n, *_) in enumerate(kinds))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
h AS (SELECT rid, {counts}, string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n, *_ in kinds)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN h USING (rid)
"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INTEGER)
  ELSE 2 * CAST(reverse({_DIGITS})[i] AS INTEGER) - CASE WHEN CAST(reverse({_DIGITS})[i] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""

OP9_SQL = _spans_sql(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR CAST('0' || right(p, 3) AS INTEGER) > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 10 AND 15"),
    ]
)
_KEY = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_ASSIGN = _KEY + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP10_SQL = _spans_sql(
    [
        ("assign", _ASSIGN, f"len(regexp_extract(m, '{_ASSIGN}', 2)) >= 6"),
        ("access", "AKIA[A-Z0-9]+", "len(m) >= 20"),
        ("hex", "[0-9a-f]+", "len(m) >= 24"),
    ]
)


def contract_op9_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op9_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def contract_op10_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op10_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES = {f.__name__: f for f in (contract_op4_targets, contract_op7_base, contract_op9_base, contract_op10_base)}
ORACLES = {"contract_op4_targets": OP4_SQL, "contract_op7_base": OP7_SQL, "contract_op9_base": OP9_SQL, "contract_op10_base": OP10_SQL}
