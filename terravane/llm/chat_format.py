r"""Chat formatting: one example per assistant turn, earlier turns as context.

A conversation becomes one row per assistant turn.  ``formatted`` holds all turns
up to and including that reply; only the reply's own text lies under the loss
mask, the code points [loss_start, loss_end) of ``formatted``.  Turns that follow
the last reply (or a conversation without replies) are kept in one closing row
with an empty mask, so that no turn is lost.

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>``.  A control string
inside a role or text gets one backslash after its first character, on top of
those already there; removing one backslash restores the text exactly.

Defined results
* Turns are ordered by turn number (null first), then role, then text; equal
  rows are kept, each as a turn of its own.
* null text or role: empty; the null conv_id is one conversation.
* Empty table: empty result.  Only conv_id, turn, role and text are read.
A conversation's turns form one array, because its last example holds them all
in one string; its examples are written one at a time, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What follows the first character of a control string.
TAILS = r"\|turn\|>|\|text\|>|\|end\|>|/?s>|/?INST\]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*(?:{TAILS}))", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*(?:{TAILS}))", r"$1$2")


def expand_prefix_targets(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conv_id, example, is_last, formatted, loss_start, loss_end."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    whole = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("t")
    )
    parts = whole.select(
        "conv_id",
        F.transform(
            "t",
            lambda x: F.struct(
                F.concat(F.lit(TURN), escaped(x["role"]), F.lit(TEXT)).alias("head"),
                escaped(x["text"]).alias("body"),
                (x["role"] == target_role).alias("target"),
            ),
        ).alias("t"),
    )
    ends = parts.select(
        "conv_id",
        "t",
        F.array_distinct(
            F.concat(
                F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.get("t", i - 1)["target"]),
                F.array(F.size("t")),
            )
        ).alias("ends"),
    )
    each = ends.select("conv_id", "t", F.size("ends").alias("n"), F.posexplode("ends").alias("example", "upto"))
    last = each.select("conv_id", "t", "n", "example", "upto", F.get("t", F.col("upto") - 1).alias("reply"))
    shaped = last.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        (F.col("example") == F.col("n") - 1).alias("is_last"),
        F.concat(
            F.array_join(
                F.transform(F.slice("t", 1, F.col("upto") - 1), lambda x: F.concat(x["head"], x["body"], F.lit(END))), ""
            ),
            F.col("reply.head"),
        ).alias("before"),
        F.col("reply.body").alias("body"),
        F.col("reply.target").alias("target"),
    )
    start = F.length("before").cast("long")
    return shaped.select(
        "conv_id",
        "example",
        "is_last",
        F.concat("before", "body", F.lit(END)).alias("formatted"),
        start.alias("loss_start"),
        (start + F.when(F.col("target"), F.length("body")).otherwise(0)).alias("loss_end"),
    )


def trainable_text(formatted: Column, start: Column, end: Column) -> Column:
    """The unescaped text under an example's loss mask."""
    return unescaped(F.substring(formatted, (start + 1).cast("int"), (end - start).cast("int")))


def turns_of(formatted: Column) -> Column:
    """The turns read back from a formatted example: array of (role, text)."""
    pieces = F.split(F.substring(formatted, len(TURN) + 1, 2147483647), r"<\|turn\|>", -1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(p, TEXT, 1)).alias("role"),
            unescaped(F.regexp_replace(F.regexp_replace(p, r"(?s)^.*?<\|text\|>", ""), r"<\|end\|>$", "")).alias("text"),
        ),
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(2, numPartitions=1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said,
    )
    examples = expand_prefix_targets(rows.unionByName(extra))
    # each example is reduced to its own reply; only the last one keeps its whole text
    read = examples.select(
        "conv_id",
        F.struct(
            "example",
            trainable_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
        ).alias("reply"),
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.col("formatted")).alias("whole"),
    )
    per = (
        read.groupBy("conv_id")
        .agg(
            F.sort_array(F.collect_list("reply")).alias("replies"),
            F.sum("chars").alias("formatted_chars"),
            F.max("whole").alias("whole"),
        )
        .select(
            "conv_id",
            "formatted_chars",
            turns_of(F.col("whole")).alias("turns"),
            F.array_join(F.transform("replies", lambda r: r["loss"]), "").alias("loss"),
        )
    )
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listing, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT CAST(-7 AS BIGINT), CAST(i AS BIGINT), CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
  FROM range(2) AS r(i)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c),
s AS (
  SELECT *, count(*) OVER (PARTITION BY conv_id) AS n,
         length(regexp_replace(role, '([<\[])(\\*(?:\|turn\|>|\|text\|>|\|end\|>|/?s>|/?INST\]))', '\1\\\2', 'g'))
         + length(regexp_replace(text, '([<\[])(\\*(?:\|turn\|>|\|text\|>|\|end\|>|/?s>|/?INST\]))', '\1\\\2', 'g')) + 23 AS size
  FROM o),
u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""
