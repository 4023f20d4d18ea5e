r"""Secret scan: two character Markov models compared by log-likelihood ratio.

Fixed patterns find assignments, access keys and long hexadecimal runs.  Beyond
them, every run of 20 or more token characters is scored with first-order models
of random strings and of ordinary identifiers, both trained from labelled
samples; a run is reported when its log-likelihood ratio reaches a threshold set
on held-out ordinary samples.  Scoring looks up one table of quantised ratios.

Defined results
* null or empty text: no spans, empty strings.  Whole texts are scanned.
* A scored run that lies within a pattern's span is not reported again.
* Repeated rows are scanned row by row; empty table: empty result; input columns
  named like an output column are replaced by it.
"""

from __future__ import annotations

import math
import random
import string
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from terravane.llm.spans import Kind, joined, labelled, with_spans, with_uncovered

ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-"
SCALE = 64  # quantisation steps per nat
MIN_RUN = 20

#: Words that ordinary identifiers and long compounds are made of.
STEMS = (
    "get set make build read write file path name value index count list table user group item node edge "
    "time date start end first last next prev load save open close send fetch update delete create insert "
    "query filter select order sort page view model config option default error message status result "
    "response request handler manager service client server context session cache buffer stream batch "
    "window column record field key map array string number integer boolean format parse render style "
    "layout widget button image icon color width height margin border align center left right top bottom "
    "test mock assert check valid input output source target parent child element document window "
    "ing ation ment ness ever ther with under over inter trans counter micro multi super proto "
    "lich keit ung schaft ver ent zer heit gen mente cion ado eau elle tion ment aux eux ch que"
).split()

BASE = [
    Kind(
        "assign",
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
        r"""length(regexp_extract(x.t, '^(?i:password|passwd|secret|token|api_?key)["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6""",
        "(contains(text, ':') OR contains(text, '='))",
    ),
    Kind("access", r"AKIA[A-Z0-9]{16,}+", guard="contains(text, 'AKIA')"),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
]
RUN = Kind("markov", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % MIN_RUN)

#: The columns that a scan adds.
MADE = ["n_assign", "n_access", "n_hex", "n_markov", "base_spans", "all_spans", "found"]


def labelled_samples(count: int = 4000, seed: int = 11) -> tuple[list[str], list[str]]:
    """Random strings (secret) and ordinary identifiers, made by rule."""
    draw = random.Random(seed)
    sets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.digits + "abcdef",
            string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-"]
    secret = ["".join(draw.choices(draw.choice(sets), k=draw.randint(20, 64))) for _ in range(count)]
    ordinary = []
    while len(ordinary) < count:
        words = draw.choices(STEMS, k=draw.randint(3, 8))
        style = draw.randrange(8)
        if style == 0:
            text = "_".join(words)
        elif style == 1:
            text = words[0] + "".join(w.capitalize() for w in words[1:])
        elif style == 2:
            text = "-".join(words)
        elif style == 3:
            text = "_".join(words).upper()
        elif style == 4:
            text = "/".join(words) + f"/{draw.randint(1, 2030)}"
        elif style == 5:
            text = "".join(w.capitalize() for w in words) + str(draw.randint(1, 99))
        elif style == 6:
            text = f"{draw.randint(1990, 2030)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}-" + "-".join(words)
        else:
            text = "".join(words)
            text = draw.choice([text, text.capitalize(), text.upper(), draw.choice("-=_+") * draw.randint(20, 60)])
        if len(text) >= MIN_RUN:
            ordinary.append(text)
    return secret, ordinary


def _chain(samples: list[str], prior: float = 0.5) -> list[list[float]]:
    """log P(next | previous) over the alphabet, smoothed by ``prior``."""
    place, n = {c: i for i, c in enumerate(ALPHABET)}, len(ALPHABET)
    seen = [[prior] * n for _ in range(n)]
    for text in samples:
        for a, b in zip(text, text[1:], strict=False):
            seen[place[a]][place[b]] += 1
    return [[math.log(x / sum(row)) for x in row] for row in seen]


def ratio(text: str, table: list[int]) -> int:
    """Log-likelihood ratio of a run, in steps of 1 / SCALE nat."""
    place, n = {c: i for i, c in enumerate(ALPHABET)}, len(ALPHABET)
    return sum(table[place[a] * n + place[b]] for a, b in zip(text, text[1:], strict=False))


@lru_cache
def trained(margin: float = 6.0) -> tuple[tuple[int, ...], int]:
    """The quantised ratio table and the threshold: the largest ratio among
    held-out ordinary samples (one in four), 0 at least, plus ``margin`` nats."""
    secret, ordinary = labelled_samples()
    held = ordinary[::4]
    a, b = _chain(secret), _chain([x for i, x in enumerate(ordinary) if i % 4])
    table = [round(SCALE * (x - y)) for ra, rb in zip(a, b, strict=True) for x, y in zip(ra, rb, strict=True)]
    return tuple(table), max(0, *(ratio(x, table) for x in held)) + round(margin * SCALE)


def _scored(spans: str) -> str:
    """SQL: the runs of ``spans`` whose ratio reaches the threshold."""
    table, least = trained()
    place = [0] * 128
    for i, c in enumerate(ALPHABET):
        place[ord(c)] = i
    values = f"cast(split('{','.join(map(str, table))}', ',') AS array<int>)"
    places = f"cast(split('{','.join(map(str, place))}', ',') AS array<int>)"
    score = f"""get(transform(array(transform(split(x.t, ''), c -> get({places}, ascii(c)))), p ->
        aggregate(sequence(1, size(p) - 1), 0L, (a, i) -> a + get({values}, get(p, i - 1) * {len(ALPHABET)} + get(p, i)))), 0)"""
    return f"filter({spans}, x -> {score} >= {least})"


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Input columns plus n_assign, n_access, n_hex, n_markov, base_spans, all_spans
    (``kind:start:end`` lists) and found: the spans as (s, k, e)."""
    names = [k.name for k in [*BASE, RUN]]
    rest = [c for c in docs.columns if c not in MADE]
    body = docs.selectExpr(f"struct({', '.join(f'`{c}`' for c in rest)}) AS __row", f"coalesce(`{text_col}`, '') AS text")
    spans = with_spans(body, "text", [*BASE, RUN], context=0)
    scored = spans.selectExpr("*", f"{labelled(names[:3])} AS __base", f"transform({_scored('__k3')}, x -> struct(x.s AS s, 3 AS k, x.e AS e)) AS __scored")
    both = with_uncovered(scored, "concat(__base, __scored)", 3, "__all")
    return both.selectExpr(
        "__row.*",
        *[f"cast(size(__k{i}) AS bigint) AS n_{n}" for i, n in enumerate(names[:3])],
        "cast(size(__all) - size(__base) AS bigint) AS n_markov",
        f"{joined('__base', names)} AS base_spans",
        f"{joined('__all', names)} AS all_spans",
        "__all AS found",
    )


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_secrets(docs).selectExpr(
        "doc_id", "n_assign", "n_access", "n_hex", "sha2(base_spans, 256) AS base_sha256", "all_spans AS spans", "n_markov"
    )
