"""Code-point spans of regular-expression matches, in built-in expressions.

``regexp_extract_all`` yields the leftmost non-overlapping matches and ``split``
the text between them; running sums of both lengths are the positions.  Patterns
here have no empty matches, so there is always one gap more than matches.

Running sums and maxima are taken by doubling: in round p each element adds the one
2^p places before it.  That is n log n steps for n matches, where appending to a list
match by match would copy it each time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Kind:
    """A kind of span: pattern, the test a match must pass (SQL over ``x.t``),
    and a cheap test on the whole text that any match implies."""

    name: str
    pattern: str
    test: str = "true"
    guard: str = "true"


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(values: str, step: Callable[[str, str], str]) -> str:
    """SQL: ``values`` with each element joined by ``step`` to all before it."""
    rounds = f"slice(sequence(0, 30), 1, length(bin(greatest(size({values}), 1) - 1)))"
    return f"""aggregate({rounds}, {values}, (a, p) -> transform(a, (x, i) ->
        CASE WHEN i >= shiftleft(1, p) THEN {step("x", "get(a, i - shiftleft(1, p))")} ELSE x END))"""


def with_spans(df: DataFrame, text: str, kinds: list[Kind], context: int = 24) -> DataFrame:
    """Adds ``__k0``, ``__k1``, ... : for each kind an array of spans
    (s, e: start and end; t: matched text; l: up to ``context`` characters before)."""
    every = range(len(kinds))
    none = "cast(array() AS array<string>)"
    found = df.selectExpr("*", *[f"CASE WHEN {k.guard} THEN regexp_extract_all({text}, {quoted(k.pattern)}, 0) ELSE {none} END AS __m{i}" for i, k in enumerate(kinds)])
    apart = found.selectExpr(
        "*", *[f"CASE WHEN size(__m{i}) = 0 THEN {none} ELSE slice(split({text}, {quoted(k.pattern)}, -1), 1, size(__m{i})) END AS __g{i}" for i, k in enumerate(kinds)]
    )
    sized = apart.selectExpr("*", *[f"zip_with(__g{i}, __m{i}, (g, m) -> length(g) + length(m)) AS __n{i}" for i in every])
    ended = sized.selectExpr("*", *[f"{running(f'__n{i}', '{} + {}'.format)} AS __e{i}" for i in every])
    placed = ended.selectExpr(
        "*",
        *[
            f"""filter(zip_with(zip_with(__m{i}, __g{i}, (m, g) -> struct(m, g)), __e{i}, (z, e) ->
                struct(e - length(z.m) AS s, e AS e, z.m AS t, right(z.g, {context}) AS l)), x -> {k.test}) AS __k{i}"""
            for i, k in enumerate(kinds)
        ],
    )
    return placed.drop(*[f"__{c}{i}" for c in "mgne" for i in every])


def labelled(kinds: list[str], first: int = 0) -> str:
    """SQL: the spans of columns ``__k<i>`` as (start, kind number, end), ordered."""
    each = [f"transform(__k{first + i}, x -> struct(x.s AS s, {first + i} AS k, x.e AS e))" for i in range(len(kinds))]
    return f"sort_array(concat({', '.join(each)}))"


def with_uncovered(df: DataFrame, spans: str, stay: int, name: str) -> DataFrame:
    """Adds ``name``: of an array of (s, k, e), those of a kind below ``stay``, and of the
    others those that lie in no other span (of equal ones the first kind stays), ordered."""
    # by start, the longest first, then by kind: what covers a span comes before it
    order = f"sort_array(transform({spans}, z -> struct(z.s AS s, -z.e AS r, z.k AS k)))"
    tops = df.selectExpr("*", f"{order} AS __o").selectExpr("*", "transform(__o, z -> -z.r) AS __z").selectExpr("*", f"{running('__z', 'greatest({}, {})'.format)} AS __t")
    # arrays meet by zip_with: a column that a lambda indexes may be worked out anew for each element
    before = "slice(concat(array(-1), __t), 1, size(__o))"
    left = f"filter(zip_with(__o, {before}, (z, t) -> struct(z.s AS s, z.k AS k, -z.r AS e, t AS t)), z -> z.k < {stay} OR z.t < z.e)"
    return tops.selectExpr("*", f"sort_array(transform({left}, z -> struct(z.s AS s, z.k AS k, z.e AS e))) AS {name}").drop("__o", "__z", "__t")


def joined(spans: str, names: list[str]) -> str:
    """SQL: ``kind:start:end`` by comma, of an array of (s, k, e)."""
    table = "array(" + ", ".join(quoted(n) for n in names) + ")"
    return f"array_join(transform({spans}, x -> concat(get({table}, x.k), ':', x.s, ':', x.e)), ',')"
