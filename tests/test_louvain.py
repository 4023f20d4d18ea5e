"""Louvain over packed blocks: the labels of the plain rule, and no rows of links."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.operators import communities, graph
from terravane.plans import runtime


def plain(pairs, first, sweeps=20, tolerance=1e-6):
    """The rule one vertex after the other; ``first`` says whether (vertex, pair of sweeps) moves in the first of them."""
    links = defaultdict(Counter)
    for a, b, w in pairs:
        if a is not None and b is not None:
            links[a][b] += w
            links[b][a] += w
    member = {v: v for p in pairs for v in p[:2] if v is not None}
    m2 = sum(sum(of.values()) for of in links.values())
    for _ in range(10):
        k = {a: sum(of.values()) for a, of in links.items()}

        def survey(c):
            tot, pick, inside = Counter(), {}, 0.0
            for a in links:
                tot[c[a]] += k[a]
            for a, of in links.items():
                into = Counter({c[a]: 0.0})
                for b, w in of.items():
                    into[c[b]] += w * (a != b)
                    inside += w * (c[a] == c[b])
                gain = lambda t: into[t] - (tot[t] - (k[a] if t == c[a] else 0.0)) * k[a] / m2  # noqa: B023, E731
                pick[a] = max(into, key=lambda t: (gain(t), t == c[a], -t))  # noqa: B023
            return pick, inside / m2 - sum(t * t for t in tot.values()) / (m2 * m2)

        c = {a: a for a in links}
        pick, best = survey(c)
        before = best
        for sweep in range(sweeps):
            after = {a: pick[a] if first[a, sweep // 2] == (sweep % 2 == 0) else c[a] for a in c}
            new, now = survey(after)
            if now > best + tolerance:
                c, pick, best = after, new, now
            elif sweep % 2:
                break
        if best - before < tolerance:
            break
        member = {v: c.get(t, t) for v, t in member.items()}
        merged = defaultdict(Counter)
        for a, of in links.items():
            for b, w in of.items():
                merged[c[a]][c[b]] += w
        links = merged
    return member


def rows(rng, n, m, ids):
    pairs = [(int(ids[a]), int(ids[b]), int(w)) for a, b, w in zip(rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(1, 4, m))]
    groups = [(int(ids[a]), int(ids[a - a % 10 + b]), 3) for a, b in zip(rng.integers(0, n - 10, m), rng.integers(0, 10, m))]
    return pairs + groups + [(None, int(ids[3]), 5), (int(ids[4]), None, 2), (None, 10**12, 1), (-(10**12), -(10**12), 4)]


@pytest.mark.parametrize("block", [64, 1 << 19])
def test_labels_are_those_of_the_plain_rule(spark, monkeypatch, block):
    monkeypatch.setattr(communities, "BLOCK", block)
    monkeypatch.setattr(communities, "PIECE", min(block, 48))
    rng = np.random.default_rng(17)
    ids = np.sort(rng.choice(10**6, 120, replace=False)) - 500_000
    pairs = rows(rng, 120, 200, ids)
    e = spark.createDataFrame(pairs, "v0 long, v1 long, weight int")
    ends = spark.createDataFrame([(v,) for v in {v for p in pairs for v in p[:2]} - {None}], "a long")
    halves = ends.select("a", *[(F.pmod(F.xxhash64("a", F.lit(i)), F.lit(2)) == 0).alias(f"t{i}") for i in range(10)]).collect()
    want = plain(pairs, {(r.a, i): r[f"t{i}"] for r in halves for i in range(10)})
    got = graph.louvain(e, "weight").collect()
    assert len(got) == len(want) and {r.vertex_id: r.label for r in got} == want
    assert 1 < len(set(want.values())) < len(want) / 2


def test_no_table_has_a_row_for_each_link(spark, monkeypatch):
    """After the edges, tables have a row for each vertex, or for each pair of blocks."""
    seen, write = [], runtime.materialize

    def noted(df, label, *more):
        table = write(df, label, *more)
        seen.append((label, table.count()))
        return table

    rng = np.random.default_rng(3)
    ends = rng.integers(0, 60, (3000, 2))
    e = spark.createDataFrame([(int(a), int(b)) for a, b in ends], "v0 long, v1 long")
    monkeypatch.setattr(runtime, "materialize", noted)
    labels = graph.louvain(e)
    assert labels.count() == 60 and len(seen) > 4
    assert max(n for _, n in seen[1:]) <= 60


def test_edges_without_weight_or_rows(spark):
    assert graph.louvain(spark.createDataFrame([], "v0 int, v1 int")).count() == 0
    nulls = graph.louvain(spark.createDataFrame([(1, None), (None, None), (None, 2)], "v0 int, v1 int"))
    assert {tuple(r) for r in nulls.collect()} == {(1, 1), (2, 2)} and [f.dataType.simpleString() for f in nulls.schema] == ["int", "int"]
