"""The conversation prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terravane.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Counter of the trie's nodes, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}
    nodes, ends = defaultdict(set), defaultdict(set)
    for c, mine in turns.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        path = (turns.get(c - c % 5, []) if c is not None else [])[:h] + mine[h:]
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].add(c)
        ends[tuple(path)].add(c)
    children = Counter(n[:-1] for n in nodes if n)
    below = defaultdict(lambda: [0, 0])
    for n, members in nodes.items():
        value = (len(members) - 1) * len(n[-1][1].encode()) if n else 0
        for d in range(len(n) + 1):
            below[n[:d]][0] += not children[n]
            below[n[:d]][1] += value
    least = {n: min((c for c in m if c is not None), default=None) for n, m in nodes.items()}
    sha = lambda n: hashlib.sha256(",".join(str(c) for c in sorted(c for c in ends[n] if c is not None)).encode()).hexdigest()
    return Counter((least[n], len(n), least[n[:-1]] if n else None, len(m), children[n], *below[n], sha(n)) for n, m in nodes.items())


def run(turns, **sizes):
    got = prefix_trie.build(*prefix_trie.grafted(prefix_trie.ordered_turns(turns)), **sizes)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    return Counter(map(tuple, got.select(*COLUMNS).collect()))


@pytest.mark.parametrize("sizes", [{}, {"stretch": 2, "run": 3}])
def test_shared_and_repeated_conversations(spark, sizes):
    draw = random.Random(4)
    rows = []
    for c in range(60):
        n = draw.choice([1, 1, 2, 3, 7, 12])
        rows += [(c, None if i == 0 and c % 7 == 0 else i, ("user", "assistant")[i % 2], draw.choice(["hi", "ß", "", "more"])) for i in range(n)]
    rows += [(c, i, "user", "same") for c in range(100, 140) for i in range(3)]  # one conversation, many times
    rows += [(200, 1, "user", "x")] * 5 + [(201, 1, r, t) for r in ("user", None, "") for t in ("b", "a", None)]
    rows += [(None, 1, "user", "hi"), (None, 0, None, None)]
    turns = spark.createDataFrame(rows, TURNS).repartition(3).withColumn("depth", F.lit("own")).withColumn("k0", F.lit(1))
    assert run(turns, **sizes) == plain(rows)


def test_deep_conversations(spark):
    """Two equal conversations of 300 turns and one that leaves them half-way: few rounds."""
    rows = [(c, i, "user", f"t{i}" if c < 11 or i < 150 else f"other {i}") for c in (10, 11, 12) for i in range(300)]
    assert run(spark.createDataFrame(rows, TURNS), stretch=64) == plain(rows)


def test_turnless_and_empty(spark):
    # conversation 4 has fewer turns than it gives up, and the one it would take them from is absent
    rows = [(c, 0, "user", "hi") for c in (4, 8, 9)]
    want = plain(rows)
    assert any(k[1] == 0 and k[-1] != hashlib.sha256(b"").hexdigest() for k in want)
    assert run(spark.createDataFrame(rows, TURNS)) == want
    assert not run(spark.createDataFrame([], TURNS))


def test_role_and_text_do_not_run_together(spark):
    rows = [(5, 0, "ab", "c"), (10, 0, "a", "bc"), (15, 0, "", "abc"), (20, 0, "abc", "")]
    rows = [(c, i, r, t) for c, _, r, t in rows for i in range(10)]
    assert run(spark.createDataFrame(rows, TURNS)) == plain(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, prefix_trie.op11_prefix_trie(spark, sf).select(*COLUMNS).collect())) == plain(rows)
