"""Merkle manifests against a plain tree builder."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terravane.llm import merkle

FIELDS = merkle.FIELDS


def h(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(digests, fanout):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path(made, at, fanout):
    out = []
    for row in made[:-1]:
        first = at - at % fanout
        out.append(("".join(row[first:at]), "".join(row[at + 1 : first + fanout])))
        at //= fanout
    return out


def plain(rows, fanout):
    """Counter of (doc_id, leaf, subroot, root, proof, folded, verified)."""
    trees = defaultdict(list)
    for r in rows:
        changed = dict(zip(FIELDS, r))
        tampered = None
        if changed["doc_id"] is not None and zlib.crc32(str(changed["doc_id"]).encode()) % 7 == 0:
            if changed["n_chars"] is not None:
                changed["n_chars"] += 1
            tampered = leaf(changed[f] for f in FIELDS)
        trees[changed["lang"]].append((changed["doc_id"], leaf(r), tampered))
    first = lambda v: (v is not None, (v.encode() if isinstance(v, str) else v) if v is not None else 0)
    names, out = sorted(trees, key=first), Counter()
    for tree in trees.values():
        tree.sort(key=lambda x: (*first(x[0]), x[1]))
    made = {n: levels([x[1] for x in trees[n]], fanout) for n in names}
    top = levels([made[n][-1][0] for n in names], fanout)
    for k, n in enumerate(names):
        for i, (doc_id, own, tampered) in enumerate(trees[n]):
            way = path(made[n], i, fanout) + path(top, k, fanout)
            got = tampered or own
            for left, right in way:
                got = h(left + got + right)
            out[doc_id, own, made[n][-1][0], top[-1][0], h("".join(a + b for a, b in way)), got, got == top[-1][0]] += 1
    return out


def run(docs, fanout=2, rows=merkle.ROWS):
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    changed = merkle.leaf_digest([more if f == "n_chars" else F.col(f) for f in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, changed)
    trees, top = merkle.manifest(docs, FIELDS, "lang", "doc_id", {"tampered": tampered}, fanout, rows)
    root = merkle.folded(F.coalesce("tampered", "digest"), F.col("path"))
    got = merkle.proofs(trees, top).select("doc_id", "digest", "subroot", "root", merkle.proof_digest(F.col("path")), root, root == F.col("root"))
    return Counter(map(tuple, got.collect())), trees, top


@pytest.mark.parametrize(("fanout", "rows"), [(2, merkle.ROWS), (2, 5), (3, 4), (5, 20)])
def test_trees_of_many_passes(spark, fanout, rows):
    langs = ["de", None, "en", "", "é", "one"]
    made = [(i, f"text {i}", langs[0 if i % 3 else i % 5], f"s{i % 4}", i) for i in range(150)] + [(999, "alone", "one", None, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    got, trees, top = run(docs, fanout, rows)
    assert got == plain([tuple(r) for r in docs.select(*FIELDS).collect()], fanout)
    assert (len(trees.passes) > 1) == (rows < 100)
    assert any(verified for *_, verified in got) and not all(verified for *_, verified in got)
    sizes = Counter(r["lang"] for r in docs.collect())
    assert Counter(r["tree"] for r in trees.nodes().collect()) == {n: sum(merkle.widths(k, fanout)) for n, k in sizes.items()}
    assert {(r["tree"], r["total"]) for r in trees.roots().collect()} == set(sizes.items())


def test_repeated_rows(spark):
    """Equal rows are split between partitions."""
    docs = spark.createDataFrame([(7, "same", "en", "s", 4)] * 120 + [(8, "other", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got, trees, _ = run(docs.repartition(3), 2, 10)
    assert got == plain([tuple(r) for r in docs.select(*FIELDS).collect()], 2)
    assert trees.passes[0].select("part").distinct().count() > 5


def test_odd_documents(odd_docs, no_docs):
    clash = odd_docs.select("*", *[F.lit("own").alias(c) for c in ("tree", "part", "at", "digest", "home", "path", "tampered")])
    assert run(clash, 2, 6)[0] == plain([tuple(r) for r in odd_docs.select(*FIELDS).collect()], 2)
    got, trees, top = run(no_docs)
    assert not got and trees.roots().count() == 0 and top.nodes().count() == 0


def test_single_document(spark):
    docs = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = run(docs)[0]
    assert row[1] == row[2] == row[3] == h("1:1----") and row[4] == h("")


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = Counter(map(tuple, merkle.op12_merkle_manifest(spark, sf).collect()))
    assert got == plain([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()], 2)
