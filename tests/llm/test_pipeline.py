"""The pipeline's stages and rows against brute force, and the queries' contracts."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_arrow import WORD, contamination, groups, shingles
from tests.llm.test_native import secrets

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with copies, leaks, secrets and junk, and its benchmark."""
    draw = random.Random(12)
    en = ["the", "house", "and", "garden", "of", "winter", "with", "many", "people", "that", "walk", "slowly", "under", "trees"]
    de = ["der", "Hund", "und", "die", "Katze", "von", "einem", "Mann", "nicht", "auf", "Straße", "gehen", "langsam", "unter"]
    make = lambda words, k: " ".join(draw.choices(words, k=k))
    texts = [(make(en if i % 2 else de, draw.randint(30, 200)), "en" if i % 2 else "de") for i in range(40)]
    item = " ".join(f"leak{i}" for i in range(15))
    texts += [(texts[0][0], "de"), (texts[1][0] + " end", "en"), (make(en, 20) + " " + item + " " + make(en, 20), "en")]
    texts += [(make(en, 30) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en"), (None, "en"), ("", None), ("123 -- 456", "en")]
    rows = [(i, t, lang, f"s{i % 3}" if i % 7 else None, len(t or "")) for i, (t, lang) in enumerate(texts)]
    where = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "never seen here at all by anyone in any document whatever")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), rows, [(1, item)]


def test_stages(spark, corpus, tmp_path):
    where, rows, items = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, where)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mixing":
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        left[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} if name != "mixing" else docs.collect()
    text = {r[0]: r[1] for r in rows}
    # language: only what has no letters goes
    assert set(left["language_id"]) == {k for k, t in text.items() if t and re.search(r"[^\W\d_]", t)}
    now = [(k, t) for k, t in left["language_id"].items()]
    kept = {k for (k, _), (_, c) in zip(now, groups(now)) if c == k}
    assert set(left["near_dedup"]) == kept
    clean = {k for k in kept if not contamination(text[k], items)[1]}
    assert set(left["decontamination"]) == clean and len(clean) < len(kept)
    safe = {k for k in clean if not secrets(text[k])}
    assert set(left["secret_scans"]) == safe and len(safe) < len(clean)
    mix = left["mixing"]
    words = {k: WORD.findall(text[k]) for k in safe}
    assert {r.doc_id for r in mix} <= safe
    assert sum(r.words for r in mix) == pytest.approx(1.5 * sum(map(len, words.values())), abs=3)
    assert all(r.text.split(" ") == words[r.doc_id][r.from_word : r.from_word + r.words] for r in mix)
    key = lambda r: (r.shard, r.slot, r.at, r.doc_id, r.from_word, r.words, r.text)
    assert Counter(map(key, corpus_pipeline.run(spark, where).collect())) == Counter(map(key, mix))


def test_runs_do_not_disturb_each_other(spark, corpus):
    first, second = (corpus_pipeline.run(spark, corpus[0]) for _ in range(2))
    assert first.count() == second.count() > 0


def test_secrets_are_filtered_above_a_written_scan(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    plan = corpus_pipeline.drop_secrets(spark, docs, corpus[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "__n" in plan


def test_unknown_languages_go(spark, corpus):
    """Texts in a script no document has are dropped; those in known languages stay."""
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    strange = ["Η γλώσσα αυτή δεν υπάρχει σε κανένα έγγραφο της συλλογής μας", "这 种 语言 在 任何 文件 中 都 没有 出现 过"]
    more = spark.createDataFrame([(900 + i, t, None, "s", len(t)) for i, t in enumerate(strange)], DOC)
    left, alone = ({r.doc_id for r in corpus_pipeline.keep_known_languages(spark, d, corpus[0]).collect()} for d in (docs.union(more), docs))
    assert left == alone and len(left) > 40


def test_stages_of_odd_tables(spark, corpus, no_docs, odd_docs):
    """Empty tables stay empty; nulls, repeats and further columns named like made ones pass."""
    clash = odd_docs.withColumn("score", F.lit("x")).withColumn("found", F.lit(1)).withColumn("items", F.lit(2)).withColumn("component_id", F.lit(3))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, corpus[0]).count() == 0
        out = stage(spark, clash, corpus[0])
        if name != "mixing":
            assert out.columns == clash.columns
        assert out.count() > 0


def test_near_copies_from_four_fifths(spark):
    """The stage drops copies at similarity 0.80 to 0.85, and none below 0.80."""
    words = [f"w{i}" for i in range(104)]
    texts = [" ".join(words), " ".join(words[:84]), " ".join(words[:87])]  # 100, 80 and 83 shingles
    other = [f"o{i}" for i in range(104)]
    texts += [" ".join(other), " ".join(other[:83])]  # 100 and 79
    sets = [shingles(t) for t in texts]
    assert [100 * len(sets[a] & sets[b]) // len(sets[a] | sets[b]) for a, b in ((0, 1), (0, 2), (3, 4))] == [80, 83, 79]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {0, 3, 4}


@pytest.mark.parametrize("name", [n for n in __spark_entry__.queries() if re.match(r"op\d+_|contract_", n)])
def test_queries_match_their_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SF)
    sql = __spark_entry__.oracle_sql().get(name)
    rows = Counter(tuple(r[c] for c in sorted(got.columns)) for r in got.collect())
    assert rows
    if sql:
        db = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert Counter(tuple(x for _, x in sorted(zip(names, r))) for r in want.fetchall()) == rows
