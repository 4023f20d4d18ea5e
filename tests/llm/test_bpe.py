"""BPE encoding and decoding against the tokenizers library and against the merges themselves."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terravane.llm import bpe

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


def digest(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))


def test_every_common_character(library, encoder):
    chars = [c for c in map(chr, range(0x2100)) if not encoder.v.rare.match(c)]
    assert len(chars) > 350
    for c in chars:
        for text in (c, f"a{c}b", f"A {c}1{c}", f"é{c}'S"):
            assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_random_texts(library, encoder):
    draw = random.Random(5)
    for k in range(3000):
        text = "".join(draw.choice("aaabbcdeinth 'sΣσİß漢字😀́<|endoftext|>12!?\x1c\t") for _ in range(draw.randint(0, 40)))
        if k % 5 == 0:
            text = draw.choice(["<|endoftext|>", "<|startoftext|>"]).join([text, text[:3], ""])
        ids = encoder.encode(text)
        said = library.encode(text, add_special_tokens=False)
        assert ids == said.ids, repr(text)
        assert encoder.decode(ids) == library.decode(said.ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000 + "c", "é" * 777, "x" * bpe.LONGEST, "x" * (bpe.LONGEST + 1)])
def test_long_words(library, encoder, text):
    assert encoder.encode(text + " " + text) == library.encode(text + " " + text, add_special_tokens=False).ids


def test_tokens_that_stay_apart(encoder):
    v, draw = encoder.v, random.Random(7)
    every = list(v.size)
    inner = [t for t in every if v.symbols[t][-1] < 256]
    for k in range(20_000):
        a, b = (draw.choice(inner), draw.choice(every)) if k % 2 else (draw.choice(inner[:600]), draw.choice(every[:3000]))
        assert v.apart(a, b) == (v.merged(v.symbols[a] + v.symbols[b]) == [a, b])


def test_prefixes_are_worked_out_once():
    own = bpe.Encoder(PATH)
    own.encode("reading readings reader readers read")
    assert len(own.state) == 1 + len({w[:n] for w in ["reading", "readings", "reader", "readers", "read"] for n in range(1, len(w))})
    held = len(own.state)
    own.encode("reading readers")
    assert len(own.state) == held


def test_trie_begins_anew(library):
    own = bpe.Encoder(PATH, most=50)
    draw = random.Random(9)
    for _ in range(60):
        text = " ".join("".join(draw.choices("abcdeth", k=draw.randint(1, 9))) for _ in range(40))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert len(own.known) <= 50


def test_odd_documents(odd_docs, no_docs, library):
    clash = odd_docs.withColumn("n_tokens", F.lit("own")).withColumn("ids", F.lit(1)).withColumn("extra", F.lit("x"))
    got = bpe.encode(clash, PATH).collect()
    texts = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    assert {(r["doc_id"], r["text"]) for r in got} == texts and len(got) == odd_docs.count()
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == wanted(library, r["text"])
        assert len(r["ids"]) == r["n_tokens"] and r["extra"] == "x"
    assert bpe.encode(no_docs, PATH).count() == 0


def test_decoding(odd_docs, library):
    for r in bpe.decode(bpe.encode(odd_docs, PATH).withColumn("decoded", F.lit(0)), PATH).collect():
        assert digest(r["decoded"]) == r["decoded_sha256"]


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.op13_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == wanted(library, docs[r["doc_id"]])
