import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, repeats, a very long text, control characters."""
    draw = random.Random(3)
    vocabulary = ["the", "and", "of", "house", "Größe", "élan", "x1", "niño", "A", "b-c", "42", "von"]
    prose = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 120))) for _ in range(12)]
    long = " ".join(draw.choices(vocabulary, k=60_000))
    return [None, "", "   ", "\n\n", "a", "a b", "A\tb\x0bc\r\nd", "…—€", "\u00a0x\u00a0", *prose, prose[0], prose[0], long]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Documents with those texts; ids repeat and one is null, as do languages and sources."""
    langs, sources = ["en", "de", None, "fr"], ["s1", None, "s0", "ß"]
    rows = [(i if i % 9 else i // 2, t, langs[i % 4], sources[i % 4], len(t or "")) for i, t in enumerate(odd_texts)]
    return spark.createDataFrame([*rows, (None, "null id here", None, None, None)], DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
