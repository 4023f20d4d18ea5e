r"""Personal data: base formats, and candidates judged by boosted trees.

Fixed patterns with their checks (octets, Luhn, digit counts) give the base
spans, which always stay.  High-recall generators propose further candidates, which
overlap each other and the base: maximal runs of digits with separators, phone-like
pieces and other number formats inside such runs, account numbers, dates, names after
a title, streets, and addresses written around an ``at``.  Boosted trees over format
and context features score each candidate, and thresholds calibrated on held-out
samples selects those that are added under their generator's name.  A candidate
inside another accepted one, or inside a base span, is left out; accepted ones that
overlap in part both stay.

The trees are trained on sentences made by rule: what a generator proposes in them is
personal only if it is exactly a planted span.  They are compiled into one SQL
expression, so scanning uses built-in functions only.

Defined results
* null or empty text: no spans, empty strings.  Whole texts are scanned.
* Repeated rows are scanned row by row; empty table: empty result; input columns
  named like an output column are replaced by it.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import boosting
from terravane.llm.spans import Kind, joined, labelled, quoted, with_spans, with_uncovered

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
#: Luhn over the digits d of a match: from the right, every second one doubled.
_LUHN = f"""get(transform(array(split(reverse({_DIGITS}), '')), d ->
    aggregate(transform(d, (c, i) -> CASE WHEN i % 2 = 0 THEN cast(c AS int)
        WHEN cast(c AS int) < 5 THEN 2 * cast(c AS int) ELSE 2 * cast(c AS int) - 9 END), 0, (a, v) -> a + v)), 0) % 10 = 0"""

BASE = [
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        guard="contains(text, '@')",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        rf"x.t RLIKE {quoted(rf'^{_OCTET}(?:\.{_OCTET}){{3}}$')}",
        "__digit AND contains(text, '.')",
    ),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9]){13,}+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND CASE WHEN length({_DIGITS}) <= 19 THEN {_LUHN} ELSE false END", "__digit"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15", "contains(text, '+')"),
]
_UPPER, _LOWER = "[A-ZÀ-ÖØ-Þ]", "[a-zß-öø-ÿ]"
_titled = " OR ".join(f"contains(text, '{t}')" for t in ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr"))
#: The generators: loose on purpose, the trees decide.  They read alike in Java and Python.
GENERATORS = [
    Kind("number", r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+", guard="__digit"),
    Kind("tel", r"(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?[\x20./-]{0,2}[0-9]{3,4}[\x20./-]?[0-9]{3,6}(?![0-9])", guard="__digit"),
    Kind("serial", r"(?<![0-9A-Za-z])[0-9]{2,4}(?:[-.][0-9]{2,4}){2,3}(?![0-9])", guard="__digit"),
    Kind("account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){3,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", guard="__digit"),
    Kind("date", r"(?<![0-9])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])", guard="__digit"),
    Kind("name", rf"(?<![0-9A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20{_UPPER}{_LOWER}+(?:\x20{_UPPER}{_LOWER}+)?", guard=_titled),
    Kind("street", rf"(?<![0-9A-Za-z])[0-9]{{1,5}}\x20(?:{_UPPER}{_LOWER}+\x20){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd)(?![0-9A-Za-z])", guard="__digit"),
    Kind(
        "contact",
        r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{2,}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?|\.)[A-Za-z0-9-]++)++",
        guard="(contains(text, 'at)') OR contains(text, 'at]') OR contains(text, ' at '))",
    ),
]
KINDS = [*BASE, *GENERATORS]
CUES = r"(?:tel|telephone|phone|call|fax|mobile|cell|ssn|social|contact|mail|iban|account|passport|patient|member)[^0-9A-Za-z]{0,4}(?:is|no|nr|number|id)?[^0-9A-Za-z]{0,3}$"
BORN = r"(?:born|birth|dob|geboren|birthday|naissance|nacido)[^0-9A-Za-z]{0,4}(?:on|am|is|le|el)?[^0-9A-Za-z]{0,3}$"
#: A number's usual end; a run with several of them glues numbers together.
PIECE = r"[0-9]{2,3}[\x20./-][0-9]{4}(?![0-9])"
WRITTEN = r"[\(\[]|\x20dot\x20"
TLD = r"(?:com|org|net|edu|info|de|fr|es|io)$"

#: Feature name, and its SQL over ``x.t`` (match) and ``x.l`` (text before); the generator's number comes first.
FEATURES = [
    ("chars", "length(x.t)"),
    ("digits", f"length({_DIGITS})"),
    ("groups", "length(regexp_replace(x.t, '[0-9]+', '0')) - length(regexp_replace(x.t, '[0-9]+', ''))"),
    ("dashes", "length(regexp_replace(x.t, '[^-]', ''))"),
    ("dots", "length(regexp_replace(x.t, '[^.]', ''))"),
    ("slashes", "length(regexp_replace(x.t, '[^/]', ''))"),
    ("spaces", "length(regexp_replace(x.t, '[^ ]', ''))"),
    ("opens", "length(regexp_replace(x.t, '[^(]', ''))"),
    ("first", "length(regexp_extract(x.t, '[0-9]+', 0))"),
    ("last", "length(regexp_extract(x.t, '[0-9]+$', 0))"),
    ("pieces", f"regexp_count(x.t, {quoted(PIECE)})"),
    ("cue", f"cast(lower(x.l) RLIKE {quoted(CUES)} AS int)"),
    ("born", f"cast(lower(x.l) RLIKE {quoted(BORN)} AS int)"),
    ("written", f"cast(x.t RLIKE {quoted(WRITTEN)} AS int)"),
    ("tld", f"cast(x.t RLIKE {quoted(TLD)} AS int)"),
]


def features_of(kind: int, text: str, left: str) -> list[int]:
    """The same features in Python, for training."""
    d = re.sub("[^0-9]", "", text)
    first, last = re.search("[0-9]+", text), re.search("[0-9]+$", text)
    return [
        kind, len(text), len(d), len(re.findall("[0-9]+", text)), text.count("-"), text.count("."), text.count("/"), text.count(" "), text.count("("),
        len(first[0]) if first else 0, len(last[0]) if last else 0, len(re.findall(PIECE, text)),
        int(bool(re.search(CUES, left.lower(), re.A))), int(bool(re.search(BORN, left.lower(), re.A))), int(bool(re.search(WRITTEN, text))), int(bool(re.search(TLD, text))),
    ]


def proposed(text: str, context: int = 24) -> list[tuple[int, int, int, str]]:
    """What the generators propose: (generator, start, end, text before since its last match)."""
    out = []
    for k, g in enumerate(GENERATORS):
        at = 0
        for m in re.finditer(g.pattern, text):
            out.append((k, m.start(), m.end(), text[at : m.start()][-context:]))
            at = m.end()
    return out


def sentences(count: int = 4000, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """(text, planted personal spans), made by rule: one to three items, personal or
    not, between words; some stand side by side."""
    draw = random.Random(seed)
    n = lambda k: "".join(draw.choices("0123456789", k=k))
    upto = lambda a, b: str(draw.randint(a, b))
    word = lambda: "".join(draw.choices(["an", "er", "mi", "lo", "ka", "the", "son", "re"], k=draw.randint(1, 3)))
    cap = lambda: word().capitalize()
    cues = ["tel: ", "phone ", "call ", "Fax: ", "mobile no ", "contact: ", "SSN ", "cell "]
    plain = ["", "in the ", "of ", "page ", "table ", "on ", "since ", "version ", "id ", "total ", "le ", "und "]
    born = ["born ", "DOB: ", "date of birth ", "geboren am ", "born on "]
    day = lambda: draw.choice([f"{upto(1, 28)}.{upto(1, 12)}.{upto(1900, 2030)}", f"{upto(10, 28)}/{upto(10, 12)}/{upto(1900, 2030)}", f"{upto(1900, 2030)}-0{upto(1, 9)}-{upto(10, 28)}"])
    either = lambda: draw.choice(draw.choice([cues, plain]))
    number = lambda: draw.choice([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}-{n(2)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}"])
    personal = [
        lambda: (either(), number()),
        lambda: (either(), number()),
        lambda: (draw.choice(cues), draw.choice([n(10), f"0{n(9)}", f"0{n(2)} {n(3)} {n(4)}", f"0{n(3)}/{n(6)}", f"{n(3)} {n(3)} {n(4)}"])),
        lambda: (draw.choice(["mail ", "write ", ""]), draw.choice([f"{word()}.{word()} (at) {word()}.com", f"{word()}{n(2)} [at] {word()} [dot] org", f"{word()} at {word()} dot net"])),
        lambda: (draw.choice(["IBAN ", "account ", ""]), f"{draw.choice(['DE', 'FR', 'ES', 'GB'])}{n(2)} " + " ".join(n(4) for _ in range(draw.randint(3, 5))) + draw.choice(["", f" {n(2)}"])),
        lambda: (draw.choice(born), day()),
        lambda: (draw.choice(plain), f"{draw.choice(['Mr.', 'Mrs.', 'Dr.', 'Herr', 'Frau', 'Prof.'])} {cap()}{draw.choice(['', ' ' + cap()])}"),
        lambda: (draw.choice(["at ", "lives at ", ""]), f"{upto(1, 999)} {cap()} {draw.choice(['Street', 'Avenue', 'Road', 'Lane'])}"),
    ]
    other = [
        lambda: (draw.choice(plain), day()),
        lambda: (draw.choice(plain), n(draw.randint(7, 24))),
        lambda: (draw.choice(plain), " ".join(n(draw.randint(1, 4)) for _ in range(draw.randint(4, 9)))),
        lambda: (draw.choice(plain), draw.choice([f"{n(2)}.{n(3)}.{n(3)}", f"{n(1)}.{n(2)}.{n(3)}.{n(4)}", f"{upto(1, 200)}.{upto(1, 200)}.{upto(1, 200)}.{upto(1, 200)}"])),
        lambda: (draw.choice(plain), f"{word()} at {word()}.{word()}"),
        lambda: (draw.choice(plain), draw.choice([f"{n(4)}-{n(4)}", f"{n(3)} {n(3)} {n(3)}", f"{n(2)}/{n(2)}/{n(2)}/{n(3)}", f"{n(5)}-{n(5)}-{n(5)}", f"{n(2)}-{n(2)}-{n(2)}-{n(2)}"])),
        lambda: (draw.choice(plain), f"{upto(1900, 2030)} {upto(1900, 2030)} {upto(1900, 2030)}"),
        lambda: (draw.choice(plain), f"{draw.choice(['AB', 'XK', 'TT'])}{n(2)}{word().upper()[:4].ljust(4, 'X')}{n(4)}{word().upper()[:4].ljust(4, 'Y')}"),
    ]
    made = []
    for _ in range(count):
        text, spans = f"{word()} {word()} ", []
        for _ in range(draw.randint(1, 3)):
            mine = draw.random() < 0.5
            left, item = draw.choice(personal if mine else other)()
            text += left
            if mine:
                spans.append((len(text), len(text) + len(item)))
            text += item
            if draw.random() < 0.3:  # another number right beside it
                text, more = text + draw.choice([" ", " / ", "  "]), number()
                spans.append((len(text), len(text) + len(more)))
                text += more
            text += draw.choice([" ", " ", ", ", f" {word()} ", f". {word()} {word()} "])
        made.append((text + word(), spans))
    return made


def labelled_samples(count: int = 4000, seed: int = 5) -> list[tuple[int, str, str, int]]:
    """(generator, candidate, text before it, personal or not) of the made sentences."""
    return [(k, text[a:b], left, int((a, b) in spans)) for text, spans in sentences(count, seed) for k, a, b, left in proposed(text)]


@lru_cache
def model(probability: float = 0.5) -> tuple[list[boosting.Node], list[float]]:
    """The trees, and for each generator the least score whose calibrated probability is
    ``probability`` or more (infinite where there is none).  Scores are calibrated
    generator by generator, by isotonic regression on the held-out third of the samples."""
    made = labelled_samples()
    x, y = np.array([features_of(*m[:3]) for m in made]), np.array([m[3] for m in made])
    held = np.arange(len(y)) % 3 == 0
    trees = boosting.fit(x[~held], y[~held], rounds=40, depth=4)
    score = boosting.predict(trees, x[held])
    thresholds = []
    for g in range(len(GENERATORS)):
        own = x[held][:, 0] == g
        thresholds.append(boosting.score_at(probability, *boosting.isotonic(score[own], y[held][own])))
    return trees, thresholds


def trained() -> tuple[str, str]:
    """The trees as SQL over ``x.f``, and the threshold of a candidate's generator."""
    trees, thresholds = model()
    least = ", ".join("cast('Infinity' AS double)" if t == float("inf") else f"{t!r}D" for t in thresholds)
    return boosting.to_sql(trees, [f"get(x.f, {i})" for i in range(1 + len(FEATURES))]), f"get(array({least}), cast(get(x.f, 0) AS int))"


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Input columns plus n_email, n_ip, n_card, n_phone, n_added, base_spans,
    all_spans (``kind:start:end`` lists) and found: the spans as (s, k, e)."""
    names = [k.name for k in KINDS]
    made = ["n_email", "n_ip", "n_card", "n_phone", "n_added", "base_spans", "all_spans", "found"]
    rest = [c for c in docs.columns if c not in made]
    body = docs.selectExpr(f"struct({', '.join(f'`{c}`' for c in rest)}) AS __row", f"coalesce(`{text_col}`, '') AS text")
    # what most patterns need is looked for once
    body = body.withColumn("__digit", F.col("text").rlike("[0-9]"))
    spans = with_spans(body, "text", KINDS)
    score, least = trained()
    values = ", ".join(f for _, f in FEATURES)
    first = len(BASE)
    # all candidates of a text in one array, so that the trees stand in the plan once
    listed = [f"transform(__k{first + g}, x -> struct(x.s AS s, {first + g} AS k, x.e AS e, array({g}, {values}) AS f))" for g in range(len(GENERATORS))]
    base = spans.selectExpr("*", f"{labelled(names[:first])} AS __base", f"concat({', '.join(listed)}) AS __made")
    judged = base.selectExpr("*", f"transform(filter(__made, x -> {score} >= {least}), x -> struct(x.s AS s, x.k AS k, x.e AS e)) AS __good")
    both = with_uncovered(judged, "concat(__base, __good)", first, "__all")
    return both.selectExpr(
        "__row.*",
        *[f"cast(size(__k{i}) AS bigint) AS n_{n}" for i, n in enumerate(names[:first])],
        "cast(size(__all) - size(__base) AS bigint) AS n_added",
        f"{joined('__base', names)} AS base_spans",
        f"{joined('__all', names)} AS all_spans",
        "__all AS found",
    )


def redacted(text: str, found: str) -> str:
    """SQL: ``text`` with each span of ``found`` (ordered, possibly overlapping)
    replaced by ``[kind]``; overlapping spans become one."""
    names = "array(" + ", ".join(quoted(k.name) for k in KINDS) + ")"
    return f"""get(transform(array(aggregate({found}, struct(0 AS at, cast('' AS string) AS out),
        (a, x) -> struct(greatest(a.at, x.e) AS at,
            CASE WHEN x.s < a.at THEN a.out ELSE concat(a.out, substring({text}, a.at + 1, x.s - a.at), '[', get({names}, x.k), ']') END AS out))),
        r -> concat(r.out, substring({text}, r.at + 1, length({text})))), 0)"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_personal_data(docs).selectExpr(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "sha2(base_spans, 256) AS base_sha256", "all_spans AS spans", "n_added"
    )
