r"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a few megabytes of whole documents as a sequence of words.  Its suffix
array lists, in the order of their words (by hash), every position at which a window of the
benchmark could begin (others cannot match: their first words occur at the start
of no window).  Every test suffix is binary-searched for the range of suffixes
that share its window; each match is then extended word by word to its longest
verbatim length.  Documents with a match are contaminated.

A window is ``window`` consecutive words of an item; an item with fewer words, but
not none, is one window.  Words: A-Z lower-cased, then runs of
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.

The benchmark is read in blocks of at most ``block_bytes`` of text; only one block
is shipped to the executors at a time, however large the benchmark is.

Defined results
* null or empty text: 0 words, no match.  Items with null or empty text: none.
* Items repeated under one id count once; repeated documents are judged one by one.
* Empty benchmark: nothing is hit; empty documents: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm import tokens
from terravane.plans import runtime

_LEAD = 3  # words looked at before a position enters the suffix array
_SLOTS = 1 << 20


class TestSet:
    """The distinct windows of a block of items, in order, with their items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(ids)}
        column = pa.array([t for _, t in items], pa.large_string())
        data, offsets = tokens.text_bytes(column)
        padded, starts, lengths, first = tokens.words(data, offsets, tokens.ALNUM)
        self.words = np.concatenate([tokens.hashes(padded, starts, lengths), np.zeros(window, np.uint64)])
        at, size, item, end = [], [], [], []
        for k, (name, _) in enumerate(items):
            a, b = int(first[k]), int(first[k + 1])
            n = min(window, b - a)
            if n:
                p = np.arange(a, b - n + 1)
                at.append(p), size.append(np.full(len(p), n)), item.append(np.full(len(p), number[name])), end.append(np.full(len(p), b))
        none = [np.zeros(0, np.int64)]
        self.ids = ids
        self.at, self.size, item, self.end = (np.concatenate(x or none) for x in (at, size, item, end))
        # suffixes with equal windows share one search
        key = self._key(self.words, self.at, self.size)
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        self.search_at, self.search_size = self.at[one], self.size[one]
        pair = np.unique(np.stack([which, item]), axis=1) if len(which) else np.zeros((2, 0), np.int64)
        self.items_of, self.items_from = pair[1], np.searchsorted(pair[0], np.arange(len(one) + 1))
        order = np.argsort(which, kind="stable")
        self.suffix_of, self.suffix_from = order, np.searchsorted(which[order], np.arange(len(one) + 1))
        self.lead = {}
        for n in range(1, _LEAD + 1):
            some = self.search_size >= n if n == _LEAD else self.search_size == n
            if some.any():
                self.lead[n] = np.zeros(_SLOTS, bool)
                self.lead[n][self._slot(self.words, self.search_at[some], n)] = True
        self.window = window

    @staticmethod
    def _key(w, at, size):
        h = tokens.mix(size.astype(np.uint64))
        for k in range(int(size.max()) if len(size) else 0):
            more = size > k
            h[more] = tokens.mix(h[more] * np.uint64(31) + w[at[more] + k])
        return h

    @staticmethod
    def _slot(w, at, n):
        h = np.zeros(len(at), np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[at + k]
        return (h >> np.uint64(44)).astype(np.int64)


class SuffixArray:
    """The suffixes of a shard at which a test window may begin, in word order."""

    def __init__(self, w: np.ndarray, first: np.ndarray, test: TestSet):
        self.w = np.concatenate([w, np.zeros(test.window + _LEAD, np.uint64)])
        n = len(w)
        left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words from here to the text's end
        wanted = np.zeros(n, bool)
        for k, table in test.lead.items():
            p = np.flatnonzero(left >= k) if k > 1 else np.arange(n)
            wanted[p[table[TestSet._slot(self.w, p, k)]]] = True
        at = np.flatnonzero(wanted)
        self.left = left
        keys = []
        for k in range(test.window):
            keys.append(np.where(left[at] > k, self.w[at + k], np.uint64(0)))
        order = np.lexsort(keys[::-1]) if len(at) else np.zeros(0, np.int64)
        self.at, self.keys = at[order], [k[order] for k in keys]

    def ranges(self, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct window, the range of suffixes that begin with it."""
        n = len(test.search_at)
        return self._bound(test, n, False), self._bound(test, n, True)

    def _bound(self, test: TestSet, n: int, upper: bool) -> np.ndarray:
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.at), np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            right = np.full(len(open_), upper)  # a suffix equal over the window: go right for the upper bound
            same = np.arange(len(open_))
            for k in range(test.window):
                same = same[test.search_size[open_[same]] > k]
                if not len(same):
                    break
                mine, theirs = test.words[test.search_at[open_[same]] + k], self.keys[k][mid[same]]
                differ = mine != theirs
                right[same[differ]] = theirs[differ] < mine[differ]
                same = same[~differ]
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]


def _longest(sa: SuffixArray, test: TestSet, window_ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Words of the longest verbatim match that starts at each place, over all
    test suffixes that begin with the matched window."""
    best = test.search_size[window_ids].copy()
    counts = test.suffix_from[window_ids + 1] - test.suffix_from[window_ids]
    # suffixes with one window are few; a window shared by many items is tried suffix by suffix
    for nth in range(int(counts.max()) if len(counts) else 0):
        at = np.flatnonzero(counts > nth)
        s = test.suffix_of[test.suffix_from[window_ids[at]] + nth]
        size = test.size[s].copy()
        go = np.arange(len(at))
        while len(go):
            more = (test.at[s[go]] + size[go] < test.end[s[go]]) & (size[go] < sa.left[places[at[go]]])
            go = go[more]
            go = go[test.words[test.at[s[go]] + size[go]] == sa.w[places[at[go]] + size[go]]]
            size[go] += 1
        best[at] = np.maximum(best[at], size)
    return best


_MATCH = T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType())])
_ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_starts", T.ArrayType(T.LongType(), False)),
        T.StructField("hit_ends", T.ArrayType(T.LongType(), False)),
        T.StructField("items", T.ArrayType(T.StringType(), False)),
        T.StructField("longest", T.LongType()),
    ]
)


def _lists(first: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def _kernel(test: TestSet):
    def judge(data, offsets, rows):
        padded, starts, lengths, first = tokens.words(data, offsets, tokens.ALNUM)
        n, docs = len(starts), len(offsets) - 1
        w = tokens.hashes(padded, starts, lengths)
        sa = SuffixArray(w, first, test)
        lo, hi = sa.ranges(test)
        found = hi - lo
        ids = np.repeat(np.arange(len(lo)), found)
        places = sa.at[np.repeat(lo - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(int(found.sum()))] if len(ids) else np.zeros(0, np.int64)
        size = test.search_size[ids]
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, places, 1)
        np.add.at(cover, places + size, -1)
        hit = np.zeros(n + 2, bool)
        hit[1 : n + 1] = np.cumsum(cover[:n]) > 0
        doc_of = np.searchsorted(first, np.arange(n), "right") - 1
        # spans of hit words, cut where a text ends
        begins = np.flatnonzero(hit[1:-1] & (~hit[:-2] | np.isin(np.arange(n), first)))
        ends = np.flatnonzero(hit[1:-1] & (~hit[2:] | np.isin(np.arange(n) + 1, first))) + 1
        span_doc = doc_of[begins]
        span_first = np.searchsorted(span_doc, np.arange(docs + 1))
        longest = np.zeros(docs, np.int64)
        place_doc = doc_of[places]
        np.maximum.at(longest, place_doc, _longest(sa, test, ids, places))
        seen = np.unique(place_doc * max(1, len(lo)) + ids)
        wd, wi = seen // max(1, len(lo)), seen % max(1, len(lo))
        many = test.items_from[wi + 1] - test.items_from[wi]
        item = test.items_of[np.repeat(test.items_from[wi] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))] if len(wi) else np.zeros(0, np.int64)
        pair = np.unique(np.repeat(wd, many) * max(1, len(test.ids)) + item)
        item_first = np.searchsorted(pair // max(1, len(test.ids)), np.arange(docs + 1))
        names = pa.array(test.ids, pa.string()).take(pa.array(pair % max(1, len(test.ids)), pa.int64()))
        return {
            "n_words": pa.array(np.diff(first), pa.int64()),
            "hit_starts": _lists(span_first, begins - first[span_doc], pa.int64()),
            "hit_ends": _lists(span_first, ends - first[span_doc], pa.int64()),
            "items": pa.ListArray.from_arrays(pa.array(item_first, pa.int32()), names),
            "longest": pa.array(longest, pa.int64()),
        }

    return judge


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The items in blocks of bounded text, read partition by partition."""
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        n = len(row[1].encode()) + 64
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((str(row[0]), row[1]))
        size += n
    yield block


def _merged(starts: Column, ends: Column) -> Column:
    """Words in the union of the spans of two lists, joined."""
    spans = F.sort_array(F.arrays_zip(starts.alias("s"), ends.alias("e")))
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans,
        zero,
        lambda a, x: F.struct(
            F.greatest(a["upto"], x["e"]).alias("upto"),
            (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["upto"], x["s"]))).alias("n"),
        ),
        lambda a: a["n"],
    )


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = 16 << 20,
    keep_text: bool = True,
) -> DataFrame:
    """Input columns plus n_words, n_hit, items (ids, sorted), hit_starts, hit_ends
    (spans of hit words; those of different blocks may overlap), longest (words of
    the longest verbatim match) and contaminated."""
    out = docs
    made = [f.name for f in _ADDED]
    nth = 0
    for block in item_blocks(items, item_id, item_text, block_bytes):
        more = tokens.add_columns(
            out.withColumnsRenamed({c: f"__{c}" for c in made} if nth else {}), _kernel(TestSet(block, window)), _ADDED, text_col, True
        )
        if nth:
            lists = {c: F.concat(f"__{c}", c) for c in ("hit_starts", "hit_ends", "items")}
            more = more.withColumns(lists | {"longest": F.greatest("__longest", "longest")}).drop(*[f"__{c}" for c in made])
            more = runtime.materialize(more, "decontaminate")
        out, nth = more, nth + 1
    if not keep_text:
        out = out.drop(text_col)
    return out.withColumns(
        {"items": F.array_sort(F.array_distinct("items")), "n_hit": _merged(F.col("hit_starts"), F.col("hit_ends"))}
    ).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any verbatim match, with their own columns."""
    ready, back = tokens.set_aside(docs, [f.name for f in _ADDED] + ["n_hit", "contaminated"])
    found = find_contamination(ready, items, **options)
    return found.where(~F.col("contaminated")).select(*ready.columns).withColumnsRenamed(back)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, items, keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)),
g AS (
  SELECT rid, p, n, array_to_string(ws[p:p + n - 1], ' ') AS k
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p
        FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
h AS (SELECT g.rid, g.p, g.n, w.item_id FROM g JOIN w ON g.n = w.n AND g.k = w.k),
c AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM h)) GROUP BY rid),
i AS (
  SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.rid = c.rid LEFT JOIN i ON d.rid = i.rid
"""
