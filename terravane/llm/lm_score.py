r"""Language-model scores from stored Elias-Fano n-gram tries.

The model is an interpolated bigram model with absolute discounting over all
training documents:

    P(w | c) = max(n(c w) - D, 0) / n(c) + D * t(c) / n(c) * P(w)
    P(w)     = (n(w) + 0.5) / (N + 0.5 * (V + 1))

with t(c) the distinct words after c; a context never seen gives P(w).  A text's
tokens are its words (A-Z lower-cased, runs of ``[^\x20\x09-\x0D]``) and one end;
the first token's context is a start mark.  Words are 64-bit hashes; as successors
they keep the upper 48 bits, on which two successors of one context agree with
probability 4e-15.

``fit`` counts each task's distinct words and pairs some megabytes of text at a time,
sends them to the shard that owns the context's hash, adds them up there and writes
one trie a shard: Elias-Fano levels with 8-bit counts.  ``Model.score`` deals the
documents into batches by a hash of the row; a batch asks each shard once for its
distinct words and pairs there, the shards answer from their tries, and the batch
scores its documents.  A word is sent to one shard and a pair to one shard, so what
is shuffled grows in proportion to the text, whatever the number of batches.

A context that is frequent in a bounded sample has its successors dealt over as many
shards as its share asks for (``Routes``).  That list only routes, and counts stay
exact; its words' t(c) are added up over the shards.

Defined results
* null or empty text: the end is its only token.
* Repeated rows and ids: documents of their own, each counted.
* No training documents: N = V = 0 and P(w) = 1.  Empty table: empty result.
* Input columns named like an output column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import tokens
from terravane.llm.elias_fano import RESTORED, Trie, mapped, stored
from terravane.plans import runtime

START, END = np.uint64(2), np.uint64(3)
DISCOUNT = 0.75
_SPLIT = np.uint64(0x9E3779B97F4A7C15)


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first token of each text plus the end)."""
    padded, starts, lengths, first = tokens.words(data, offsets, tokens.NOT_SPACE)
    h = tokens.hashes(padded, starts, lengths)
    n = np.diff(first)
    at = first + np.arange(len(first))
    token = np.full(int(at[-1]), END, np.uint64)
    token[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return token, at


@dataclass(frozen=True)
class Routes:
    """Where words and pairs go.  ``hot``: ascending contexts whose successors are dealt
    over ``splits`` parts each."""

    shards: int
    hot: np.ndarray
    splits: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        """Shards of hashes, ascending with them."""
        return ((h >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        return np.isin(words, self.hot)

    def of_parts(self, context: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Shards of pairs with hot contexts."""
        parts = self.splits[np.searchsorted(self.hot, context)].astype(np.uint64)
        part = (tokens.mix(second) >> np.uint64(32)) * parts >> np.uint64(32)
        return self.of(tokens.mix(context + (part + np.uint64(1)) * _SPLIT))


class Batch:
    """The distinct words and (context, word) pairs of some texts, both ascending."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        token, self.first = token_stream(data, offsets)
        code, names = pd.factorize(np.append(token, START))
        del token
        order = np.argsort(names)
        self.words = names[order]
        place = np.empty(len(order), np.int32)  # a batch has fewer tokens than that
        place[order] = np.arange(len(order), dtype=np.int32)
        self.token, self.start = place[code[:-1]], int(place[code[-1]])
        del code
        key = np.empty(len(self.token), np.int64)
        key[1:] = self.token[:-1]
        key[self.first[:-1]] = self.start
        key *= len(self.words)
        key += self.token
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.pair = np.empty(len(key), np.int32)
        self.pair[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del order
        key = key[new]
        self.context, self.second = key // len(self.words), key % len(self.words)

    def asked(self, routes: Routes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(shard, places of words, which of them it owns, places of pairs) for each shard
        that owns some; contexts of its pairs are among the words."""
        own = routes.of(self.words)  # ascending
        hot = routes.is_hot(self.words)
        pair = own[self.context]
        cut = np.flatnonzero(hot[self.context])
        pair[cut] = routes.of_parts(self.words[self.context[cut]], self.words[self.second[cut]])
        order = np.argsort(pair, kind="stable")
        dealt = pair[order]
        for s in np.union1d(own, dealt):
            p = order[np.searchsorted(dealt, s) : np.searchsorted(dealt, s, "right")]
            w = np.arange(np.searchsorted(own, s), np.searchsorted(own, s, "right"))
            foreign = self.context[p]
            foreign = foreign[own[foreign] != s]
            if len(foreign):
                w = np.union1d(w, foreign)
            yield int(s), w, own[w] == s, p

    def after(self, w: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How many of the pairs p have each of the words w as context."""
        return np.bincount(np.searchsorted(w, self.context[p]), minlength=len(w)).astype(np.uint32)


def _packed(words: np.ndarray) -> np.ndarray:
    """The upper six bytes of each hash: how successors are sent and stored."""
    return words.view(np.uint8).reshape(-1, 8)[:, 2:].reshape(-1)


def _unpacked(raw: np.ndarray) -> np.ndarray:
    """48-bit numbers in the order of their hashes."""
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _joined(arrays: list[np.ndarray]) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _cut(raw: pa.Scalar, kinds: list[type]) -> list[np.ndarray]:
    buffer = raw.as_buffer()
    sizes, out, at = np.frombuffer(buffer, np.int64, len(kinds)), [], 8 * len(kinds)
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(buffer, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


_COUNTED = [np.uint64, np.uint32, np.uint32, np.uint8, np.uint32]  # words, their counts and successors; successors, their counts
_ASKED = [np.uint64, np.uint32, np.uint8]  # words, their successors; successors
_REPLY = [np.int64, np.uint32, np.uint8]  # own words' counts and distinct successors; pairs' codes


def _count(routes: Routes, batch_bytes: int):
    """Kernel of fit: texts to (shard, counts), about ``batch_bytes`` at a time."""

    def counted(parts: list[pa.Array]) -> pa.RecordBatch:
        batch = Batch(*tokens.text_bytes(pa.chunked_array(parts).combine_chunks()))
        word_n = np.bincount(batch.token, minlength=len(batch.words)).astype(np.uint32)
        pair_n = np.bincount(batch.pair, minlength=len(batch.second)).astype(np.uint32)
        word_n[batch.start] = len(batch.first) - 1
        shard, value = [], []
        for s, w, own, p in batch.asked(routes):
            shard.append(s)
            value.append(_joined([batch.words[w], np.where(own, word_n[w], 0).astype(np.uint32), batch.after(w, p), _packed(batch.words[batch.second[p]]), pair_n[p]]))
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(value, pa.binary())], names=["shard", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            column = batch.column(0).cast(pa.large_string())
            if parts and size + column.nbytes > batch_bytes:
                yield counted(parts)
                parts, size = [], 0
            parts.append(column)
            size += column.nbytes
        if parts:
            yield counted(parts)

    return run


def _build(routes: Routes):
    """Kernel of fit: the counts of one shard, added up, as a stored trie."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        counts = [_cut(x, _COUNTED) for x in table.column("counts").combine_chunks()]
        words, code = np.unique(np.concatenate([a[0] for a in counts]), return_inverse=True)
        count = np.bincount(code, np.concatenate([a[1] for a in counts]), len(words)).astype(np.int64)
        x = np.repeat(code, np.concatenate([a[2] for a in counts]))
        y = _unpacked(np.concatenate([a[3] for a in counts]))
        n = np.concatenate([a[4] for a in counts]).astype(np.int64)
        order = np.lexsort((y, x))
        x, y, n = x[order], y[order], n[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        starts = np.flatnonzero(new)
        n = np.add.reduceat(n, starts) if len(starts) else n
        x, y = x[starts], y[starts]
        mine = (words != START) & (routes.of(words) == shard)
        hot = np.flatnonzero(routes.is_hot(words))
        kinds = np.bincount(x, minlength=len(words))[hot]
        parts = [{"word": int(w), "kinds": int(k)} for w, k in zip(words[hot].view(np.int64), kinds, strict=True) if k]
        return pa.table(
            {
                "shard": pa.array([shard], pa.int64()),
                "trie": pa.array([stored(Trie.arrays(words, count, x, y, n))], pa.binary()),
                "n": pa.array([int(count[mine].sum())], pa.int64()),
                "v": pa.array([int(mine.sum())], pa.int64()),
                "hot": pa.array([parts], pa.list_(pa.struct([("word", pa.int64()), ("kinds", pa.int64())]))),
            }
        )

    return run


def _text(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tokens.text_bytes(table.column("text").combine_chunks())


def _ask(routes: Routes):
    def run(table: pa.Table) -> pa.Table:
        number = table.column("batch")[0].as_py()
        batch = Batch(*_text(table))
        shard, value = [], []
        for s, w, _, p in batch.asked(routes):
            shard.append(s)
            value.append(_joined([batch.words[w], batch.after(w, p), _packed(batch.words[batch.second[p]])]))
        return pa.table({"batch": pa.array([number] * len(shard), pa.int64()), "shard": pa.array(shard, pa.int64()), "ask": pa.array(value, pa.binary())})

    return run


def _reply(routes: Routes, kinds: np.ndarray):
    """Kernel of score: a shard's answers; ``kinds`` are the distinct successors of the hot words."""

    def run(asks: pa.Table, tries: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return None
        shard = asks.column("shard")[0].as_py()
        none = np.zeros(0, np.uint64)
        trie = Trie(mapped(tries.column("trie")[0].as_buffer())) if tries.num_rows else Trie(Trie.arrays(none, none, none, none, none))
        replies = []
        for raw in asks.column("ask").combine_chunks():
            words, after, second = _cut(raw, _ASKED)
            where, total, begin, end = trie.lookup(words)
            codes = trie.codes_of(np.repeat(where, after), np.repeat(begin, after), np.repeat(end, after), _unpacked(second))
            own = routes.of(words) == shard
            have = (end - begin).astype(np.uint32)
            hot = np.flatnonzero(routes.is_hot(words))
            have[hot] = kinds[np.searchsorted(routes.hot, words[hot])]
            replies.append(_joined([total[own], have[own], codes]))
        return pa.table({"batch": asks.column("batch"), "shard": asks.column("shard"), "reply": pa.array(replies, pa.binary())})

    return run


def _score(routes: Routes, n: int, v: int, discount: float, kept: list[str]):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return None
        batch = Batch(*_text(texts))
        replies = {s: _cut(r, _REPLY) for s, r in zip(answers.column("shard").to_pylist(), answers.column("reply").combine_chunks(), strict=True)}
        count = np.zeros(len(batch.words), np.int64)
        kinds = np.zeros(len(batch.words), np.int64)
        code = np.zeros(len(batch.second), np.uint8)
        for s, w, own, p in batch.asked(routes):
            count[w[own]], kinds[w[own]], code[p] = replies[s]
        p_word = (count + 0.5) / (n + 0.5 * (v + 1)) if n else np.ones(len(count))
        total = np.maximum(count, 1)
        rest = np.where(kinds > 0, discount * kinds / total, 1.0)
        p_pair = np.maximum(RESTORED[code] - discount, 0.0) / total[batch.context] + rest[batch.context] * p_word[batch.second]
        # every text has a token, so each sum is over its own range
        score = np.add.reduceat(np.log10(np.minimum(p_pair, 1.0))[batch.pair], batch.first[:-1])
        base = np.add.reduceat(np.log10(p_word)[batch.token], batch.first[:-1])
        known = tokens.per_text(batch.first, (count > 0)[batch.token])
        out = {c: texts.column(c) for c in kept}
        return pa.table(
            out
            | {
                "n_tokens": pa.array(np.diff(batch.first), pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array(np.full(texts.num_rows, n), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    return run


def hot_contexts(texts: DataFrame, total: int, shards: int, sample_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(words with over a quarter of a shard's share of a bounded sample, ascending; into
    how many parts the successors of each are cut)."""
    share = max(1, round((1 << 30) * min(1.0, sample_bytes / max(1, total))))
    some = texts.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < share).collect()
    token, _ = token_stream(*tokens.text_bytes(pa.array([r["text"] for r in some], pa.large_string())))
    names, n = np.unique(np.append(token, np.full(len(some), START)), return_counts=True)
    parts = n * 4 * shards // max(1, len(token))
    return names[parts > 0], np.minimum(parts[parts > 0], shards)


MADE = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


@dataclass(frozen=True)
class Model:
    """tries: shard, trie; the counts of all training tokens and of distinct ones."""

    tries: DataFrame
    routes: Routes
    kinds: np.ndarray
    n: int
    v: int
    discount: float

    def score(self, docs: DataFrame, text_col: str = "text", batch_bytes: int = 16 << 20) -> DataFrame:
        """Input columns (without the text) plus n_tokens, n_known, train_tokens, base_score and score."""
        kept = [c for c in docs.columns if c not in (*MADE, text_col)]
        total = int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
        hashed = F.xxhash64(*[c for c in docs.columns if docs.schema[c].dataType.typeName() != "map"])
        batch = F.pmod(hashed, F.lit(runtime.parts_for(total, batch_bytes)))
        rows = docs.select(*kept, F.col(text_col).alias("text"), batch.alias("batch"))
        asks = rows.select("batch", "text").groupBy("batch").applyInArrow(_ask(self.routes), "batch long, shard long, ask binary")
        replies = asks.groupBy("shard").cogroup(self.tries.groupBy("shard")).applyInArrow(_reply(self.routes, self.kinds), "batch long, shard long, reply binary")
        replies = runtime.materialize(replies, "lm-replies")
        types = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
        schema = ", ".join([*types, "n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double"])
        return rows.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_score(self.routes, self.n, self.v, self.discount, kept), schema)


def fit(docs: DataFrame, text_col: str = "text", discount: float = DISCOUNT, batch_bytes: int = 16 << 20, sample_bytes: int = 2 << 20) -> Model:
    """Count all of ``docs`` and store the tries."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    shards = runtime.parts_for(2 * total, batch_bytes)
    routes = Routes(shards, *hot_contexts(texts, total, shards, sample_bytes))
    tokens.bound_batches(docs.sparkSession)
    counted = texts.mapInArrow(_count(routes, batch_bytes), "shard long, counts binary")
    made = counted.groupBy("shard").applyInArrow(_build(routes), "shard long, trie binary, n long, v long, hot array<struct<word: long, kinds: long>>")
    tries = runtime.materialize(made, "lm-tries")
    whole = tries.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    kinds = np.zeros(len(routes.hot), np.int64)  # one row for each hot word, of which the sample sets the bound
    for row in tries.select(F.inline("hot")).groupBy("word").agg(F.sum("kinds").alias("kinds")).collect():
        kinds[np.searchsorted(routes.hot, np.int64(row["word"]).astype(np.uint64))] = row["kinds"]
    return Model(tries.select("shard", "trie"), routes, kinds, int(whole["n"] or 0), int(whole["v"] or 0), discount)


def score_texts(docs: DataFrame, train: Column, text_col: str = "text", batch_bytes: int = 16 << 20, **options) -> DataFrame:
    """The scores of ``docs`` under the model of the rows where ``train`` holds (null counts as true)."""
    model = fit(docs.where(F.coalesce(train, F.lit(True))), text_col, batch_bytes=batch_bytes, **options)
    return model.score(docs, text_col, batch_bytes)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    scored = score_texts(docs.withColumn("held_out", held), ~F.col("held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
