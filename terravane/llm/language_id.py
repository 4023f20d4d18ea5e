r"""Language identification by prediction by partial matching over bytes.

For each language a context tree of order 3 counts which byte follows which one
to three bytes.  Its statistics are frozen: a byte seen after the longest known
context costs -log2 n / (N + D) bits there (N followers, D distinct ones); else an
escape of -log2 D / (N + D) is paid and the next shorter context decides, down to
a uniform byte.  A text belongs to the language that codes it in the fewest bits.

The trees of all languages are merged into tables by byte gram, so a text is
scored by table lookups on whole batches.  Texts are normalised first: A-Z
lower-cased, runs of other ASCII taken as one space.

Trees are fitted on a bounded sample: texts are taken in pieces of ``piece_chars``
characters, of which a hash of text and piece draws an expected ``sample_bytes`` per
language; equal texts count once.  Languages are held in models of ``block_languages`` each, applied one
after the other, so that the tables sent to the tasks have a bound however many
languages there are.

Defined results
* null text, no letter in it, or nothing learned: ``und`` with score 0.
* Equal code lengths: the language that sorts first.
* score is the posterior of the language under equal priors, 0 to 1.
* Repeated rows are judged row by row; empty table: empty result.
* Input columns named lang_pred, score or bits_per_byte are replaced; others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.llm import tokens

ORDER = 3
UNKNOWN = "und"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, positions to code, first of them for each text plus the end): each
    text follows three spaces, and runs of spaces are one."""
    folded = _FOLD[data]
    keep = folded != 32
    keep[1:] |= folded[:-1] != 32
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[starts] = folded[starts] != 32
    before = np.concatenate([[0], np.cumsum(keep)])[offsets]
    many = np.diff(before)
    at = np.arange(before[-1]) + np.repeat(ORDER * np.arange(1, len(many) + 1), many)
    out = np.full(int(before[-1]) + ORDER * len(many), 32, np.uint8)
    out[at] = folded[keep]
    return out, at, before


def grams(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The byte at each position with the three before it, as one number."""
    wide = text.astype(np.uint32)
    return wide[at - 3] << np.uint32(24) | wide[at - 2] << np.uint32(16) | wide[at - 1] << np.uint32(8) | wide[at]


class Model:
    """Merged context trees: cost rows (one column per language) by gram."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each language the distinct four-byte grams and their counts."""
        self.languages = languages
        n = len(languages)
        cost = np.full((256, n), 8.0)  # order -1
        escape = None
        for order in range(ORDER + 1):
            shift = np.uint32(8 * (ORDER - order))
            mask = np.uint32((1 << (8 * (order + 1))) - 1)
            tall = [self._sum(g & mask, c) for g, c in counts]
            keys = np.unique(np.concatenate([k for k, _ in tall])) if n else np.zeros(0, np.uint32)
            lower = self._lower(order, keys, cost, escape)
            value, contexts = lower.copy(), np.unique(keys >> np.uint32(8)) if order else np.zeros(1, np.uint32)
            esc = np.zeros((len(contexts), n))
            for i, (k, c) in enumerate(tall):
                of = np.searchsorted(contexts, k >> np.uint32(8)) if order else np.zeros(len(k), np.int64)
                total = np.bincount(of, c, len(contexts))
                kinds = np.bincount(of, minlength=len(contexts))
                seen = kinds > 0
                esc[seen, i] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                at = np.searchsorted(keys, k)
                mine = np.searchsorted(contexts, keys >> np.uint32(8)) if order else np.zeros(len(keys), np.int64)
                value[:, i] += esc[mine, i]
                value[at, i] = -np.log2(c / (total[of] + kinds[of]))
            if order == 0:
                full = np.full((256, n), 8.0) + esc[0]
                full[keys] = value
                cost, escape = full, None
                self.cost0 = full
            elif order == 1:
                dense, e = np.repeat(self.cost0[None], 256, 0).reshape(65536, n), np.zeros((256, n))
                e[contexts] = esc
                dense = dense + np.repeat(e, 256, 0)
                dense[keys] = value
                self.cost1 = dense.astype(np.float32)
                cost = dense
            elif order == 2:
                self.keys2, self.cost2 = keys, value.astype(np.float32)
                self.esc2 = np.zeros((65536, n), np.float32)
                self.esc2[contexts] = esc
                self._exact2 = value
            else:
                self.keys3, self.cost3 = keys, value.astype(np.float32)
                self.esc3 = np.zeros((len(self.keys2), n), np.float32)  # by the context as a gram of order 2
                at = np.searchsorted(self.keys2, contexts)
                at = np.minimum(at, max(0, len(self.keys2) - 1))
                known = self.keys2[at] == contexts if len(self.keys2) else np.zeros(len(contexts), bool)
                self.esc3[at[known]] = esc[known]
                self.esc3_far = (contexts[~known], esc[~known].astype(np.float32))

    @staticmethod
    def _sum(keys, counts):
        one, which = np.unique(keys, return_inverse=True)
        return one, np.bincount(which, counts, len(one)).astype(np.float64)

    def _lower(self, order, keys, cost, escape):
        """Cost of the grams' last byte by the next lower order."""
        if order == 0:
            return np.full((len(keys), len(self.languages)), 8.0)
        if order == 1:
            return cost[keys & np.uint32(255)]
        if order == 2:
            return cost[keys & np.uint32(65535)]
        short = keys & np.uint32((1 << 24) - 1)
        at = np.searchsorted(self.keys2, short)  # every shorter gram of a seen gram was seen
        return self._exact2[at]

    def prepare(self) -> None:
        """Lookup tables, built where the model is used."""
        if hasattr(self, "_dense"):
            return
        self._dense = np.full(1 << 24, -1, np.int32)
        self._dense[self.keys2] = np.arange(len(self.keys2), dtype=np.int32)
        bits = max(12, int(np.ceil(np.log2(max(1, 4 * len(self.keys3))))))
        self._bits, self._slot_key, self._slot_row = bits, np.zeros(1 << bits, np.uint32), np.full(1 << bits, -1, np.int32)
        left, self._probes = np.arange(len(self.keys3)), 0
        while len(left):
            slot = self._slot(self.keys3[left], self._probes)
            free = self._slot_row[slot] < 0
            taken, one = np.unique(slot[free], return_index=True)
            winners = left[free][one]
            self._slot_row[taken], self._slot_key[taken] = winners, self.keys3[winners]
            left = np.setdiff1d(left, winners, assume_unique=True)
            self._probes += 1

    def _slot(self, keys, probe):
        h = keys * np.uint32(2654435761)
        return ((h >> np.uint32(32 - self._bits)) + np.uint32(probe)) & np.uint32((1 << self._bits) - 1)

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte, one column per language."""
        row = np.full(len(keys), -1, np.int32)
        left = None
        for probe in range(self._probes):
            some = keys if left is None else keys[left]
            slot = self._slot(some, probe)
            at, hit = self._slot_row[slot], self._slot_key[slot] == some
            good = hit & (at >= 0)
            if left is None:
                row[good] = at[good]
                left = np.flatnonzero(~good & (at >= 0))
            else:
                row[left[good]] = at[good]
                left = left[~good & (at >= 0)]
            if not len(left):
                break
        out = self.cost3[np.maximum(row, 0)] if len(self.cost3) else np.zeros((len(keys), len(self.languages)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            out[miss] = self._fallback(keys[miss])
        return out

    def _fallback(self, keys):
        """Costs of grams of order 3 that no language has."""
        context = keys >> np.uint32(8)
        of = self._dense[context]
        value = np.where((of >= 0)[:, None], self.esc3[np.maximum(of, 0)], 0) if len(self.esc3) else np.zeros((len(keys), len(self.languages)), np.float32)
        if len(self.esc3_far[0]):
            at = np.minimum(np.searchsorted(self.esc3_far[0], context), len(self.esc3_far[0]) - 1)
            far = self.esc3_far[0][at] == context
            value[far] += self.esc3_far[1][at[far]]
        short = keys & np.uint32((1 << 24) - 1)
        row = self._dense[short]
        known = row >= 0
        value[known] += self.cost2[row[known]]
        pair = short[~known]
        value[~known] += self.esc2[pair >> np.uint32(8)] + self.cost1[pair & np.uint32(65535)]
        return value

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """Bits of each text under each language."""
        self.prepare()
        text, at, first = normalised(data, offsets)
        n, out = len(offsets) - 1, np.zeros((len(offsets) - 1, len(self.languages)))
        for a in range(0, len(at), most):
            b = min(len(at), a + most)
            cost = self.costs(grams(text, at[a:b]))
            i, j = int(np.searchsorted(first, a, "right")) - 1, int(np.searchsorted(first, b, "left"))
            begin = np.maximum(first[i:j], a) - a
            some = np.flatnonzero(np.diff(np.append(begin, b - a)) > 0)
            out[i + some] += np.add.reduceat(cost, begin[some], axis=0, dtype=np.float64)
        return out[:n]


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_bytes: int = 1 << 20,
    piece_chars: int = 1 << 14,
    block_languages: int = 16,
) -> list[Model]:
    """Trees from a bounded sample of labelled rows, ``block_languages`` to a model, in the
    order of the languages; see the module text.  A text teaches a language once, however
    many rows repeat it: pieces are drawn by the text alone."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key")
    )
    once = rows.groupBy("lang", "key").agg(F.max(F.octet_length("text")).alias("n"))
    sizes = {r["lang"]: r["n"] for r in once.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages, models = sorted(sizes), []
    for a in range(0, len(languages), block_languages):
        some = languages[a : a + block_languages]
        share = F.get(F.array(*[F.lit(min(1.0, sample_bytes / max(1, sizes[k]))) for k in some]), (F.array_position(F.array(*map(F.lit, some)), F.col("lang")) - 1).cast("int"))
        # the pieces are drawn before they are cut out
        pieces = rows.where(F.col("lang").isin(some)).withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"greatest(length(text) - 1, 0) div {piece_chars}"))))
        drawn = pieces.where(F.pmod(F.xxhash64("key", "piece"), F.lit(1 << 30)) < share * (1 << 30))
        cut = drawn.select("lang", "key", "piece", F.substring("text", F.col("piece") * piece_chars + 1, F.lit(piece_chars)).alias("text")).dropDuplicates(["lang", "key", "piece"]).collect()
        counts = []
        for k in some:
            text, at, _ = normalised(*tokens.text_bytes(pa.array([r["text"] for r in cut if r["lang"] == k], pa.large_string())))
            counts.append(np.unique(grams(text, at), return_counts=True))
        models.append(Model(some, counts))
    return models


def _kernel(model: Model, letter: str, before: str | None, names: list[str]):
    """Joins a model's languages to what the models before have found: the least bits, its
    language, and the sum of 2^(least - bits) over the languages."""

    def judge(data, offsets, rows):
        def of(name):
            return rows.column(rows.schema.get_field_index(name))

        has = np.asarray(of(letter).to_numpy(zero_copy_only=False), bool)
        bits = model.code_lengths(data, offsets)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(best)), best]
        total = np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
        lang = pa.array(model.languages, pa.string()).take(pa.array(best))
        if before:
            old, had = of(f"{before}low").to_numpy(), of(f"{before}sum").to_numpy()
            least = np.minimum(old, low)
            total = had * np.exp2(np.maximum(least - old, -1000)) + total * np.exp2(np.maximum(least - low, -1000))
            lang = pc.if_else(pa.array(low < old), lang, of(f"{before}lang"))
            low = least
        return dict(zip(names, (pa.array(np.where(has, low, 0.0)), lang, pa.array(total)), strict=True))

    return judge


def predict(docs: DataFrame, models: list[Model], text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Input columns plus lang_pred, score and bits_per_byte."""
    made = ["lang_pred", "score", "bits_per_byte"]
    kept = [c for c in docs.columns if c not in made and (keep_text or c != text_col)]
    ready = docs.drop(*made).withColumns({"__letter": F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)), "__bytes": F.octet_length(text_col)})
    before = None
    for nth, model in enumerate(models):
        names = [f"__{nth}{c}" for c in ("low", "lang", "sum")]
        added = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.DoubleType(), T.StringType(), T.DoubleType()), strict=True)])
        after = tokens.add_columns(ready, _kernel(model, "__letter", before, names), added, text_col, keep_text or nth + 1 < len(models), most=1 << 20)
        ready = after.drop(*[f"{before}{c}" for c in ("low", "lang", "sum")]) if before else after
        before = f"__{nth}"
    if before is None:
        return ready.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    known = F.col("__letter")
    return ready.select(
        *kept,
        F.when(known, F.col(f"{before}lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, 1 / F.col(f"{before}sum")).otherwise(0.0).alias("score"),
        F.when(known, F.col(f"{before}low") / F.greatest(F.lit(1), "__bytes")).otherwise(0.0).alias("bits_per_byte"),
    )


def remainder(id_col: str, of: int = 5) -> Column:
    """crc32 of the id as text, modulo ``of``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)), F.lit(-1))


def learn(docs: DataFrame) -> list[Model]:
    """The models of op5: documents outside the held-out fifth, with a language."""
    return fit(docs.where(remainder("doc_id") != 0))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), learn(docs), keep_text=False)
    return found.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "lang_pred", "score")
