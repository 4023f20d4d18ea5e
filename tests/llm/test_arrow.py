"""The operators built on Arrow batches, against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terravane.llm import decontaminate, elias_fano, language_id, lm_score, mixing, near_dedup, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- word kernels ----------------------------------------------------------------


def test_words_and_hashes(odd_texts):
    texts = [*odd_texts, "x" * 700 + " " + "x" * 700 + " y", "abcdefgh abcdefghi"]
    data, offsets = tokens.text_bytes(pa.array(texts, pa.large_string()))
    for table, pattern in ((tokens.NOT_SPACE, WORD), (tokens.ALNUM, ALNUM)):
        padded, starts, lengths, first = tokens.words(data, offsets, table)
        h = tokens.hashes(padded, starts, lengths)
        seen = {}
        for i, text in enumerate(texts):
            words = pattern.findall(lower(text))
            assert [padded[a : a + n].tobytes().decode() for a, n in zip(starts[first[i] : first[i + 1]], lengths[first[i] : first[i + 1]])] == words
            for w, x in zip(words, h[first[i] : first[i + 1]]):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_slices_cover_everything():
    offsets = np.array([0, 0, 5, 5, 30, 31, 31])
    for most in (1, 4, 10, 100):
        runs = list(tokens.slices(offsets, most))
        assert [i for a, b in runs for i in range(a, b)] == list(range(6))


# -- decontamination -------------------------------------------------------------


def contamination(text, items, window=10):
    words, hit, found = ALNUM.findall(lower(text)), set(), set()
    for name, body in items:
        w = ALNUM.findall(lower(body))
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, odd_texts, block_bytes):
    draw = random.Random(8)
    letters = "abcd"
    docs = [*odd_texts[:-1], *[" ".join(draw.choices(letters, k=draw.randint(0, 60))) for _ in range(60)], "Stop. ONE two", "q " * 40]
    items = [(1, "one"), (2, "One, two!"), (3, None), (4, "..."), (10, "q " * 12), (11, "q " * 12), (12, docs[30]), (13, "zz " + str(docs[12]))]
    items += [(20 + i, " ".join(draw.choices(letters, k=k))) for i, k in enumerate((3, 4, 10, 11, 30))]
    items += [(1, "two three")]
    rows = spark.createDataFrame(list(enumerate(docs)), "i int, text string").withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(rows, bench, block_bytes=block_bytes).collect()
    assert len(got) == len(docs)
    for r in got:
        want = contamination(docs[r.i], items)
        assert (r.n_words, r.n_hit, r["items"]) == want, docs[r.i]
        assert r.contaminated == (want[1] > 0)
        assert (r.longest > 0) == r.contaminated


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(40))
    doc = "x " + " ".join(f"w{i}" for i in range(5, 30)) + " y"
    got = decontaminate.find_contamination(spark.createDataFrame([(doc,)], "text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert got.longest == 25 and got.n_hit == 25 and list(zip(got.hit_starts, got.hit_ends)) == [(1, 26)]


def test_decontamination_empty(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.find_contamination(no_docs, bench).count() == 0
    assert decontaminate.decontaminate(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert decontaminate.decontaminate(odd_docs, bench).columns == odd_docs.columns


# -- near duplicates -------------------------------------------------------------


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(docs):
    sets, parent = [shingles(t) for _, t in docs], list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                parent[top(i)] = top(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[top(i)].append(k)
    return [(len(s), min(least[top(i)], default=None) if s else k) for i, (s, (k, _)) in enumerate(zip(sets, docs))]


def edited(draw, words, n):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("blocks", [{}, {"block_members": 7}, {"block_elements": 40}])
def test_near_duplicates(spark, odd_texts, blocks):
    draw = random.Random(4)
    base = [f"b{draw.randrange(300)}" for _ in range(150)]
    other = [f"c{draw.randrange(300)}" for _ in range(60)]
    texts = [*odd_texts, *[edited(draw, base, k % 6) for k in range(60)], *[edited(draw, other, k % 3) for k in range(20)]]
    # a chain: each links with the next, not with the first
    chain = [f"d{i}" for i in range(200)]
    for k in range(8):
        texts.append(" ".join(chain[: 200 - 12 * k]))
    docs = [(i * 7 % 500, t) for i, t in enumerate(texts)] + [(None, texts[30]), (None, "only null ids in this one group here"), (3, texts[40]), (3, texts[40])]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    got = near_dedup.near_duplicates(rows, **blocks)
    want = Counter((k, *g, k == g[1]) for (k, _), g in zip(docs, groups(docs)))
    assert Counter((r.id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == want


def test_loose_families_end_at_the_filter(spark):
    """Thousands of texts that share a template with one hub, and a few real links among them:
    the filter leaves these few only, whatever the number of the others."""
    shared = [f"t{i}" for i in range(120)]
    own = lambda k: [f"own{k}x{i}" for i in range(50)]
    for n in (400, 1600):
        sets = {k: {(w,) for w in shared + own(k)} for k in range(n)}
        sets |= {-k: {(w,) for w in shared + own(k)[:45] + [f"z{k}"]} for k in (1, 2, 3)}  # linked with k
        number = {w: i for i, w in enumerate(sorted({w for s in sets.values() for w in s}))}
        rows = []
        for k, s in sets.items():
            if k:
                d = sorted(number[w] for w in s ^ sets[0])
                rows.append((b"hub", str(k).encode(), str(k).encode(), len(s), len(sets[0]), 185 * len(d) <= 15 * (len(s) + len(sets[0])), d))
        here = spark.createDataFrame(rows, "hub binary, node binary, component binary, n long, n_hub long, linked boolean, apart array<long>")
        left = {int(r.node.decode()) for r in near_dedup._live(here, 15, 185).collect()}
        assert {1, 2, 3, -1, -2, -3} <= left and len(left) < 20


def test_near_copies_without_ids(spark):
    """A chain of near copies whose middle, or all, have no id."""
    chain = [f"m{i}" for i in range(200)]
    docs = [(None if 0 < k < 5 else 10 + k, " ".join(chain[: 200 - 12 * k])) for k in range(6)]
    docs += [(None, " ".join(f"o{i}" for i in range(100 - k))) for k in range(3)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    want = Counter((k, *g, k == g[1]) for (k, _), g in zip(docs, groups(docs)))
    assert Counter((r.id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == want
    assert {g for _, g in groups(docs)} == {10, None}


def test_deduplicate_keeps_columns(spark, odd_docs, no_docs):
    kept = near_dedup.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns and 0 < kept.count() < odd_docs.count()
    assert near_dedup.deduplicate(no_docs).count() == 0


def test_deduplicate_leaves_one(spark):
    """One row of each group stays, also of repeated ids, of repeated rows and without ids; all without words."""
    long = [" ".join(f"{c}{i}" for i in range(100)) for c in "abcd"]
    rows = [(1, long[0]), (1, long[0]), (1, long[0] + " end"), (2, long[0])]
    rows += [(None, long[1]), (None, long[1]), (None, long[1] + " end"), (None, long[2]), (7, long[3]), (8, ""), (8, ""), (None, None), (None, None)]
    kept = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    worded = Counter((r.doc_id, r.text[0]) for r in kept if r.text)
    assert worded == {(1, "a"): 1, (None, "b"): 1, (None, "c"): 1, (7, "d"): 1}
    assert Counter(r.doc_id for r in kept if not r.text) == {8: 2, None: 2}


def test_bands_find_links():
    """At similarity 0.85 a pair shares a bucket, and both halves of a signature agree with it."""
    draw, shared = np.random.default_rng(2), 0
    for _ in range(200):
        h = draw.integers(1, 1 << 63, 200, dtype=np.uint64)
        a, b = np.sort(h[:185]), np.sort(h[15:])
        keys = near_dedup.bands_of(np.concatenate([a, b]), np.array([0, 185, 370]), 6, 32)
        shared += bool((keys[0] == keys[1]).any())
    assert shared == 200


# -- mixing ----------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_index_permutation(n):
    p = mixing.IndexPermutation(n, 5, n)
    there = p.at(np.arange(n))
    assert sorted(there) == list(range(n)) and (p.where(there) == np.arange(n)).all()


def targets(sizes, weights, factor=1.5, passes=2):
    """The contract, source by source."""
    left, out = factor * sum(sizes), [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n > 0]
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > passes * sizes[i]]
        for i in over or free:
            out[i] = float(passes * sizes[i]) if over else left * weights[i] / total
        left -= sum(out[i] for i in over)
        free = [i for i in free if over and i not in over]
    return out


@pytest.mark.parametrize("sizes", [[100, 1000, 10, 0], [], [0], [5, 5, 5], [1, 10, 100, 1000, 10_000, 100_000, 7, 3]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(enumerate(sizes)), "source_no long, size long")
    got = {r.source_no: r.target for r in mixing.with_targets(rows, mixing.WEIGHTS, 1.5).collect()}
    want = targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))])
    assert [got[i] for i in range(len(sizes))] == pytest.approx(want, rel=1e-12)
    capped = mixing.with_targets(rows, mixing.WEIGHTS, 3.0).collect()
    assert all(r.target == pytest.approx(2 * r.size) for r in capped)


@pytest.mark.parametrize("scale", [1, 10**9])
def test_draws_of_shards(spark, scale):
    """The counts of single shards against the moments of a draw without replacement, one path at every size."""
    slots = [5000 * scale, 2000 * scale, 1000 * scale]
    total, size = sum(slots), 64
    pool, ends = mixing.IndexPermutation(total, 20240607), np.cumsum(slots)
    drawn = []
    for shard in np.random.default_rng(1).integers(0, total // size, 1500):
        who = np.searchsorted(ends, pool.where(shard * size + np.arange(size)), "right")
        drawn.append(np.bincount(who, minlength=3))
    drawn, share = np.array(drawn), np.array(slots) / total
    assert (drawn.sum(axis=1) == size).all()
    spread = size * share * (1 - share) * (total - size) / (total - 1)
    assert np.abs(drawn.mean(axis=0) - size * share).max() < 5 * np.sqrt(spread.max() / len(drawn))
    assert drawn.var(axis=0) == pytest.approx(spread, rel=0.2)


def test_slots(spark):
    """Every slot once, each source's blocks once a pass, and chunks that do not matter."""
    plans = [(0, 7, 12, 3, 0), (1, 1, 2, 16, 12), (2, 0, 0, 0, 14), (3, 40, 25, 5, 14)]
    rows = spark.createDataFrame(plans, "source_no long, blocks long, slots long, last long, first_slot long")
    made = [Counter(map(tuple, mixing.slots_frame(rows, 39, 16, 8, 1, chunk).collect())) for chunk in (5, 1 << 16)]
    assert made[0] == made[1] and max(made[0].values()) == 1
    slots = sorted(made[0])
    assert [r[1] for r in slots] == list(range(39)) and all(r[0] == r[1] // 8 for r in slots)
    for k, blocks, n, last, _ in plans:
        own = [r for r in slots if r[2] == k]
        assert len(own) == n and sum(r[4] for r in own) == max(0, 16 * (n - 1)) + last * (n > 0)
        assert max(Counter(r[3] for r in own).values(), default=0) <= -(-n // max(1, blocks))


def test_mix(spark, odd_docs, no_docs):
    clash = odd_docs.withColumn("size", F.lit("clash")).withColumn("target", F.lit("clash")).withColumn("source_size", F.lit("clash")).withColumn("first_word", F.lit("clash"))
    made = mixing.mix_sources(clash, block_words=16, shard_slots=8, bucket_rows=5)
    rows = made.taken().collect()
    assert sum(r.n for r in made.counts().collect()) == made.slots.count()
    total = {s: sum(len(WORD.findall(d.text or "")) for d in odd_docs.collect() if d.source == s) for s in ("s0", "s1", "ß", None)}
    assert {r.source: r.target for r in rows} == pytest.approx(dict(zip(total, targets(list(total.values()), [5, 2, 1, 5]))))
    assert len(rows) == odd_docs.count()
    by = defaultdict(list)
    for r in rows:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    for some in by.values():
        assert sum(r.size for r in some) == some[0].source_size
        assert abs(sum(r.taken for r in some) - some[0].target) <= 0.5
    again = mixing.mix_sources(odd_docs.repartition(3), block_words=16, shard_slots=8, bucket_rows=5, keep_text=False).taken()
    assert Counter((r.doc_id, r.size, r.taken) for r in again.collect()) == Counter((r.doc_id, r.size, r.taken) for r in rows)
    # the mix itself holds the words it says it takes
    pieces = made.mixed().collect()
    assert sum(r.words for r in pieces) == sum(r.taken for r in rows) == sum(len(r.text.split(" ")) for r in pieces)
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(WORD.findall(r.text or ""))
    for r in pieces:
        assert r.text.split(" ") in [t[r.from_word : r.from_word + r.words] for t in texts[r.doc_id]]
    assert mixing.mix_sources(no_docs).taken().count() == 0


# -- language identification -----------------------------------------------------


def folded(text):
    out = bytearray(b"   ")
    for c in text.encode():
        c = c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32
        if c != 32 or out[-1] != 32:
            out.append(c)
    return bytes(out)


def code_length(train, text):
    seen = [defaultdict(Counter) for _ in range(4)]
    for t in train:
        b = folded(t)
        for i in range(3, len(b)):
            for o in range(4):
                seen[o][b[i - o : i]][b[i]] += 1
    b, bits = folded(text), 0.0
    for i in range(3, len(b)):
        for o in (3, 2, 1, 0, -1):
            if o < 0:
                bits += 8
                break
            c = seen[o].get(b[i - o : i])
            if c:
                n, d = sum(c.values()), len(c)
                if b[i] in c:
                    bits -= math.log2(c[b[i]] / (n + d))
                    break
                bits -= math.log2(d / (n + d))
    return bits


def test_code_lengths_are_exact():
    train = {"a": ["hello wörld the cat", "The theme", ""], "b": ["der die das, die", "zu der 12"]}
    counts = []
    for texts in train.values():
        data, offsets = tokens.text_bytes(pa.array(texts, pa.large_string()))
        text, at, _ = language_id.normalised(data, offsets)
        counts.append(np.unique(language_id.grams(text, at), return_counts=True))
    model = language_id.Model(list(train), counts)
    tests = ["the der hello", "  ZÜ 99 the", "", "xyz ß", "die das hat the cat  wör", "\x00\x7f", "日本 the 日本"]
    data, offsets = tokens.text_bytes(pa.array(tests, pa.large_string()))
    for most in (1 << 20, 3):
        got = model.code_lengths(data, offsets, most)
        for i, t in enumerate(tests):
            assert got[i] == pytest.approx([code_length(x, t) for x in train.values()], abs=1e-3)


def test_language_of_odd_rows(spark, no_docs):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house of the man and the dog", "en"), ("das Haus und der Hund von dem Mann", "de")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- €"), (4, "the dog"), (4, "the dog"), (5, "der Hund"), (6, "Hund " * 50_000)], "i int, text string").withColumn("score", F.lit("x"))
    got = Counter((r.i, r.lang_pred) for r in language_id.predict(odd, model).collect())
    assert got == Counter({(1, "und"): 1, (2, "und"): 1, (3, "und"): 1, (4, "en"): 2, (5, "de"): 1, (6, "de"): 1})
    assert all(0 <= r.score <= 1 for r in language_id.predict(odd, model).collect())
    # many languages, in models of a few each
    split = language_id.predict(odd, language_id.fit(docs, block_languages=1)).collect()
    whole = {(r.i, r.lang_pred): r.score for r in language_id.predict(odd, model).collect()}
    assert {(r.i, r.lang_pred) for r in split} == set(whole) and all(r.score == pytest.approx(whole[r.i, r.lang_pred]) for r in split)
    nothing = language_id.fit(no_docs)
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.predict(no_docs, model).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = language_id.op5_language_id(spark, sf_dir).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


# -- language model --------------------------------------------------------------


def test_elias_fano():
    draw = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (5, 100), (1000, 1 << 64), (5000, 6000), (3000, 10**9)):
        v = np.sort(draw.integers(0, u, n, dtype=np.uint64, endpoint=False)) if n else np.zeros(0, np.uint64)
        e = elias_fano.EliasFano(*elias_fano.EliasFano.arrays(v, u))
        if n:
            assert (e.get(np.arange(n)) == v).all() and (v[e.find(v)] == v).all()
        q, known = draw.integers(0, u, 500, dtype=np.uint64), set(v.tolist())
        assert [int(x) in known for x in q] == [bool(y >= 0) for y in e.find(q)]


def test_trie_answers():
    words, counts = np.array([5, 9, 1 << 63], np.uint64), np.array([4, 2, 1])
    first, second, n = np.array([0, 0, 2]), np.array([5, 1 << 47, 9], np.uint64), np.array([3, 1, 100_000])
    kept = elias_fano.mapped(elias_fano.stored(elias_fano.Trie.arrays(words, counts, first, second, n)))
    t = elias_fano.Trie(kept)
    at, total, begin, end = t.lookup(np.array([5, 9, 1 << 63, 7], np.uint64))
    assert at.tolist() == [0, 1, 2, -1] and total.tolist() == [4, 2, 1, 0] and (end - begin).tolist() == [2, 0, 1, 0]
    ask = np.array([0, 0, 0, 1, 2, 3])
    codes = t.codes_of(at[ask], begin[ask], end[ask], np.array([5, 1 << 47, 9, 5, 9, 5], np.uint64))
    assert (codes > 0).tolist() == [True, True, False, False, True, False]
    assert elias_fano.RESTORED[codes[[0, 1]]].tolist() == [3, 1] and elias_fano.RESTORED[codes[4]] == pytest.approx(100_000, rel=0.09)


def test_quantised_counts():
    n = np.array([0, 1, 2, 62, 63, 64, 70, 1000, 10**9, 10**15])
    back = elias_fano.RESTORED[elias_fano.quantised(n)]
    assert back[:5].tolist() == n[:5].tolist() and np.abs(np.log(back[5:] / n[5:])).max() <= elias_fano._STEP / 2 + 1e-9


def test_messages_grow_with_the_text():
    """Words and pairs are sent once a batch, whatever the number of shards; hot contexts are cut and stay whole."""
    draw = random.Random(1)
    text = " ".join(draw.choice(["the", f"w{draw.randrange(3000)}"]) for _ in range(60_000))
    batch = lm_score.Batch(*tokens.text_bytes(pa.array([text], pa.large_string())))
    the = lm_score.token_stream(*tokens.text_bytes(pa.array(["the"], pa.large_string())))[0][:1]
    for shards, splits in ((1, 1), (7, 4), (5000, 900)):
        routes = lm_score.Routes(shards, the, np.array([splits]))
        rows = list(batch.asked(routes))
        assert sorted(x for _, w, own, _ in rows for x in w[own]) == list(range(len(batch.words)))
        assert sorted(x for *_, p in rows for x in p) == list(range(len(batch.second)))
        assert all(np.isin(batch.context[p], w).all() for _, w, _, p in rows)
        assert sum(len(w) for _, w, *_ in rows) <= len(batch.words) + splits


@pytest.mark.parametrize("batch_bytes", [16 << 20, 3000])
def test_scores(spark, odd_docs, batch_bytes):
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    docs = odd_docs.select("doc_id", "text", F.lit("clash").alias("score"))
    got = lm_score.score_texts(docs, ~held, batch_bytes=batch_bytes)
    rows = odd_docs.collect()
    out = [(WORD.findall(lower(r.text)) + [None], zlib.crc32(str(r.doc_id).encode()) % 5 != 1 or r.doc_id is None) for r in rows]
    single, pairs, after, total = Counter(), Counter(), defaultdict(set), Counter()
    for t, train in out:
        if train:
            single.update(t)
            for a, b in zip(["", *t], t):
                pairs[a, b] += 1
                total[a] += 1
                after[a].add(b)
    n, v = sum(single.values()), len(single)
    want = defaultdict(list)
    for r, (t, _) in zip(rows, out):
        base = score = 0.0
        for a, b in zip(["", *t], t):
            p = (single[b] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            if total[a]:
                p = max(pairs[a, b] - 0.75, 0) / total[a] + 0.75 * len(after[a]) / total[a] * p
            score += math.log10(min(1, p))
        want[r.doc_id].append((len(t), sum(single[x] > 0 for x in t), n, base, score))
    have = defaultdict(list)
    for r in got.collect():
        have[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert have.keys() == want.keys()
    for k in want:
        for x, y in zip(sorted(have[k]), sorted(want[k]), strict=True):
            assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], rel=1e-9)
            assert abs(x[4] - y[4]) <= 0.02 * y[0]


def test_scores_of_empty_and_untrained(spark, odd_docs, no_docs):
    assert lm_score.score_texts(no_docs.select("doc_id", "text"), F.lit(True)).count() == 0
    got = lm_score.score_texts(odd_docs.select("doc_id", "text"), F.lit(False)).collect()
    assert len(got) == odd_docs.count() and all(r.score == 0 and r.train_tokens == 0 for r in got)
