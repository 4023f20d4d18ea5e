r"""BPE encoding and decoding by a trie of words whose prefixes are encoded once.

The tokenizer's file gives a vocabulary of byte strings (with or without a word-end
mark), ranked merges and added tokens.  The encoding of a prefix is that of a shorter
prefix plus one token, so a trie node needs to hold only the *last token* of its
prefix's encoding.  At a new node the token is found among the vocabulary's strings
that end there: it is the one that encodes as itself and that stays apart from the
last token of the prefix before it.  Whether two tokens stay apart is decided by the
merges at the edges of those two alone.  Distinct words of a batch are inserted
into the trie, a depth-first walk gives every new node its state, and a word's tokens
are read back from its end, so a prefix that many words share is worked out once.

Words run into their end mark in their last byte, which is a branch of its own.  Words
beyond ``LONGEST`` bytes take the same steps along themselves and are not inserted.
The trie and the words read from it are kept by a worker from task to task and begun anew
beyond ``most`` words, so memory is bounded whatever the vocabulary of the corpus.  The
texts never leave their task: no shuffle.

Normalising (NFC, white space, lower case) and cutting into words follow the file.
Where all characters of a text are in ``COMMON`` (Latin letters and general
punctuation, for which the tests compare every character), Python's functions do it;
for other texts the tokenizers library's normaliser and pre-tokenizer, whose Unicode
tables may differ from Python's.  Merging and decoding are always done here.

Defined results
* null or empty text, or one of white space only: no tokens; digests of the empty text.
* Strings of added tokens inside texts are these tokens, as the library does by default.
* Repeated rows and ids: each row for itself.  Empty table: empty result.
* Input columns named like an output column (``MADE``) are replaced by it; other
  columns pass through.
* Decoding joins the tokens' strings by one space (the file names no decoder).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from terravane.llm import tokens

MADE = ["n_tokens", "ids_sha256", "decoded_sha256"]
#: Longest word, in bytes, that is inserted into the trie.
LONGEST = 128
#: Characters (as a regex class) that Python and the library treat alike, and whose lower
#: cases are among them (or need no class).
COMMON = r"\x00-\x1b\x20-ſ‐-‧‰-⁞€"
_END = 256
_ROOT = -1
_NEVER = 1 << 60
_NO_MERGE = (_NEVER, -1)


def _bytes_of_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: a
    printable Latin-1 character for itself, the other bytes in order from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """A tokenizer file of the word-end kind: strings as tuples of symbols, a symbol being
    a byte, or ``_END`` plus a byte at the end of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        suffix = model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or not suffix or model["dropout"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError("only BPE files with an end-of-word suffix are read")
        byte = self.byte = _bytes_of_symbols()
        self.names = {i: name for name, i in model["vocab"].items()} | {a["id"]: a["content"] for a in whole["added_tokens"]}
        self.added = {a["content"]: a["id"] for a in whole["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in whole["added_tokens"]):
            raise ValueError("added tokens that strip or are normalised are not read")
        self.symbols: dict[int, tuple[int, ...]] = {}
        for name, i in model["vocab"].items():
            body = name[: -len(suffix)] if name.endswith(suffix) and len(name) > len(suffix) else name
            if all(c in byte for c in body):
                at = tuple(byte[c] for c in body)
                self.symbols[i] = at[:-1] + (_END + at[-1],) if body != name else at
        self.single = {s[0]: i for i, s in self.symbols.items() if len(s) == 1}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = model["vocab"]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        # the tokens a token's right or left edge is made of, from the whole inwards, each with
        # the rank of the merge that ends it
        self.right, self.left = ({i: self._edge(i, halves, side) for i in self.symbols} for halves in [{made: (rank, *pair) for pair, (rank, made) in self.merges.items()}] for side in (2, 1))
        own = [i for i, s in self.symbols.items() if self.merged(s) == [i]]
        self.inner = {bytes(self.symbols[i]): i for i in own if self.symbols[i][-1] < _END}
        self.ends = {bytes([*self.symbols[i][:-1], self.symbols[i][-1] - _END]): i for i in own if self.symbols[i][-1] >= _END}
        self.size = {i: len(self.symbols[i]) for i in own}
        self.longest = max(self.size.values())
        split = next(p["pattern"]["Regex"] for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the added strings cut a text before anything else, the longest first
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.rare = re.compile(f"[^{COMMON}]")
        # the same words by explicit classes of the common characters, for Python's faster engine
        common = [c for c in map(chr, range(0x2100)) if not self.rare.match(c)]
        classes = {k: "".join(re.escape(c) for c in common if unicodedata.category(c)[0] == k) for k in "LN"}
        self.common_words = re.compile(re.sub(r"\\p\{([LN])\}", lambda m: classes[m[1]], split))
        self.path, self._library = path, None

    @staticmethod
    def _edge(token: int, halves: dict[int, tuple[int, int, int]], side: int) -> list[tuple[int, int]]:
        out, ends = [], _NEVER
        while token is not None:
            out.append((token, ends))
            ends, token = (halves[token][0], halves[token][side]) if token in halves else (0, None)
        return out

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges leave two adjacent tokens as they are: no merge joins parts at
        their edges before these go into larger parts of their own.  Of two equal merges
        that overlap the left one comes first."""
        for x, ends_x in self.right[a]:
            for y, ends_y in self.left[b]:
                rank = self.merges.get((x, y), _NO_MERGE)[0]
                if rank < ends_x and rank <= ends_y and rank < _NEVER:
                    return False
        return True

    def merged(self, symbols: tuple[int, ...]) -> list[int]:
        """Tokens of a run of symbols by the merges themselves: the least rank first, and
        the leftmost of that rank."""
        now = [self.single[s] for s in symbols]
        while len(now) > 1:
            rank, k = min((self.merges.get(p, _NO_MERGE)[0], k) for k, p in enumerate(zip(now, now[1:], strict=False)))
            if rank == _NEVER:
                break
            now[k : k + 2] = [self.merges[now[k], now[k + 1]][1]]
        return now

    def pieces(self, text: str) -> list[str]:
        """The words of a text without added tokens, normalised."""
        if not self.rare.search(text):
            return self.common_words.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library_pieces(text)

    def _library_pieces(self, text: str) -> list[str]:
        byte = self.byte
        cut = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(byte[c] for c in piece).decode("utf-8") for piece, _ in cut]


class Encoder:
    """Words to tokens through one trie: ``child`` leads from a node and a symbol to a node,
    ``state`` holds a node's last token."""

    def __init__(self, path: str, most: int = 3 << 18):
        self.v, self.most = Vocabulary(path), most
        self.begin()

    def begin(self) -> None:
        self.child: dict[int, int] = {}
        self.state = [_ROOT]
        self.known: dict[str, tuple[int, ...]] = {}

    def last(self, word: bytes, n: int, states: list[int], table: dict[bytes, int]) -> int:
        """The last token of the encoding of a word's first n bytes, from the states of the
        prefixes before."""
        for at in range(max(0, n - self.v.longest), n):
            token = table.get(word[at:n])
            if token is not None and (at == 0 or self.v.apart(states[at], token)):
                return token
        raise ValueError(f"no token ends {word[:n]!r}")

    def spelled(self, states: list[int], end: int) -> tuple[int, ...]:
        """Tokens of a word from its last one back; ``states`` of all prefixes but the whole."""
        out, at = [end], len(states) - self.v.size[end]
        while at > 0:
            out.append(states[at])
            at -= self.v.size[states[at]]
        return tuple(out[::-1])

    def learn(self, fresh: set[str]) -> dict[str, tuple[int, ...]]:
        """Words not met before, encoded in one depth-first walk of the trie (the order of
        sorted words); those too long to keep are returned."""
        once, before = {}, b""
        nodes, states = [0], [_ROOT]
        for raw, word in sorted((w.encode("utf-8"), w) for w in fresh):
            if len(raw) > LONGEST:
                alone = [_ROOT]
                for n in range(1, len(raw)):
                    alone.append(self.last(raw, n, alone, self.v.inner))
                once[word] = self.spelled(alone, self.last(raw, len(raw), alone, self.v.ends))
                continue
            same = 0
            while same < len(nodes) - 1 and same < len(raw) - 1 and raw[same] == before[same]:
                same += 1
            del nodes[same + 1 :], states[same + 1 :]
            for n in range(same + 1, len(raw)):
                key = nodes[-1] << 8 | raw[n - 1]
                node = self.child.get(key)
                if node is None:
                    node = self.child[key] = len(self.state)
                    self.state.append(self.last(raw, n, states, self.v.inner))
                nodes.append(node)
                states.append(self.state[node])
            before = raw
            self.known[word] = self.spelled(states, self.last(raw, len(raw), states, self.v.ends))
        return once

    def encode(self, text: str) -> list[int]:
        v = self.v
        parts = v.cut.split(text) if v.cut and "<" in text else [text]
        words = [p if k % 2 else v.pieces(p) for k, p in enumerate(parts)]
        fresh = {w for ws in words[::2] for w in ws if w not in self.known}
        if len(self.known) + len(fresh) > self.most:
            self.begin()
            fresh = {w for ws in words[::2] for w in ws}
        once = self.learn(fresh) if fresh else {}
        known = {**self.known, **once}.__getitem__ if once else self.known.__getitem__
        out: list[int] = []
        for k, ws in enumerate(words):
            if k % 2:
                out.append(v.added[ws])
            else:
                out += chain.from_iterable(map(known, ws))
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, joined by one space."""
        return " ".join(map(self.v.names.__getitem__, ids))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ``ids``."""
    tokens.bound_batches(docs.sparkSession)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    added += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids
    made = [f.name for f in added]
    kept = [c for c in docs.columns if c not in made]
    schema = T.StructType([docs.schema[c] for c in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        shown = {i: str(i) for i in own.v.names}
        for batch in batches:
            n, digests, decoded, lists = [], [], [], []
            for text in batch.column(batch.schema.get_field_index("__text")):
                ids = own.encode(text.as_py() or "")
                n.append(len(ids))
                digests.append(hashlib.sha256(" ".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest())
                if keep_ids:
                    lists.append(ids)
            arrays = [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            arrays += [pa.array(lists, pa.list_(pa.int32()))] * keep_ids
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + arrays, names=[*kept, *made])

    return docs.select(*[f"`{c}`" for c in kept], docs[f"`{text_col}`"].cast("string").alias("__text")).mapInArrow(run, schema)


def decode(tokenized: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``tokenized`` with ``decoded``, the text of its ids (null: empty)."""
    schema = T.StructType([*(f for f in tokenized.schema if f.name != "decoded"), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            texts = pa.array([own.decode(ids.as_py() or []) for ids in batch.column(at)], pa.string())
            kept = [k for k, c in enumerate(batch.schema.names) if c != "decoded"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), texts], names=schema.names)

    return tokenized.mapInArrow(run, schema)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers keep a file (the same place on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, vocabulary_path(), keep_ids=False).select("doc_id", *MADE)
