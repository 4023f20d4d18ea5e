"""Elias-Fano sequences and a two-level n-gram trie over one memory map.

A non-decreasing sequence of n values below u keeps the low ``log2(u / n)`` bits of
each value packed, and the rest as a bit vector: value i sets bit ``high + i``.  The
k-th zero of that vector bounds the values with high part k, so a search reads one
short run of low bits.  All lookups work on whole arrays of queries.
"""

from __future__ import annotations

import mmap

import numpy as np

_U = np.uint64
_SELECT = np.full((256, 8), 8, np.uint8)  # place of the k-th set bit of a byte
for _byte in range(256):
    for _k, _place in enumerate(p for p in range(8) if _byte >> p & 1):
        _SELECT[_byte, _k] = _place
_BLOCK = 8  # words per directory entry


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` (1..63) bits each, packed into 64-bit words."""
    at = np.arange(len(values), dtype=np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(_U)
    out = np.zeros(-(-(len(values) * bits) // 64) + 2, _U)
    if len(values):
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] = np.bitwise_or.reduceat(values << shift, starts)
        over = np.flatnonzero((at & 63) + bits > 64)
        out[word[over] + 1] |= values[over] >> (_U(64) - shift[over])
    return out


class EliasFano:
    """Views of one stored sequence; build with ``arrays``."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits = int(head[0]), int(head[1])
        self.low, self.high, self.ones = low, high, ones

    @staticmethod
    def arrays(values: np.ndarray, universe: int) -> list[np.ndarray]:
        values, n = values.astype(_U), len(values)
        bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        bits = min(bits, 63)
        low = _pack(values & _U((1 << bits) - 1), bits) if bits else np.zeros(0, _U)
        place = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        size = int((universe >> bits) + n + 2)
        words = -(-size // (64 * _BLOCK)) * _BLOCK
        flags = np.zeros(words * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(_U)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64).reshape(-1, _BLOCK).sum(axis=1))])
        return [np.array([n, bits], np.int64), low, high, ones]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of the high bits."""
        before = self.ones if one else np.arange(len(self.ones)) * (64 * _BLOCK) - self.ones
        block = np.searchsorted(before, k, "right") - 1
        left, word = k - before[block], block * _BLOCK
        for _ in range(_BLOCK - 1):
            count = np.bitwise_count(self.high[word]).astype(np.int64)
            count = count if one else 64 - count
            go = left >= count
            left, word = left - count * go, word + go
        value = self.high[word] if one else ~self.high[word]
        byte = np.zeros(len(k), np.int64)
        for _ in range(7):
            count = np.bitwise_count(value & _U(255)).astype(np.int64)
            go = left >= count
            left, byte = left - count * go, byte + go
            value = np.where(go, value >> _U(8), value)
        return word * 64 + byte * 8 + _SELECT[(value & _U(255)).astype(np.int64), left]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(_U)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return value & _U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i."""
        high = (self._select(i, True) - i).astype(_U)
        return high << _U(self.bits) | self._low(i)

    def find(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """For each x its place, or -1; only places in [begin, end) if given."""
        x = x.astype(_U)
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        h = (x >> _U(self.bits)).astype(np.int64)
        top = len(self.high) * 64 - self.n - 1
        inside = h <= top
        h = np.minimum(h, top)
        lo = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - (h - 1), 0)
        hi = np.minimum(self._select(h, False) - h, self.n)
        lo, hi = np.where(inside, lo, 0), np.where(inside, hi, 0)
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        stop, want = hi.copy(), x & _U((1 << self.bits) - 1)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
        ok = np.flatnonzero(lo < stop)
        ok = ok[self._low(lo[ok]) == want[ok]]
        out = np.full(len(x), -1, np.int64)
        out[ok] = lo[ok]
        return out


def stored(arrays: list[np.ndarray]) -> bytes:
    """The arrays as one value: their number, (kind, length) of each, then their bytes,
    each begun at a multiple of eight."""
    head = [len(arrays)] + [x for a in arrays for x in (_KINDS.index(a.dtype.str), len(a))]
    room = b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)
    return np.array(head, np.int64).tobytes() + room


def mapped(value) -> list[np.ndarray]:
    """The arrays of ``stored``, as views of one anonymous memory map."""
    size = memoryview(value).nbytes
    room = mmap.mmap(-1, max(8, size))
    room[:size] = bytes(value) if isinstance(value, memoryview) else memoryview(value)
    n, out = int(np.frombuffer(room, np.int64, 1)[0]), []
    at = 8 + 16 * n
    for kind, length in np.frombuffer(room, np.int64, 2 * n, 8).reshape(-1, 2):
        out.append(np.frombuffer(room, np.dtype(_KINDS[kind]), int(length), at))
        at += -(-out[-1].nbytes // 8) * 8
    return out


#: Kinds of stored arrays.
_KINDS = ["|u1", "<i8", "<u8"]
#: Quantised counts: code 0 is "not there", up to EXACT a count is its own code, and the
#: codes beyond are even steps of its logarithm.
EXACT, MOST = 63, 1e15
_STEP = np.log(MOST / EXACT) / (255 - EXACT)


def quantised(n: np.ndarray) -> np.ndarray:
    far = np.rint(EXACT + np.log(np.maximum(n, 1) / EXACT) / _STEP)
    return np.where(n <= EXACT, n, np.clip(far, EXACT, 255)).astype(np.uint8)


#: The count that each code stands for.
RESTORED = np.where(np.arange(256) <= EXACT, np.arange(256), EXACT * np.exp((np.arange(256) - EXACT) * _STEP))


class Trie:
    """Words, pointers to their successors, and the successors' quantised counts.

    Successors are numbers of 48 bits.  Level one is the words (ascending, 64 bits) with exact ``counts`` and monotone
    pointers; level two holds, for each successor of word i with number s among the
    shard's ``m`` distinct successors, the value i * m + s, which ascends.  A
    successor's count over its word's count is its probability.
    """

    @staticmethod
    def arrays(words: np.ndarray, counts: np.ndarray, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Of words with counts, and pairs (place of the first word, second word, count), both ascending."""
        names, place = np.unique(second, return_inverse=True)
        pointers = np.searchsorted(first, np.arange(len(words) + 1))
        value = first.astype(_U) * _U(max(1, len(names))) + place.astype(_U)
        levels = [
            EliasFano.arrays(words, 1 << 64),
            EliasFano.arrays(pointers, len(first) + 1),
            EliasFano.arrays(names, 1 << 48),
            EliasFano.arrays(value, max(1, len(words) * len(names))),
        ]
        return [a for level in levels for a in level] + [quantised(n), counts.astype(np.int64)]

    def __init__(self, flat: list[np.ndarray]):
        self.words, self.pointers, self.names, self.pairs = (EliasFano(*flat[4 * k : 4 * k + 4]) for k in range(4))
        self.codes, self.counts, self.m = flat[16], flat[17], max(1, self.names.n)

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place or -1, count, first successor, end of successors) of each word."""
        at = self.words.find(words)
        known = np.flatnonzero(at >= 0)
        count, begin, end = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        count[known] = self.counts[at[known]]
        begin[known] = self.pointers.get(at[known]).astype(np.int64)
        end[known] = self.pointers.get(at[known] + 1).astype(np.int64)
        return at, count, begin, end

    def codes_of(self, place: np.ndarray, begin: np.ndarray, end: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Quantised count of ``second`` after the word at ``place`` (0: unseen),
        searched among that word's successors [begin, end)."""
        out = np.zeros(len(second), np.uint8)
        s = self.names.find(second)
        ask = np.flatnonzero((s >= 0) & (place >= 0) & (begin < end))
        at = self.pairs.find(place[ask].astype(_U) * _U(self.m) + s[ask].astype(_U), begin[ask], end[ask])
        hit = at >= 0
        out[ask[hit]] = self.codes[at[hit]]
        return out
