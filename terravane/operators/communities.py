"""Kernels of Louvain over blocks of vertices with neighbouring ids.

A block's links stay packed in arrays, some rows a block, so a sweep passes them on without
making a row of each.  Blocks tell each other the communities of those vertices only that
the other block has links to.  Links lie in both directions, so both know the same list in
the same order, and no ids are sent."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Links of a block (both directions count), and of one of its packed rows.
BLOCK, PIECE = 1 << 19, 1 << 17
PIECES = "block int, a binary, b binary, w binary"
#: ids, k, loop, size: vertices, their degrees, weight of their loops, number of their other links; far: vertices
#: of other blocks; at, w: of each link the far end's place in ids and then far, and the weight.
PACKED = "block int, piece int, loops double, ids binary, k binary, loop binary, size binary, far binary, at binary, w binary"
ROUTES = "block int, to int, at binary"
TOLD = "block int, part int, c binary, tot binary"
ALONE = "block int, a long, c long, k double"
STATE = "block int, a long, c long, k double, tot double, pick long, inside double, links long"
TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _table(schema: str, *columns) -> pa.Table:
    """Columns under the names and types of a Spark schema."""
    named = [c.split() for c in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, named)], names=[n for n, _ in named])


def _one(table: pa.Table, column: str, dtype: type, rows: list[int] | None = None) -> np.ndarray:
    """The arrays packed in a column's rows, one after the other."""
    cells = table.column(column)
    held = [np.frombuffer(cells[i].as_buffer(), dtype) for i in (range(len(cells)) if rows is None else rows)]
    return np.concatenate(held) if held else np.zeros(0, dtype)


class _Block:
    """The packed rows of one block."""

    def __init__(self, table: pa.Table) -> None:
        piece = table.column("piece").to_numpy()
        order = np.argsort(piece).tolist()
        self.name = table.column("block")[0].as_py()
        self.ids, self.far = (_one(table, c, np.int64, order[:1]) for c in ("ids", "far"))
        self.k, self.loop = (_one(table, c, np.float64, order[:1]) for c in ("k", "loop"))
        self.size = _one(table, "size", np.int64, order[:1])
        self.at, self.w = _one(table, "at", np.int32, order), _one(table, "w", np.float64, order)
        self.row = np.repeat(np.arange(len(self.ids)), self.size)


def _pieces(lows: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> pa.Table:
    """Links as rows of ``PIECES`` for the blocks that begin at ``lows``."""
    block = np.searchsorted(lows, a, "right") - 1
    order = np.argsort(block, kind="stable")
    block, a, b, w = block[order], a[order], b[order], w[order]
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    return _table(PIECES, block[cuts], *[[x.tobytes() for x in np.split(c, cuts)[1:]] for c in (a, b, w)])


def dealt(lows: np.ndarray) -> Callable:
    """The kernel that deals edges (v0, v1, w), in both directions, to the blocks that begin at ``lows``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held, rows = [*held, batch], rows + batch.num_rows
            if rows and (batch is None or rows >= PIECE):
                a, b, w = (pa.Table.from_batches(held).column(c).to_numpy() for c in ("v0", "v1", "w"))
                yield from _pieces(lows, np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])).to_batches()
                held, rows = [], 0

    return deal


def packed(pieces: pa.Table) -> pa.Table:
    """A block's pieces put together: weights of equal links are added up."""
    ids, row = np.unique(_one(pieces, "a", np.int64), return_inverse=True)
    ends, end = np.unique(_one(pieces, "b", np.int64), return_inverse=True)
    row, end, w = _sums(row, end, _one(pieces, "w", np.float64), len(ends))
    n, k, b = len(ids), np.bincount(row, w), ends[end]
    loops = ids[row] == b
    loop = np.bincount(row[loops], w[loops], minlength=n)
    row, b, w = row[~loops], b[~loops], w[~loops]
    at = np.minimum(np.searchsorted(ids, b), n - 1)
    away = ids[at] != b
    far, slot = np.unique(b[away], return_inverse=True)
    at[away] = n + slot
    at, size = at.astype(np.int32), np.bincount(row, minlength=n)
    starts = range(0, max(1, len(at)), PIECE)
    vertices = [[x.tobytes(), *[b""] * (len(starts) - 1)] for x in (ids, k, loop, size, far)]
    first = [loop.sum() if start == 0 else 0.0 for start in starts]
    parts = [[x[start : start + PIECE].tobytes() for start in starts] for x in (at, w)]
    return _table(PACKED, [pieces.column("block")[0].as_py()] * len(starts), range(len(starts)), first, *vertices, *parts)


def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every vertex of first packed rows in a community of its own."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for i, block in enumerate(table.column("block").to_pylist()):
            ids, k = _one(table, "ids", np.int64, [i]), _one(table, "k", np.float64, [i])
            yield from _table(ALONE, np.full(len(ids), block), ids, ids, k).to_batches()


def routes(lows: np.ndarray) -> Callable:
    """The kernel that lists which of a block's vertices (their places) each other block has links to."""

    def listed(table: pa.Table) -> pa.Table:
        block = _Block(table)
        n = len(block.ids)
        away = block.at >= n
        to = (np.searchsorted(lows, block.far, "right") - 1)[block.at[away] - n]
        pairs = np.unique(to * n + block.row[away])
        to, at = pairs // n, (pairs % n).astype(np.int32)
        cuts = np.flatnonzero(np.diff(to, prepend=-1))
        return _table(ROUTES, [block.name] * len(cuts), to[cuts], [x.tobytes() for x in np.split(at, cuts)[1:]])

    return listed


def tell(ways: pa.Table, placed: pa.Table) -> pa.Table:
    """What a block's vertices (block, a, c, tot) tell their own block, as part -1, and the others."""
    order = np.argsort(placed.column("a").to_numpy())
    c, tot = placed.column("c").to_numpy()[order], placed.column("tot").to_numpy()[order]
    block, to = placed.column("block")[0].as_py(), ways.column("to").to_pylist()
    chosen = [slice(None), *[_one(ways, "at", np.int32, [i]) for i in range(len(to))]]
    return _table(TOLD, [block, *to], [-1, *[block] * len(to)], [c[x].tobytes() for x in chosen], [tot[x].tobytes() for x in chosen])


def _heard(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Community and its weight of a block's vertices and then of the far ones, which blocks in
    the order of their names tell in the order of their ids."""
    order = np.argsort(table.column("part").to_numpy()).tolist()
    return _one(table, "c", np.int64, order), _one(table, "tot", np.float64, order)


def _sums(row: np.ndarray, other: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair (row, other < n) once, ascending, with the sum of its weights."""
    pairs = row * n + other
    order = np.argsort(pairs)
    pairs = pairs[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    pairs = pairs[first]
    return pairs // n, pairs % n, np.add.reduceat(w[order], first) if len(first) else w[:0]


def _best(block: _Block, c: np.ndarray, tot: np.ndarray, m2: float) -> tuple[np.ndarray, np.ndarray]:
    """The community each vertex would move to, the one with the largest gain, among equals its own
    and then the least, and the weight of its links into its own; from the community of every end
    (ranks of labels) and the weight of every community."""
    n, k, mine = len(block.ids), block.k, c[: len(block.ids)]
    row, to, k_in = _sums(block.row, c[block.at], block.w, len(tot))
    own = to == mine[row]
    inside = np.zeros(n)
    inside[row[own]] = k_in[own]
    stay = inside - (tot[mine] - k) * k / m2
    row, to, k_in = row[~own], to[~own], k_in[~own]
    gain = k_in - tot[to] * k[row] / m2
    start, pick = np.flatnonzero(np.diff(row, prepend=-1)), mine.copy()
    if len(start):
        most = np.maximum.reduceat(gain, start)
        best = np.flatnonzero(gain == np.repeat(most, np.diff(start, append=len(row))))
        best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
        best = best[gain[best] > stay[row[best]]]
        pick[row[best]] = to[best]
    return pick, inside


def _state(block: _Block, names: np.ndarray, c: np.ndarray, tot: np.ndarray, pick: np.ndarray, inside: np.ndarray) -> pa.Table:
    return _table(STATE, np.full(len(block.ids), block.name), block.ids, names[c], block.k, tot[c], names[pick], inside, block.size + (block.loop != 0))


def judge(m2: float) -> Callable:
    """The kernel that finds where each vertex of a block would move to, from what the block heard."""

    def judged(links: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(links)
        c, tot = _heard(told)
        names, first, c = np.unique(c, return_index=True, return_inverse=True)
        return _state(block, names, c[: len(block.ids)], tot[first], *_best(block, c, tot[first], m2))

    return judged


def settled(m2: float, sweeps: int, tolerance: float) -> Callable:
    """The kernel of all sweeps of a level that is one block; ``turns`` (block, a, halves) has each
    vertex's half in every two sweeps."""

    def settle(links: pa.Table, turns: pa.Table) -> pa.Table:
        block = _Block(links)
        n, k = len(block.ids), block.k
        halves = turns.column("halves").combine_chunks().flatten().to_numpy().reshape(n, -1)[np.argsort(turns.column("a").to_numpy())]

        def survey(c: np.ndarray) -> tuple:
            tot = np.bincount(c, k, minlength=n)
            pick, inside = _best(block, c, tot, m2)
            return (inside.sum() + block.loop.sum()) / m2 - (k * tot[c]).sum() / (m2 * m2), c, tot, pick, inside

        best = survey(np.arange(n))
        for sweep in range(sweeps):
            now = survey(np.where(halves[:, sweep // 2] == sweep % 2, best[3], best[1]))
            if now[0] > best[0] + tolerance:
                best = now
            elif sweep % 2:
                break
        return _state(block, block.ids, *best[1:])

    return settle


def contracted(lows: np.ndarray) -> Callable:
    """The kernel that adds up a block's links by the communities of their ends, for the blocks
    of communities that begin at ``lows``."""

    def contract(links: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(links)
        names, c = np.unique(_heard(told)[0], return_inverse=True)
        mine, loops = c[: len(block.ids)], np.flatnonzero(block.loop)
        a, b = (np.concatenate([x, mine[loops]]) for x in (mine[block.row], c[block.at]))
        a, b, w = _sums(a, b, np.concatenate([block.w, block.loop[loops]]), len(names))
        return _pieces(lows, names[a], names[b], w)

    return contract
