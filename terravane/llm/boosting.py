"""Gradient-boosted trees small enough to compile into one SQL expression.

Logistic loss, second-order leaf values, exact splits over integer features.
Training is a bounded driver-side step; scoring is the compiled expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Node:
    feature: int = -1
    at: float = 0.0  # left if value <= at
    left: Node | None = None
    right: Node | None = None
    value: float = 0.0


def _grow(x, g, h, depth: int, reg: float, least: int) -> Node:
    def leaf() -> Node:
        return Node(value=float(-g.sum() / (h.sum() + reg)))

    if depth == 0 or len(g) < 2 * least:
        return leaf()
    gain, whole = (1e-6, None), g.sum() ** 2 / (h.sum() + reg)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(v) - cut - 1 >= least)]
        if not len(cut):
            continue
        gl, hl = gs[cut], hs[cut]
        score = gl**2 / (hl + reg) + (gs[-1] - gl) ** 2 / (hs[-1] - hl + reg) - whole
        i = int(score.argmax())
        if score[i] > gain[0]:
            gain = (float(score[i]), (f, float(v[cut[i]] + v[cut[i] + 1]) / 2))
    if gain[1] is None:
        return leaf()
    f, at = gain[1]
    low = x[:, f] <= at
    return Node(f, at, _grow(x[low], g[low], h[low], depth - 1, reg, least), _grow(x[~low], g[~low], h[~low], depth - 1, reg, least))


def _value(node: Node, x) -> np.ndarray:
    if node.left is None:
        return np.full(len(x), node.value)
    low, out = x[:, node.feature] <= node.at, np.empty(len(x))
    out[low], out[~low] = _value(node.left, x[low]), _value(node.right, x[~low])
    return out


def fit(x, y, rounds: int = 30, depth: int = 3, rate: float = 0.3, reg: float = 1.0, least: int = 8) -> list[Node]:
    """Trees whose summed values (times ``rate``) are the log-odds of y = 1."""
    x, y, raw, trees = np.asarray(x, float), np.asarray(y, float), np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(x, p - y, p * (1 - p), depth, reg, least)
        raw += rate * _value(tree, x)
        trees.append(tree)
    return trees


def predict(trees: list[Node], x, rate: float = 0.3) -> np.ndarray:
    return rate * sum(_value(t, np.asarray(x, float)) for t in trees)


def isotonic(score, y) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities), both ascending: the ends of the blocks of the nondecreasing step
    function of the score that is nearest to y (neighbouring blocks in the wrong order
    are pooled); between two blocks the probability runs straight."""
    at, inverse = np.unique(np.asarray(score, float), return_inverse=True)
    blocks: list[list[float]] = []  # least and largest score, sum of y, rows
    for s, total, n in zip(at, np.bincount(inverse, np.asarray(y, float)), np.bincount(inverse), strict=True):
        blocks.append([s, s, total, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, most, total, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], most, blocks[-1][2] + total, blocks[-1][3] + n]
    return np.array([b[k] for b in blocks for k in (0, 1)]), np.array([b[2] / b[3] for b in blocks for _ in (0, 1)])


def score_at(probability: float, scores: np.ndarray, likely: np.ndarray) -> float:
    """The least score with at least that calibrated probability; infinite if there is none.
    Where no block lies below it, samples do not say where to cut, and the score's own
    odds do."""
    good = np.flatnonzero(likely >= probability)
    if not len(good):
        return float("inf")
    k = good[0]
    if k == 0:
        return min(float(scores[0]), float(np.log(probability / (1 - probability))) if 0 < probability < 1 else float("inf"))
    if likely[k] == likely[k - 1]:
        return float(scores[k])
    share = (probability - likely[k - 1]) / (likely[k] - likely[k - 1])
    return float(scores[k - 1] + share * (scores[k] - scores[k - 1]))


def to_sql(trees: list[Node], features: list[str], rate: float = 0.3) -> str:
    """The summed trees as one SQL expression over feature expressions."""

    def tree(n: Node) -> str:
        if n.left is None:
            return f"{rate * n.value:.9f}D"
        return f"CASE WHEN {features[n.feature]} <= {n.at!r}D THEN {tree(n.left)} ELSE {tree(n.right)} END"

    return " + ".join(f"({tree(t)})" for t in trees)
