"""Small gradient-boosted trees: fitted on bounded rows on the driver, run as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    split: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _coded(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each feature's distinct values, ascending, and the number of each row's among them."""
    return [np.unique(x[:, j], return_inverse=True) for j in range(x.shape[1])]


def _grow(coded: list, rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int) -> Node:
    """A regression tree over some rows by exact greedy splits on the second-order gain."""
    total, weight = gradient[rows].sum(), hessian[rows].sum()
    leaf = Node(value=float(total / (weight + 1.0)))
    if depth == 0 or len(rows) < 20:
        return leaf
    best = (1e-3, -1, 0.0, 0)
    for j, (values, codes) in enumerate(coded):
        own = codes[rows]
        there = np.flatnonzero(np.bincount(own, minlength=len(values)))
        if len(there) < 2:
            continue
        g, h = (np.cumsum(np.bincount(own, x[rows], len(values))[there])[:-1] for x in (gradient, hessian))
        gain = g**2 / (h + 1) + (total - g) ** 2 / (weight - h + 1) - total**2 / (weight + 1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float((values[there[k]] + values[there[k + 1]]) / 2), int(there[k]))
    if best[1] < 0:
        return leaf
    low = coded[best[1]][1][rows] <= best[3]
    return Node(0.0, best[1], best[2], *(_grow(coded, part, gradient, hessian, depth - 1) for part in (rows[low], rows[~low])))


def _values(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.split, _values(node.low, x), _values(node.high, x))


@dataclass
class Trees:
    """A sum of trees; slope and shift calibrate it, threshold selects."""

    trees: list[Node]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((_values(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def sql(self, x: str) -> str:
        """The calibrated probability as a SQL expression of an array of features."""

        def of(node: Node) -> str:
            if node.feature < 0:
                return f"{node.value!r}D"
            return f"CASE WHEN {x}[{node.feature}] <= {node.split!r}D THEN {of(node.low)} ELSE {of(node.high)} END"

        total = " + ".join([f"{self.shift!r}D", *(f"{self.slope!r}D * {of(t)}" for t in self.trees)])
        return f"1D / (1D + exp(-({total})))"


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 12, depth: int = 3, rate: float = 0.4, precision: float = 0.97) -> Trees:
    """Boosts on even rows; odd rows calibrate and set the least threshold that reaches the precision."""
    own, other = np.arange(len(x)) % 2 == 0, np.arange(len(x)) % 2 == 1
    model, raw = Trees([]), np.zeros(int(own.sum()))
    coded, rows = _coded(x[own]), np.arange(int(own.sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(coded, rows, rate * (y[own] - p), p * (1 - p), depth)
        model.trees.append(tree)
        raw = raw + _values(tree, x[own])
    z, t = model.raw(x[other]), y[other]
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((t - p) * z).sum() - 0.1 * (a - 1), (t - p).sum() - 0.1 * b])
        hess = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        a, b = np.array([a, b]) + np.linalg.solve(hess, grad)
    model.slope, model.shift = float(a), float(b)
    p = model.probability(x[other])
    good = [c for c in np.unique(p) if t[p >= c].mean() >= precision]
    model.threshold = float(max(0.5, min(good))) if good else 2.0
    return model
