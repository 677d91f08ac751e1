"""Small numpy solvers for models over hashed sparse features, fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: (index and value of every entry, entries of each row) of some sparse rows.
Rows = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Rows of one block: what a step holds beside the sample is a block's share of it.
BLOCK_ROWS = 256


def stack(rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
    sizes = np.array([len(i) for i, _ in rows], np.int64)
    index = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int32)
    value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0, np.float32)
    return index.astype(np.int32, copy=False), value.astype(np.float32, copy=False), sizes


def owners(sizes: np.ndarray) -> np.ndarray:
    """The row of every entry."""
    return np.repeat(np.arange(len(sizes)), sizes)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def adam(
    start: list[np.ndarray],
    gradient: Callable[[list[np.ndarray]], list[np.ndarray]],
    steps: int,
    rate: float,
    falling: bool = False,
) -> list[np.ndarray]:
    params = [p.copy() for p in start]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        here = rate * (1 - (t - 1) / steps) if falling else rate
        for p, m, v, g in zip(params, first, second, gradient(params), strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= here * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params


class Blocks:
    """Labelled sparse rows, stacked ``BLOCK_ROWS`` at a time as they come."""

    def __init__(self):
        self._full: list[Rows] = []
        self._open: list[tuple[np.ndarray, np.ndarray]] = []
        self._labels: list[float] = []

    def add(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        self._open.append((index, value))
        self._labels.append(float(label))
        if len(self._open) == BLOCK_ROWS:
            self._close()

    def _close(self) -> None:
        if self._open:
            self._full.append(stack(self._open))
            self._open = []

    def rows(self) -> list[Rows]:
        self._close()
        return self._full

    def labels(self) -> np.ndarray:
        return np.array(self._labels)

    def mixed(self) -> bool:
        """Whether both classes are among the rows."""
        return 0 < sum(self._labels) < len(self._labels)

    def joined(self, other: Blocks) -> Blocks:
        both = Blocks()
        both._full = self.rows() + other.rows()
        both._labels = self._labels + other._labels
        return both


def linear(blocks: list[Rows], weights: np.ndarray) -> np.ndarray:
    """The weighted sum of each row."""
    sums = [np.bincount(owners(n), weights=weights[i] * v, minlength=len(n)) for i, v, n in blocks]
    return np.concatenate(sums) if sums else np.zeros(0)


def fit_logistic(
    blocks: list[Rows], labels: np.ndarray, dims: int, l2: float = 1e-6, steps: int = 300, rate: float = 0.5
) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the mean log loss, a block a step, the rate falling to nothing."""
    parts = np.split(labels, np.cumsum([len(sizes) for *_, sizes in blocks])[:-1])
    turn = 0

    def gradient(params):
        nonlocal turn
        (index, value, sizes), y = blocks[turn % len(blocks)], parts[turn % len(blocks)]
        turn += 1
        w, b = params
        owner = owners(sizes)
        z = np.bincount(owner, weights=w[index] * value, minlength=len(y)) + b[0]
        off = (sigmoid(z) - y) / len(y)
        return [l2 * w + np.bincount(index, weights=off[owner] * value, minlength=dims), np.array([off.sum()])]

    w, b = adam([np.zeros(dims), np.zeros(1)], gradient, steps, rate, falling=True)
    return w, float(b[0])


def fit_platt(scores: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that calibrate ``scores``, by Newton steps on Platt's smoothed targets.

    A weak prior holds the slope near 1, so a few rows that separate cleanly give no extreme.
    """
    up, down = labels.sum(), (1 - labels).sum()
    if not up or not down:
        return 1.0, 0.0
    goal = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * scores + b)
        off, curve = p - goal, p * (1 - p) + 1e-9
        grad = np.array([(off * scores).sum() + a - 1.0, off.sum() + b])
        hess = np.array([[(curve * scores**2).sum(), (curve * scores).sum()], [(curve * scores).sum(), curve.sum()]])
        step = np.linalg.solve(hess + np.eye(2), grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
