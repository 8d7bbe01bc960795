"""Small linear models over hashed features, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of (feature numbers, values) for a design matrix with ``width`` columns."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.width, self.count = width, len(rows)
        sizes = np.array([len(i) for i, _ in rows], np.int64)
        self.columns = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.values = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
        self.owner = np.repeat(np.arange(self.count), sizes)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.values * weights[self.columns], self.count)

    def transposed_dot(self, residual: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * residual[self.owner], self.width)

    def curvature(self, share: np.ndarray) -> float:
        """An upper bound of the largest eigenvalue of X' diag(share) X, by power iteration."""
        v = np.ones(self.width) / np.sqrt(max(1, self.width))
        size = 1.0
        for _ in range(12):
            v = self.transposed_dot(share * self.dot(v))
            size = float(np.linalg.norm(v))
            if not size:
                return 1.0
            v /= size
        return 1.2 * size


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def fit_logistic(x: Sparse, target: np.ndarray, weight: np.ndarray | None = None, l1: float = 0.0, l2: float = 1e-4,
                 rounds: int = 200, nonnegative: bool = False) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on targets in [0, 1] (accelerated proximal gradient).

    The intercept is not penalised. ``nonnegative`` weights can only add evidence. No rows, or no rows of one kind, give the base rate alone.
    """
    weight = np.ones(x.count) if weight is None else weight
    total = weight.sum()
    if not x.count or not total:
        return np.zeros(x.width), 0.0
    share = weight / total
    rate = float(np.clip((share * target).sum(), 1e-4, 1 - 1e-4))
    w, b = np.zeros(x.width), float(np.log(rate / (1 - rate)))
    step = 1 / (0.25 * (x.curvature(share) + 1) + l2)
    wy, by, t = w, b, 1.0
    for _ in range(rounds):
        residual = share * (sigmoid(x.dot(wy) + by) - target)
        moved = wy - step * (x.transposed_dot(residual) + l2 * wy)
        new_w = np.maximum(moved - step * l1, 0) if nonnegative else np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        new_b = by - step * residual.sum()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / new_t
        wy, by = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b
