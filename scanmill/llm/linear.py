"""Linear models over sparse rows, fitted on the driver to a sample of bounded size."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: feature numbers and values, one run per row."""

    def __init__(self, features: list[np.ndarray], values: list[np.ndarray]):
        self.sizes = np.array([len(f) for f in features], dtype=np.int64)
        self.feature = np.concatenate(features).astype(np.int64) if features else np.zeros(0, np.int64)
        self.value = np.concatenate(values).astype(np.float64) if values else np.zeros(0)
        self.owner = np.repeat(np.arange(len(features)), self.sizes)
        self.n = len(features)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=self.value * weights[self.feature], minlength=self.n)

    def spread(self, per_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, weights=self.value * per_row[self.owner], minlength=size)


def fit(rows: Rows, target: np.ndarray, weight: np.ndarray, size: int, loss: str, penalty: float, steps: int, rate: float):
    """Weights and bias by accelerated full-batch descent.

    ``loss`` "hinge" is the linear support vector machine (target -1 or 1), "logistic" takes target probabilities.
    """
    w, b = np.zeros(size), 0.0
    dw, db = np.zeros(size), 0.0
    weight = weight / weight.sum()
    for _ in range(steps):
        look_w, look_b = w + 0.9 * dw, b + 0.9 * db
        margin = rows.dot(look_w) + look_b
        if loss == "hinge":
            slope = np.where(target * margin < 1, -target, 0.0) * weight
        else:
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target) * weight
        dw = 0.9 * dw - rate * (rows.spread(slope, size) + penalty * look_w)
        db = 0.9 * db - rate * slope.sum()
        w, b = w + dw, b + db
    return w, b
