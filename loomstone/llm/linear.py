"""Logistic regression on small dense matrices (a bounded sample on the driver)."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Coefficients and, last, the intercept that maximise the weighted likelihood less a ridge penalty.

    Newton's method with step halving; the intercept isn't penalised. With one class only, or no rows, the
    coefficients are 0 and the intercept gives the (smoothed) share of class 1.
    """
    weight = np.ones(len(y)) if weight is None else weight
    total, ones = weight.sum(), (weight * y).sum()
    if not len(y) or ones in (0, total):
        share = (ones + 0.5) / (total + 1)
        return np.r_[np.zeros(x.shape[1]), np.log(share / (1 - share))]
    design = np.c_[x, np.ones(len(x))]
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-9]
    w = np.zeros(design.shape[1])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(design @ w)
        gradient = design.T @ (weight * (p - y)) + penalty * w
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-6 and (new := loss(w - size * step)) > now - 1e-12 * abs(now):
            size /= 2
        if size <= 1e-6:
            break
        done = now - new < 1e-9 * (1 + abs(now))
        w, now = w - size * step, new
        if done:
            break
    return w


class Incidence:
    """A matrix of 0 and 1, by the sorted column numbers of each row."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([i for r in rows for i in r], dtype=np.int64)
        self.height, self.width = len(rows), width

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, v[self.column], self.height)

    def transposed_times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, v[self.row], self.width)

    def only(self, columns: list[int]) -> Incidence:
        """The matrix with zeros in all other columns."""
        mask = np.zeros(self.width + 1, bool)
        mask[columns] = True
        out = Incidence([], self.width)
        held = mask[self.column]
        out.row, out.column, out.height = self.row[held], self.column[held], self.height
        return out

    def take(self, keep: np.ndarray) -> Incidence:
        """The rows where keep holds."""
        out = Incidence([], self.width)
        held = keep[self.row]
        out.row, out.column, out.height = (np.cumsum(keep) - 1)[self.row[held]], self.column[held], int(keep.sum())
        return out


def fit_sparse_logistic(x: Incidence, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, lasso: float, steps: int = 600) -> np.ndarray:
    """Coefficients of x's columns, then of extra's, then the intercept, with an L1 penalty on x's columns.

    Accelerated proximal gradient steps on the mean weighted loss, from zeros, so the result is deterministic. With one
    class only, or no rows, the coefficients are 0.
    """
    width, n_extra = x.width, extra.shape[1]
    if not len(y) or y.min() == y.max():
        share = ((weight * y).sum() + 0.5) / (weight.sum() + 1)
        return np.r_[np.zeros(width + n_extra), np.log(share / (1 - share))]
    dense = np.c_[extra, np.ones(len(y))]
    weight = weight / weight.sum()

    def forward(b: np.ndarray) -> np.ndarray:
        return x.times(b[:width]) + dense @ b[width:]

    def backward(v: np.ndarray) -> np.ndarray:
        return np.r_[x.transposed_times(v), dense.T @ v]

    v = np.ones(width + n_extra + 1)
    for _ in range(15):  # the largest curvature
        v = backward(weight * forward(v / np.linalg.norm(v)))
    size = 4 / (1.05 * np.linalg.norm(v))
    b, at, t = np.zeros(len(v)), np.zeros(len(v)), 1.0
    for _ in range(steps):
        new = at - size * backward(weight * (sigmoid(forward(at)) - y))
        new[:width] = np.sign(new[:width]) * np.maximum(np.abs(new[:width]) - size * lasso, 0)
        if (at - new) @ (new - b) > 0:  # restart where momentum points uphill
            t = 1.0
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        b, at, t = new, new + (t - 1) / faster * (new - b), faster
    return b
