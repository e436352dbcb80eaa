"""Weak supervision on the driver, over bounded tables: reliabilities by expectation-maximisation, and linear models."""

from __future__ import annotations

import warnings

import numpy as np


class Labellers:
    """Reliabilities of labellers that vote -1, 0 (abstain) or 1 on the same items.

    Each labeller has a distribution of its votes for true and for false items; both,
    and the share of true ones, are estimated by expectation-maximisation from how
    often each pattern of votes occurs, beginning with the majority, until posteriors stand still.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 2000, smooth: float = 1.0, still: float = 1e-6):
        votes, counts = np.asarray(patterns, int), np.asarray(counts, float)
        self.n = votes.shape[1] if votes.ndim == 2 else 0
        self.prior = 0.5
        self.logs = np.zeros((2, self.n, 3))
        if not len(counts):
            return
        true = sigmoid(2.0 * votes.sum(axis=1))
        for _ in range(rounds):
            for y, share in ((1, true), (0, 1 - true)):
                weight = share * counts
                for j in range(self.n):
                    seen = np.bincount(votes[:, j] + 1, weight, 3)
                    seen += smooth * (np.array([1, 2, 3]) if y else np.array([3, 2, 1]))  # better than chance, as a start
                    self.logs[y, j] = np.log(seen / seen.sum())
            self.prior = float(np.clip((true * counts).sum() / counts.sum(), 0.01, 0.99))
            before, true = true, self.posterior(votes)
            if np.abs(true - before).max() < still:
                return
        warnings.warn(f"reliabilities still move after {rounds} rounds", RuntimeWarning, stacklevel=2)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability that items with these votes are true; abstentions say nothing."""
        votes = np.asarray(votes, int).reshape(-1, self.n)
        j = np.arange(self.n)
        gap = np.where(votes, self.logs[1][j, votes + 1] - self.logs[0][j, votes + 1], 0).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(gap + np.log(self.prior / (1 - self.prior)), -500, 500)))

    def reliability(self) -> np.ndarray:
        """For each labeller, how often a vote that isn't an abstention is right."""
        p = np.exp(self.logs)
        right = self.prior * p[1, :, 2] + (1 - self.prior) * p[0, :, 0]
        cast = self.prior * (p[1, :, 2] + p[1, :, 0]) + (1 - self.prior) * (p[0, :, 0] + p[0, :, 2])
        return right / np.maximum(cast, 1e-12)


class Rows:
    """Sparse rows: lists of (feature, value)."""

    def __init__(self, features: list, values: list | None = None):
        self.n = len(features)
        self.row = np.repeat(np.arange(self.n), [len(f) for f in features])
        self.feature = np.concatenate([np.asarray(f, np.int64) for f in features]) if self.n else np.zeros(0, np.int64)
        self.value = np.concatenate([np.asarray(v, float) for v in values]) if values is not None and self.n else np.ones(len(self.feature))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.feature] * self.value, self.n)

    def back(self, errors: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, errors[self.row] * self.value, size)

    def where(self, features: np.ndarray) -> Rows:
        """The same rows with only the features that the mask allows."""
        keep = features[self.feature]
        out = Rows([])
        out.n, out.row, out.feature, out.value = self.n, self.row[keep], self.feature[keep], self.value[keep]
        return out

    def only(self, rows: np.ndarray) -> Rows:
        keep = np.isin(self.row, rows)
        out = Rows([])
        out.n = len(rows)
        out.row = np.searchsorted(rows, self.row[keep])
        out.feature, out.value = self.feature[keep], self.value[keep]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_linear(rows: Rows, target: np.ndarray, size: int, weight: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 300, held: int = 10, centre: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model for soft targets, by limited-memory quasi-Newton steps.

    The ridge pulls weights towards `centre`, else towards zero.
    """
    middle = np.append(np.zeros(size) if centre is None else centre, 0.0)
    v = middle.copy()  # the bias is last and isn't held back
    if not rows.n:
        return v[:size], 0.0
    weight = np.ones(rows.n) if weight is None else np.asarray(weight, float)
    weight = weight / weight.sum()
    hold = np.append(np.full(size, ridge), 0.0)
    share = float(np.clip(weight @ target, 1e-6, 1 - 1e-6))
    v[size] = np.log(share / (1 - share))

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows.dot(x[:size]) + x[size]
        error = weight * (sigmoid(z) - target)
        value = float(weight @ (np.logaddexp(0, z) - target * z) + (hold * (x - middle) ** 2).sum() / 2)
        return value, np.append(rows.back(error, size), error.sum()) + hold * (x - middle)

    value, slope = at(v)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, kept = slope.copy(), []
        for s, y, r in reversed(steps):
            a = r * (s @ way)
            way -= a * y
            kept.append(a)
        if steps:
            s, y, _ = steps[-1]
            way *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(steps, reversed(kept)):
            way += s * (a - r * (y @ way))
        by = 1.0 if steps else 1.0 / max(float(np.abs(slope).max()), 1e-12)
        fall = slope @ way
        while by > 1e-10:
            new = v - by * way
            after, tilt = at(new)
            if after <= value - 1e-4 * by * fall:
                break
            by /= 2
        else:
            break
        s, y = new - v, tilt - slope
        if s @ y > 1e-18:
            steps = [*steps[-held + 1 :], (s, y, 1 / (s @ y))]
        done = value - after < 1e-7 * max(abs(value), 1e-12)
        v, value, slope = new, after, tilt
        if done:
            break
    else:
        warnings.warn(f"weights still move after {rounds} rounds", RuntimeWarning, stacklevel=2)
    return v[:size], float(v[size])
