"""Expectation-maximisation over the votes of labellers (Dawid and Skene, 1979), on counts of vote patterns.

A pattern is one vote in {0, 1, None} per labeller; patterns are few (3 ** labellers), so their counts over the whole
corpus are a bounded summary and the fit sees every row.
"""

from __future__ import annotations

import numpy as np


class WeakLabels:
    """Class prior and each labeller's rates of voting 1 and 0 in each class; an abstention says nothing."""

    def __init__(self, n: int, prior: float = 0.5, trust: float = 0.8):
        self.prior = prior
        self.start = prior
        # chance of vote 1, given a vote, in class 0 and in class 1
        self.one = np.tile([1 - trust, trust], (n, 1)).astype(float)

    def posterior(self, patterns: list[tuple]) -> np.ndarray:
        """Chance of class 1 for each pattern."""
        votes = np.array([[-1 if v is None else v for v in p] for p in patterns], int).reshape(len(patterns), len(self.one))
        score = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, (p0, p1) in enumerate(np.clip(self.one, 1e-4, 1 - 1e-4)):
            score += np.where(votes[:, j] == 1, np.log(p1 / p0), 0) + np.where(votes[:, j] == 0, np.log((1 - p1) / (1 - p0)), 0)
        return 1 / (1 + np.exp(-score))

    def fit(self, patterns: list[tuple], counts: list[int], rounds: int = 100, smooth: float = 4.0) -> WeakLabels:
        """smooth: pseudo-votes that hold each labeller near its starting reliability, so that class 1 stays class 1."""
        if not patterns:
            return self
        votes = np.array([[-1 if v is None else v for v in p] for p in patterns], int)
        n, anchor = np.array(counts, float), self.one.copy()
        for _ in range(rounds):
            before = self.one.copy()
            p = self.posterior(patterns)
            self.prior = float(np.clip(((n * p).sum() + self.start * smooth) / (n.sum() + smooth), 1e-3, 1 - 1e-3))
            for c, weight in ((0, n * (1 - p)), (1, n * p)):
                for j in range(len(self.one)):
                    yes, said = weight[votes[:, j] == 1].sum(), weight[votes[:, j] >= 0].sum()
                    self.one[j, c] = (yes + anchor[j, c] * smooth) / (said + smooth)
            if np.abs(self.one - before).max() < 1e-6:
                break
        return self


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; target may be soft; the last coefficient is the intercept."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    b = np.zeros(x.shape[1])
    hold = np.full(len(b), ridge)
    hold[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - target)) + hold * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold + 1e-9)
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def apply(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30)))
