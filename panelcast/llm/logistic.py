"""Small weighted logistic regression for samples on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps with a ridge (not on the
    constant). Without rows, or with one class, it is the smoothed base rate."""
    base = (float((weight * y).sum()) + 0.5) / (float(weight.sum()) + 1)
    beta = np.zeros(x.shape[1] + 1)
    beta[-1] = np.log(base / (1 - base))
    if not len(y) or y.min() == y.max():
        return beta
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(len(beta), l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(z @ beta)
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * curve[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def predict(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ beta[:-1] + beta[-1])
