"""Small dense logistic models, fitted on the driver on a bounded sample and applied in the tasks."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Logistic:
    """Ridge logistic regression by Newton's method on standardised features."""

    def __init__(self, ridge: float = 1.0, steps: int = 12):
        self.ridge, self.steps = ridge, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        scale = x.std(0) if len(x) else np.ones(x.shape[1])
        self.scale = np.where(scale > 1e-9, scale, 1.0)
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        ridge = np.full(z.shape[1], self.ridge)
        ridge[-1] = 1e-3
        w = np.zeros(z.shape[1])
        for _ in range(self.steps):
            p = sigmoid(z @ w)
            gradient = z.T @ (p - y) + ridge * w
            hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-5:
                break
        self.w, self.b = w[:-1] / self.scale, w[-1] - (w[:-1] / self.scale) @ self.mean
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(x, float) @ self.w + self.b

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def calibrated(logits: np.ndarray, y: np.ndarray) -> Logistic:
    """Platt scaling: a one-feature model from logits to probabilities."""
    return Logistic(ridge=0.1).fit(np.asarray(logits).reshape(-1, 1), y)
