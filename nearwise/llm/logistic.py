"""Logistic regression on a bounded sample, fitted on the driver by Newton's method."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Logistic:
    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # the last is the constant

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weight[:-1] + self.weight[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, turns: int = 60) -> Logistic:
    """With one class only, a constant: that class's share, held within (0, 1) by a pseudo-row of each."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1)
    design = np.column_stack((np.clip((x - centre) / scale, -8, 8), np.ones(len(x))))
    weight = np.zeros(design.shape[1])
    share = (y.sum() + 1) / (len(y) + 2)
    weight[-1] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        penalty = np.full(design.shape[1], ridge * 1.0)
        penalty[-1] = 1e-6

        def cost(w):
            z = design @ w
            return np.logaddexp(0, z).sum() - y @ z + (penalty * w * w).sum() / 2

        now = cost(weight)
        for _ in range(turns):
            p = sigmoid(design @ weight)
            slope = design.T @ (p - y) + penalty * weight
            curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
            move, size = np.linalg.solve(curve, slope), 1.0
            while (new := cost(weight - size * move)) > now and size > 1e-6:
                size /= 2
            weight = weight - size * move
            if now - new < 1e-9 * max(1, abs(now)):
                break
            now = new
    return Logistic(centre, scale, weight)
