"""Logistic regression on sparse rows, for models fitted to bounded samples on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


#: Rows that are worked at once, so that temporary arrays stay small.
BLOCK = 2_000


def fit(sizes: np.ndarray, column: np.ndarray, value: np.ndarray, target: np.ndarray, weight: np.ndarray, columns: int, *, l2: float, rounds: int = 150, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """(weights, bias) by Adam over all rows at once; ``target`` may be any probability. Deterministic.

    Rows lie one after another in ``column`` and ``value``, ``sizes`` long each.
    """
    w, b = np.zeros(columns), 0.0
    m, v = np.zeros(columns + 1), np.zeros(columns + 1)
    total = max(weight.sum(), 1e-12)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for step in range(1, rounds + 1):
        g = np.append(l2 * w, 0.0)
        for i in range(0, len(target), BLOCK):
            part = slice(i, i + BLOCK)
            rows = len(target[part])
            at = slice(ends[i], ends[i + rows])
            row = np.repeat(np.arange(rows), sizes[part])
            score = np.bincount(row, weights=w[column[at]] * value[at], minlength=rows) + b
            slope = weight[part] * (sigmoid(score) - target[part]) / total
            g[:-1] += np.bincount(column[at], weights=slope[row] * value[at], minlength=columns)
            g[-1] += slope.sum()
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, float(b)
