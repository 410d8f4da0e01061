"""Special functions in numpy, for laws that have no closed form in SQL."""

from __future__ import annotations

import math

import numpy as np


def digamma(x: float) -> float:
    """Recurrence up to 6, then the asymptotic series."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def gamma_lower(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    x = np.maximum(np.asarray(x, float), 0)
    scale = np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - math.lgamma(a))
    term = np.full(x.shape, 1 / a)
    total, near = term.copy(), np.minimum(x, a + 1)
    for k in range(1, 400):
        term = term * near / (a + k)
        total += term
    far = np.maximum(x, a + 1)
    b = far + 1 - a
    c, d = np.full(x.shape, 1e300), 1 / b
    h = d.copy()
    for k in range(1, 200):
        an = -k * (k - a)
        b = b + 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
    return np.where(x == 0, 0.0, np.where(x < a + 1, scale * total, 1 - scale * h))


def gamma_shape(mean: float, mean_log: float) -> float:
    """Maximum-likelihood shape from the mean and the mean logarithm, by Newton's method."""
    s = math.log(mean) - mean_log
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s) if s > 0 else 1e6
    for _ in range(50):
        step = (math.log(k) - digamma(k) - s) / (1 / k - trigamma(k))
        k = max(k - step, k / 2)
        if abs(step) < 1e-12 * k:
            break
    return k
