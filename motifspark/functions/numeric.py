"""Small numeric helpers on the driver: nothing here grows with the data."""
from __future__ import annotations

import math

import numpy as np


def digamma(x: float) -> float:
    """Recurrence up to 6, then the asymptotic series."""
    if x <= 0:
        raise ValueError("digamma needs x > 0")
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def power(base: int, exponent: int) -> int:
    return base**exponent


def posterior(log_likelihoods: list[float], epsilon: float = 1e-15) -> np.ndarray:
    """Softmax in which terms below ``epsilon`` / N of the largest count as zero; the given order stays."""
    ll = np.asarray(log_likelihoods, dtype=float)
    d = ll - ll.max()
    w = np.where(d >= math.log(epsilon) - math.log(len(ll)), np.exp(d), 0.0)
    return w / w.sum()


def argsort(values: list[float]) -> np.ndarray:
    return np.argsort(np.asarray(values), kind="stable")
