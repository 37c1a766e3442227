"""The binomial bound of a rate, for whole columns at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 400) -> np.ndarray:
    """the regularised incomplete beta function I_x(a, b), by its continued fraction."""
    turned = x > (a + 1) / (a + b + 2)  # the fraction converges fast below the mean
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    logs = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a.tolist(), b.tolist())])
    front = np.exp(logs + a * np.log(np.maximum(x, _TINY)) + b * np.log(np.maximum(1 - x, _TINY))) / a
    safe = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, steps):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + term * d), safe(1 + term / c)
            change = c * d
            value = value * change
        if np.all(np.abs(change - 1) < 1e-15):
            break
    share = front * value
    return np.where(turned, 1 - share, share)


def upper_bound(misses: np.ndarray, n: np.ndarray, level: float = 0.95) -> np.ndarray:
    """The rate at which `misses` or fewer of n would have probability 1 - level; 1 where all were missed."""
    k, n = misses.astype(float), n.astype(float)
    low, high = np.zeros(len(k)), np.ones(len(k))
    whole = k >= n
    a, b = np.where(whole, 1.0, k + 1), np.where(whole, 1.0, n - k)
    for _ in range(60):
        middle = (low + high) / 2
        under = beta_share(a, b, middle) < level
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return np.where(whole, 1.0, high)


def miss_bound(misses: Column, n: Column, level: float = 0.95) -> Column:
    """The one-sided upper Clopper-Pearson bound of a miss rate; null without cases. Without misses it has a closed form."""

    @F.pandas_udf("double")
    def bound(k: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(upper_bound(k.to_numpy(), total.to_numpy(), level))

    return F.when(n > 0, F.when(misses == 0, 1 - F.pow(F.lit(1 - level), 1 / n)).otherwise(bound(misses.cast("int"), F.greatest(n, F.lit(1)).cast("int"))))
