"""Exact p values that no SQL engine here has, as Arrow-batched functions over small tables of test statistics."""

from __future__ import annotations

from math import lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def mcnemar_p(b: int, c: int) -> float:
    """Two-sided exact binomial p (one half) of ``b`` against ``c`` discordant pairs; 1 when there are none."""
    n, k = b + c, min(b, c)
    if not n:
        return 1.0
    i = np.arange(k, max(0, k - int(40 * n**0.5)), -1, dtype=float)  # below that, terms are under exp(-3000) of the first
    steps = np.concatenate([[0.0], np.cumsum(np.log(i) - np.log(n - i + 1))])
    first = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2)
    return float(min(1.0, 2 * min(0.5, np.exp(first) * np.exp(steps).sum())))


def student_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-tailed p of Student's t: the incomplete beta integral I_x(df/2, 1/2), x = df / (df + t^2), by Lentz's continued fraction."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    x = df / (df + t * t)
    turn = x > (df / 2 + 1) / (df / 2 + 2.5)
    a, b = np.where(turn, 0.5, df / 2), np.where(turn, df / 2, 0.5)
    y = np.where(turn, 1 - x, x)
    front = np.array([lgamma(p + q) - lgamma(p) - lgamma(q) for p, q in zip(a, b)]) if t.size else np.zeros(0)
    with np.errstate(divide="ignore"):
        front = np.exp(front + a * np.log(y) + b * np.log1p(-y)) / a
    c, d = np.ones_like(y), 1 / _away(1 - (a + b) * y / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for over in (m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _away(1 + over * d)
            c = _away(1 + over / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    p = front * h
    return np.where(turn, 1 - p, p)


def _away(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e-300, 1e-300, x)


@pandas_udf(DoubleType())
def mcnemar(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([mcnemar_p(int(x), int(y)) for x, y in zip(b, c)])


@pandas_udf(DoubleType())
def student(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_p(t.to_numpy(), df.to_numpy()))
