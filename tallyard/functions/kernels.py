"""Numerics that Spark's functions lack, as Arrow-batched functions and driver-free grouped kernels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def poisson_binomial(q: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The distribution of the sum of independent 0/1 variables: ``times[i]`` of them with probability ``q[i]``.

    The characteristic function is inverted by one FFT, so the cost is n log n
    whatever the number of variables; equal probabilities are taken together.
    """
    n = int(times.sum())
    t = np.exp(2j * np.pi * np.arange(n + 1) / (n + 1))
    f = np.ones(n + 1, dtype=complex)
    for p, k in zip(q, times):
        f *= np.power(1 - p + p * t, int(k))
    return np.clip(np.fft.fft(f).real / (n + 1), 0, None)


def exact_tails(q: np.ndarray, times: np.ndarray, seen: float) -> tuple[float, float]:
    """(two-sided p about the mean, p of at least ``seen``) of the Poisson-binomial sum, tolerance 1e-9."""
    pmf = poisson_binomial(q, times)
    x = np.arange(len(pmf))
    mean = float((q * times).sum())
    far = np.abs(x - mean) >= abs(seen - mean) - 1e-9
    return float(min(1.0, pmf[far].sum())), float(min(1.0, pmf[x >= seen - 1e-9].sum()))


def _beta_cf(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


def beta_inv(a: float, b: float, p: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_inc(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson_interval(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    e = (1 - level) / 2
    return (0.0 if k == 0 else beta_inv(k, n - k + 1, e)), (1.0 if k == n else beta_inv(k + 1, n - k, 1 - e))


_PAIR = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])


@F.pandas_udf(_PAIR)
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clopper_pearson_interval(int(a), int(b)) for a, b in zip(k, n)], columns=["low", "high"])


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or x != x else beta_inc(d / 2, 0.5, d / (d + x * x)) for x, d in zip(t, df)], dtype="float64")
