"""Special functions that Spark SQL lacks, vectorised in numpy, and as Arrow UDFs."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Coefficients of Stirling's series for ln gamma, B(2n) / (2n (2n - 1)), fixed values.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0: raised to at least 8 by the recurrence, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift = np.where(low, shift + np.log(np.where(low, x, 1)), shift)
        x = np.where(low, x + 1, x)
    series = sum(c / x ** (2 * i + 1) for i, c in enumerate(_STIRLING))
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, on the side where that converges quickly."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    z = np.clip(z, 0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        h = d.copy()
        for m in range(1, rounds):
            for term in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + term * d
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = 1 + term / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                h = h * c * d
            if np.all(np.abs(c * d - 1) < 1e-15):
                break
        got = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(swap, 1 - got, got)


def nb_cdf(y: np.ndarray, alpha: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """P(Y <= y) of the negative binomial with mean mu and variance mu + mu^2 / alpha; 0 below 0."""
    y, alpha, mu = (np.asarray(v, float) for v in (y, alpha, mu))
    got = betainc(alpha, np.floor(np.maximum(y, 0)) + 1, alpha / (alpha + mu))
    return np.where(y < 0, 0.0, got)


def nb_quantile(q: float, alpha: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """The smallest count whose cdf reaches q, by bisection over counts."""
    alpha, mu = np.asarray(alpha, float), np.asarray(mu, float)
    high = np.ceil(mu + 10 * np.sqrt(mu + mu * mu / alpha) + 10)
    while np.any(nb_cdf(high, alpha, mu) < q):
        high = np.where(nb_cdf(high, alpha, mu) < q, 2 * high, high)
    low = np.full_like(high, -1)
    while np.any(high - low > 1):
        mid = np.floor((low + high) / 2)
        over = nb_cdf(mid, alpha, mu) >= q
        high, low = np.where(over & (high - low > 1), mid, high), np.where(~over & (high - low > 1), mid, low)
    return high


def normal_quantile(p: np.ndarray) -> np.ndarray:
    inv = NormalDist().inv_cdf
    return np.array([inv(v) if 0 < v < 1 else np.nan for v in np.asarray(p, float)])


def _kept(known: pd.Series, f) -> pd.Series:
    """``f`` on the rows that are known, null elsewhere."""
    out = pd.Series(np.nan, index=known.index, dtype=float)
    if known.any():
        out[known] = f(known)
    return out.where(known, None)


@F.pandas_udf(DoubleType())
def nb_cdf_udf(y: pd.Series, alpha: pd.Series, mu: pd.Series) -> pd.Series:
    return _kept(y.notna() & alpha.notna() & mu.notna(), lambda k: nb_cdf(y[k], alpha[k], mu[k]))


@F.pandas_udf(DoubleType())
def mid_z_udf(y: pd.Series, alpha: pd.Series, mu: pd.Series) -> pd.Series:
    """Normal score of the middle of the count's probability step, clipped at 1e-6 from either end."""

    def score(k):
        mid = (nb_cdf(y[k] - 1, alpha[k], mu[k]) + nb_cdf(y[k], alpha[k], mu[k])) / 2
        return normal_quantile(np.clip(mid, 1e-6, 1 - 1e-6))

    return _kept(y.notna() & alpha.notna() & mu.notna(), score)


@F.pandas_udf(DoubleType())
def lgamma_udf(x: pd.Series) -> pd.Series:
    return _kept(x.notna(), lambda k: lgamma(x[k]))


def nb_quantile_udf(q: float):
    @F.pandas_udf(DoubleType())
    def run(alpha: pd.Series, mu: pd.Series) -> pd.Series:
        return _kept(alpha.notna() & mu.notna(), lambda k: nb_quantile(q, alpha[k], mu[k]))

    return run
