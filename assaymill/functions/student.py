"""Student t critical value and two-sided p, on already aggregated rows.

Spark has no t distribution. Both functions are evaluated once per result row
of an aggregation (one per group), never per input row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tail(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(|T| > t) by the continued fraction of the incomplete beta function."""
    x = dof / (dof + t * t)
    a, b = dof / 2.0, np.full_like(dof, 0.5)
    # The fraction converges fast only below the mean; mirror it above.
    swap = x > (a + 1.0) / (a + b + 2.0)
    xs, p, q = np.where(swap, 1.0 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    ln_beta = np.array([math.lgamma(u) + math.lgamma(v) - math.lgamma(u + v) for u, v in zip(p, q)])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(xs) + q * np.log1p(-xs) - ln_beta) / p
    c = np.ones_like(xs)
    tiny = 1e-300
    d = 1.0 / np.where(np.abs(1.0 - (p + q) * xs / (p + 1.0)) < tiny, tiny, 1.0 - (p + q) * xs / (p + 1.0))
    value = d.copy()
    for m in range(1, 400):
        even = m * (q - m) * xs / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * xs / ((p + 2 * m) * (p + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / np.where(np.abs(1.0 + term * d) < tiny, tiny, 1.0 + term * d)
            c = np.where(np.abs(1.0 + term / c) < tiny, tiny, 1.0 + term / c)
            value = value * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    part = np.where(xs <= 0.0, 0.0, front * value)
    return np.clip(np.where(swap, 1.0 - part, part), 0.0, 1.0)


def two_sided_p(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    t, dof = np.abs(np.asarray(t, float)), np.asarray(dof, float)
    ok = np.isfinite(t) & (dof > 0)
    out = np.full(t.shape, np.nan)
    if ok.any():
        out[ok] = _tail(t[ok], dof[ok])
    return out


def critical_value(confidence: float, dof: np.ndarray) -> np.ndarray:
    """Bisection on the tail probability."""
    dof = np.asarray(dof, float)
    out = np.full(dof.shape, np.nan)
    ok = dof > 0
    if ok.any():
        d = dof[ok]
        lo, hi = np.zeros_like(d), np.full_like(d, 1e9)
        for _ in range(90):
            mid = np.where(hi - lo > 1.0, np.sqrt((lo + 1e-9) * hi), (lo + hi) / 2.0)
            above = _tail(mid, d) > 1.0 - confidence
            lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
        out[ok] = (lo + hi) / 2.0
    return out


def t_critical(confidence: float):
    @F.pandas_udf(T.DoubleType())
    def udf(dof: pd.Series) -> pd.Series:
        return pd.Series(critical_value(confidence, dof.to_numpy(dtype=float)))

    return udf


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(two_sided_p(t.to_numpy(dtype=float), dof.to_numpy(dtype=float)))
