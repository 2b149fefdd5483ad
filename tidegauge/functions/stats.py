"""Student-t and related functions: none of them is built into Spark."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    fix = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1 / fix(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / fix(1 + top * d)
            c = fix(1 + top / c)
            h = h * d * c
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        near = front * _beta_fraction(a, b, x) / a
        far = 1 - front * _beta_fraction(b, a, 1 - x) / b
    out = np.where(x < (a + 1) / (a + b + 2), near, far)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|); NaN where df is not positive."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    ok = (df > 0) & ~np.isnan(t)
    safe = np.where(ok, df, 1.0)
    return np.where(ok, incomplete_beta(safe / 2, 0.5, safe / (safe + np.where(ok, t, 0.0) ** 2)), np.nan)


def t_quantile(p: float, df) -> np.ndarray:
    """The t with P(T <= t) = p, for p over 1/2, by bisection."""
    df = np.asarray(df, float)
    low, high = np.zeros_like(df), np.full_like(df, 1e6)
    for _ in range(200):
        middle = (low + high) / 2
        under = 1 - t_two_sided(middle, df) / 2 < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return np.where(df > 0, (low + high) / 2, np.nan)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float))).where(lambda s: s.notna(), None)


@F.pandas_udf(DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    """97.5 % quantile of Student's t."""
    return pd.Series(t_quantile(0.975, df.to_numpy(float))).where(lambda s: s.notna(), None)


def wilson(k: Column, n: Column, z: Column | float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of k successes of n; exactly 0 at k = 0 and 1 at k = n; null at n = 0."""
    z = z if isinstance(z, Column) else F.lit(z)
    p = F.try_divide(k.cast("double"), n)
    den = 1 + F.try_divide(z * z, n)
    mid = (p + F.try_divide(z * z, 2 * n)) / den
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(z * z, 4 * n * n)) / den
    low = F.when(k <= 0, F.when(n > 0, 0.0)).otherwise(F.greatest(F.lit(0.0), mid - half))
    high = F.when(k >= n, F.when(n > 0, 1.0)).otherwise(F.least(F.lit(1.0), mid + half))
    return low, high
