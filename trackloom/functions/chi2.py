"""The upper tail of the chi-squared distribution, for whole arrays and columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lower regularised incomplete gamma function by its power series; for x < a + 1."""
    term = 1 / a
    total, k = term.copy(), a.copy()
    for _ in range(10_000):
        k = k + 1
        term = term * x / k
        total += term
        if (np.abs(term) <= np.abs(total) * 1e-16).all():
            break
    return total * np.exp(a * np.log(x) - x - _lgamma(a).astype(float))


def _fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma function by its continued fraction; for x >= a + 1."""
    b = x + 1 - a
    c = np.full_like(x, 1 / _TINY)
    d = 1 / b
    h = d.copy()
    for i in range(1, 10_000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        step = c * d
        h *= step
        if (np.abs(step - 1) < 1e-15).all():
            break
    return h * np.exp(a * np.log(x) - x - _lgamma(a).astype(float))


def upper_tail(chi2: np.ndarray, ndf: np.ndarray) -> np.ndarray:
    """P(X > chi2); 0 for ndf <= 0 or chi2 < 0, 1 for chi2 = 0."""
    chi2, ndf = np.broadcast_arrays(np.asarray(chi2, float), np.asarray(ndf, float))
    out = np.where((ndf > 0) & (chi2 == 0), 1.0, 0.0)
    ok = (ndf > 0) & (chi2 > 0)
    a, x = ndf / 2, chi2 / 2
    low, high = ok & (x < a + 1), ok & (x >= a + 1)
    if low.any():
        out[low] = 1 - _series(a[low], x[low])
    if high.any():
        out[high] = _fraction(a[high], x[high])
    return np.where(np.isnan(chi2) | np.isnan(ndf), np.nan, np.clip(out, 0, 1))


@F.pandas_udf(DoubleType())
def prob(chi2: pd.Series, ndf: pd.Series) -> pd.Series:
    """``upper_tail`` as a column; null where an argument is."""
    out = pd.Series(upper_tail(chi2.to_numpy(float, na_value=np.nan), ndf.to_numpy(float, na_value=np.nan)))
    return out.where(chi2.notna().to_numpy() & ndf.notna().to_numpy())
