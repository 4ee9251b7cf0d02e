"""Student-t p-values for rows that are already aggregated."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total


def regularised_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_test_p_value(r: float, n: int) -> float | None:
    """Two-sided p-value of a correlation ``r`` over ``n`` pairs, from t with n - 2 degrees."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    # x = df / (df + t^2) with t^2 = r^2 df / (1 - r^2)
    return regularised_beta((n - 2) / 2.0, 0.5, 1.0 - r * r)


@F.pandas_udf(DoubleType())
def _p_values(r: pd.Series, n: pd.Series) -> pd.Series:
    pairs = zip(r.astype(object), n)
    return pd.Series([None if pd.isna(a) else t_test_p_value(float(a), int(b)) for a, b in pairs], dtype="float64")


def spearman_p_value(ic: Column, n: Column) -> Column:
    """P-value column; meant for one row per configuration, never for raw pairs."""
    return _p_values(ic.cast("double"), n.cast("long"))
