"""Test statistics as aggregate expressions, and the Student-t p-value for small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .num import col, ratio


def t_one(x: Column | str) -> Column:
    """One-sample t against zero, as an aggregate."""
    x = col(x)
    return ratio(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x)))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation of the complete pairs; NULL when either side does not vary."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
    return ratio(F.covar_samp(x, y), spread)


def hit(x: Column | str) -> Column:
    """Share of positive values."""
    return F.avg(F.when(col(x) > 0, 1.0).when(col(x).isNotNull(), 0.0))


def ir(x: Column | str, ddof: int = 1) -> Column:
    sd = F.stddev_samp(col(x)) if ddof else F.stddev_pop(col(x))
    return ratio(F.avg(col(x)), sd)


def welch(a: Column, b: Column) -> tuple[Column, Column]:
    """(t, degrees of freedom) of two samples given as columns that are NULL outside their sample."""
    va = F.var_samp(a) / F.count(a)
    vb = F.var_samp(b) / F.count(b)
    t = ratio(F.avg(a) - F.avg(b), F.sqrt(va + vb))
    df = ratio(
        (va + vb) * (va + vb), va * va / (F.count(a) - 1) + vb * vb / (F.count(b) - 1)
    )
    return t, df


def corr_t(r: Column, n: Column, floor: float = 1e-12) -> Column:
    """t of a correlation over n pairs."""
    return r * F.sqrt(F.greatest(n - 2, F.lit(1))) / F.sqrt(F.greatest(1 - r * r, F.lit(floor)))


def profit_factor(x: Column | str) -> Column:
    """Gains over losses; NULL without losses."""
    x = col(x)
    return ratio(F.sum(F.when(x > 0, x)), -F.sum(F.when(x < 0, x)))


def bonferroni(n: Column, alpha: float = 0.05) -> Column:
    return F.lit(alpha) / F.greatest(n, F.lit(1))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    if not (math.isfinite(t) and df > 0):
        return math.nan
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """For aggregated rows only: one call per result row, never per data row."""
    return pd.Series(
        [t_two_sided(float(x), float(n)) for x, n in zip(t.fillna(np.nan), df.fillna(np.nan))]
    )
