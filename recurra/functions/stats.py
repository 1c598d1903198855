"""Distribution functions that Spark SQL lacks, as small vectorised helpers."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def z_value(alpha: float = 0.05) -> float:
    """Two-sided critical value of the standard normal distribution."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution, by the incomplete gamma function."""
    if x is None or df is None or math.isnan(x) or df <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    a, half = df / 2.0, x / 2.0
    scale = math.exp(-half + a * math.log(half) - math.lgamma(a))
    if half < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= half / n
            total += term
        return max(0.0, 1.0 - total * scale)
    # Lentz's continued fraction.
    tiny = 1e-300
    b = half + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


def chi2_p(x: Column, df: Column) -> Column:
    def tail(xs: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(float(v), float(d)) for v, d in zip(xs, dfs)])

    return F.pandas_udf(tail, "double")(x.cast("double"), df.cast("double"))


def normal_two_sided_p(z: Column) -> Column:
    def tail(zs: pd.Series) -> pd.Series:
        erfc = np.frompyfunc(math.erfc, 1, 1)
        return pd.Series(erfc(np.abs(zs.to_numpy(dtype=float)) / math.sqrt(2.0)).astype(float))

    return F.pandas_udf(tail, "double")(z)
