"""Tail probabilities that Spark SQL lacks, for the few rows a statistics table has."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi2_tail_1(x: Column) -> Column:
    """P(chi-square with one degree of freedom > x) = erfc(sqrt(x / 2)); stays in the JVM.

    Small values take the series of erf, large ones the continued fraction of erfc, which keeps its digits in the far tail.
    """
    z = F.sqrt(x / 2.0)
    square = z * z
    # erf(z) = 2 z exp(-z^2) / sqrt(pi) * sum_k (2 z^2)^k / (1*3*5*...*(2k+1)), all terms positive
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * 2.0 * square / (2 * k + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, step)["total"]
    erf = 2.0 / math.sqrt(math.pi) * z * F.exp(-square) * total
    # erfc(z) = exp(-z^2) / (z sqrt(pi)) / (1 + q / (1 + 2 q / (1 + 3 q / ...))) with q = 1 / (2 z^2), from the back
    below = F.aggregate(F.sequence(F.lit(120), F.lit(1)), F.lit(1.0), lambda acc, k: 1.0 + k / (2.0 * square) / acc)
    far = F.exp(-square) / (z * math.sqrt(math.pi)) / below
    return F.when(z < 2.0, F.greatest(F.lit(0.0), 1.0 - erf)).otherwise(far)


def _unconverged(name: str) -> ArithmeticError:
    return ArithmeticError(f"{name} did not converge")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the front."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d or tiny)
    out = d
    for m in range(1, 100 + 20 * int(math.sqrt(max(a, b)) + 1)):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / ((1.0 + term * d) or tiny)
            c = (1.0 + term / c) or tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return out
    raise _unconverged("the incomplete beta function")


def _log_half_step(a: float) -> float:
    """log of Gamma(a + 1/2) / Gamma(a); by Stirling's series where the difference of logarithms would lose digits."""
    if a < 100:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)


def _beta_half(a: float, ratio: float) -> float:
    """Incomplete beta function with second parameter 1/2 at x = 1 / (1 + ratio)."""
    if ratio <= 0.0:
        return 1.0
    x, y = 1.0 / (1.0 + ratio), ratio / (1.0 + ratio)
    log_front = _log_half_step(a) - 0.5 * math.log(math.pi) - a * math.log1p(ratio) + 0.5 * math.log(y)
    if x < (a + 1.0) / (a + 2.5):
        return math.exp(log_front) * _beta_fraction(a, 0.5, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(0.5, a, y) / 0.5


def _t_two_sided(t: float, dof: float) -> float:
    if math.isnan(t) or math.isnan(dof) or dof <= 0:
        return math.nan
    if dof > 1e6:  # the normal tail at Wallace's point, right to some 1/dof^2
        z = (8 * dof + 1) / (8 * dof + 3) * math.sqrt(dof * math.log1p(t * t / dof))
        return math.erfc(z / math.sqrt(2.0))
    return _beta_half(dof / 2.0, t * t / dof)


def _t_quantile(level: float, dof: float) -> float:
    """The t with two-sided tail 1 - level, by bisection."""
    if math.isnan(dof) or dof <= 0:
        return math.nan
    low, high = 0.0, 1.0
    while _t_two_sided(high, dof) > 1.0 - level:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if _t_two_sided(middle, dof) > 1.0 - level:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def _chi2_upper(x: float, dof: float) -> float:
    """Upper tail of chi-square by the series or continued fraction of the incomplete gamma."""
    if math.isnan(x) or dof <= 0:
        return math.nan
    a, z = dof / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    if a < 100:
        front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    else:  # z^a exp(-z) / Gamma(a) by Stirling's series, around z = a
        off = (z - a) / a
        bend = off - math.log1p(off)
        front = math.exp(-a * bend + 0.5 * math.log(a / (2 * math.pi)) - 1 / (12 * a) + 1 / (360 * a**3))
    if z < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= z / k
            total += term
        return 1.0 - front * total
    b, c = z + 1.0 - a, 1e300
    d = 1.0 / b
    out = d
    for i in range(1, 1000 + 20 * int(math.sqrt(a) + 1)):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / ((step * d + b) or 1e-300)
        c = (b + step / c) or 1e-300
        out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return front * out
    raise _unconverged("the incomplete gamma function")


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    return pd.Series([_t_two_sided(float(a), float(b)) for a, b in zip(t, dof)])


@F.pandas_udf(T.DoubleType())
def t_quantile_95(dof: pd.Series) -> pd.Series:
    """Half-width factor of a 95% t-interval."""
    return pd.Series([_t_quantile(0.95, float(d)) for d in dof])


@F.pandas_udf(T.DoubleType())
def chi2_upper(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of a chi-square statistic with any degrees of freedom."""
    return pd.Series([_chi2_upper(float(a), float(b)) for a, b in zip(x, dof)])
