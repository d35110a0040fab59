"""Statistics formulas over aggregates."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

LARGE_DF = 20_000


def sample_skew(c: Column) -> Column:
    """Bias-corrected skew (G1); null under three values."""
    n = F.count(c)
    g1 = F.skewness(c)
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis (G2); null under four values."""
    n = F.count(c)
    g2 = F.kurtosis(c)
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0))


def k_squared(n: Column, g1: Column, g2: Column) -> Column:
    """D'Agostino-Pearson statistic from the population skew and excess kurtosis."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    z_skew = F.asinh(y / F.sqrt(2.0 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    mean_b2 = 3.0 * (n - 1) / (n + 1)
    var_b2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean_b2) / F.sqrt(var_b2)
    root_b1 = (
        6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6.0 + 8.0 / root_b1 * (2.0 / root_b1 + F.sqrt(1 + 4.0 / (root_b1 * root_b1)))
    inner = (1 - 2.0 / a) / (1 + x * F.sqrt(2.0 / (a - 4.0)))
    cube = F.signum(inner) * F.pow(F.abs(inner), F.lit(1 / 3))
    z_kurt = (1 - 2.0 / (9.0 * a) - cube) / F.sqrt(2.0 / (9.0 * a))
    return z_skew * z_skew + z_kurt * z_kurt


def normal_quantile(confidence: float) -> float:
    """Two-sided z of a confidence level."""
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    root = F.sqrt(n1.cast("double") * n2 / (n1 + n2))
    lam = root * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(k * k * lam * lam * -2.0),
    )
    # for small lambda the theta-function form converges, the series above does not
    theta = F.aggregate(
        F.sequence(F.lit(1), F.lit(4)),
        F.lit(0.0),
        lambda total, k: total + F.exp((k * 2 - 1) * (k * 2 - 1) * (-math.pi**2) / (lam * lam * 8)),
    )
    small = theta * math.sqrt(2 * math.pi) / lam
    p = F.when(lam < 1e-9, 1.0).when(lam < 0.6, 1.0 - small).otherwise(2 * series)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of chi-square.

    Half-integer or integer terms of the incomplete gamma function are summed
    in logs; above LARGE_DF degrees of freedom the cube-root normal form is used.
    """
    half = x / 2.0
    odd = F.pmod(df, F.lit(2)) == 1
    steps = F.floor(F.least(df, F.lit(LARGE_DF)) / 2.0).cast("int")
    start = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    log_half = F.log(F.greatest(half, F.lit(1e-300)))
    first = F.when(odd, -half + 0.5 * log_half - math.lgamma(1.5)).otherwise(-half)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
        F.struct(first.alias("log"), F.lit(0.0).alias("sum")),
        lambda acc, j: F.struct(
            (acc["log"] + log_half - F.log(j + start)).alias("log"), (acc["sum"] + F.exp(acc["log"])).alias("sum")
        ),
        lambda acc: acc["sum"],
    )
    exact = F.when(odd, erfc(F.sqrt(half)) + F.when(steps > 0, terms).otherwise(0.0)).otherwise(terms)
    spread = 2.0 / (9.0 * df)
    z = (F.cbrt(x / df) - (1 - spread)) / F.sqrt(spread)
    tail = 0.5 * erfc(F.abs(z) / math.sqrt(2))
    wide = F.when(z >= 0, tail).otherwise(1 - tail)
    return F.when(x <= 0, 1.0).when(df > LARGE_DF, wide).otherwise(exact)


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0: Maclaurin series, then continued fraction."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(z.alias("t"), z.alias("s")),
        lambda acc, k: F.struct(
            (-acc["t"] * z * z / k).alias("t"),
            (acc["s"] - acc["t"] * z * z / k / (2 * k + 1)).alias("s"),
        ),
        lambda acc: acc["s"],
    )
    tail = F.aggregate(
        F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda acc, k: z + (k / 2.0) / acc
    )
    return F.when(z < 2.5, 1.0 - series * (2 / math.sqrt(math.pi))).otherwise(
        F.exp(-z * z) / (tail * math.sqrt(math.pi))
    )
