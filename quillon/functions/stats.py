"""Tail probabilities and quantiles, as Python functions and as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.config import InputError


def normal_two_sided(z: float | None) -> float | None:
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def chi_square_tail(x: float, df: int) -> float:
    """P(X >= x): the finite sums that hold for whole degrees of freedom."""
    if df < 1:
        raise InputError("degrees of freedom have to be at least 1")
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2:
        out, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
        for i in range((df - 1) // 2):
            out += term
            term *= half / (i + 1.5)
        return min(1.0, out)
    term = out = math.exp(-half)
    for i in range(1, df // 2):
        term *= half / i
        out += term
    return min(1.0, out)


def quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def critical(confidence: float) -> float:
    """The two-sided critical value of a confidence level."""
    if not 0 < confidence < 1:
        raise InputError("the confidence level has to be between 0 and 1")
    return quantile(0.5 + confidence / 2)


def erfc(x: Column) -> Column:
    """The complementary error function of a column of numbers >= 0.

    Below 2.5 by the series of erf, above by its continued fraction from the far end; both folds run in the JVM
    and agree with a double's precision.
    """
    sq = x * x
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(x.alias("term"), x.alias("sum")), lambda a, n: F.struct((a["term"] * sq * 2 / (n * 2 + 1)).alias("term"), (a["sum"] + a["term"] * sq * 2 / (n * 2 + 1)).alias("sum")))["sum"]
    far = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda t, k: x + (k / F.lit(2.0)) / t)
    return F.when(x < 2.5, 1 - 2 / math.sqrt(math.pi) * F.exp(-sq) * series).otherwise(F.exp(-sq) / (math.sqrt(math.pi) * far))


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a z column; null for null."""
    return F.when(z.isNotNull(), erfc(F.abs(z) / math.sqrt(2)))


def chi_square_p(x: Column, df: Column) -> Column:
    """Upper tail for whole degrees of freedom of at least 1."""
    half = x / 2
    odd = (df % 2) == 1
    first = F.when(odd, F.exp(-half) * F.sqrt(half) / math.gamma(1.5)).otherwise(F.exp(-half))
    count = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    total = F.aggregate(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), F.struct(first.alias("term"), F.lit(0.0).alias("sum")), lambda a, i: F.struct((a["term"] * half / F.when(odd, i + 1.5).otherwise(i + 1.0)).alias("term"), (a["sum"] + a["term"]).alias("sum")))["sum"]
    return F.when(x <= 0, 1.0).when(x.isNotNull(), F.least(F.lit(1.0), F.when(odd, erfc(F.sqrt(half))).otherwise(0.0) + total))
