"""Scalar rules that the operators share: what counts as missing, guarded ratios, links and moments."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Null for NaN and the infinities."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clip(c: Column, low, high) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a, b))


def quotient(a: Column, b: Column) -> Column:
    """a / b as IEEE arithmetic has it: by 0 an infinity, of the other sign by minus 0, 0 / 0 NaN."""
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, a * F.pow(b, F.lit(-1.0)))


def log(c: Column, zeros: bool = False) -> Column:
    """Null unless c is positive; with `zeros`, as IEEE arithmetic has it: minus infinity where c is 0, NaN below."""
    positive = F.when(c > 0, F.ln(c))
    return positive.when(c == 0, float("-inf")).when(c < 0, float("nan")) if zeros else positive


def rounded_half(c: Column, places: int) -> Column:
    """Half away from zero, decided on c * 10^places in floating point as SQL engines do; F.round decides on the shortest decimal form."""
    scale = 10.0**places
    out = F.round(c * scale) / scale
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), c).otherwise(out)


def correlation(x: Column, y: Column) -> Column:
    """An aggregate: Pearson's correlation of the rows where neither is null; null where either is constant, which Spark's own raises for in ANSI mode."""
    sd = lambda a, b: F.stddev_pop(F.when(b.isNotNull(), a))
    return F.try_divide(F.covar_pop(x, y), F.nullif(sd(x, y) * sd(y, x), F.lit(0.0)))


def sample_skewness(population: Column, n: Column) -> Column:
    """The bias-adjusted skewness from the population skewness of n values; null below three."""
    return F.when(n >= 3, population * F.sqrt(n * (n - 1)) / (n - 2))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normal_logpdf(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return -0.5 * z * z - F.ln(sd) - 0.5 * math.log(2 * math.pi)


def log_sum_exp(a: Column) -> Column:
    """Over an array, shifted by its greatest value."""
    top = F.array_max(a)
    return top + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def softmax(a: Column) -> Column:
    lse = log_sum_exp(a)
    return F.transform(a, lambda x: F.exp(x - lse))
