"""Sums, products and fits over array columns, as higher-order functions inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literals(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def magnitudes(a: Column) -> Column:
    return F.transform(a, F.abs)


def entropy(a: Column, floor: float) -> Column:
    """Shannon entropy in nats of the shares of a, each raised by `floor` and scaled again; 0 if a's sum is not above it."""
    sum_a = total(a)
    n = F.size(a)
    share = F.transform(a, lambda x: (x / sum_a + floor) / (1 + floor * n))
    return F.when(sum_a > floor, -total(F.transform(share, lambda p: p * F.ln(p)))).otherwise(0.0)


def correlation(a: Column, b: Column, floor: float) -> Column:
    """Pearson's correlation of two arrays of one length; 0 if either has a population deviation of at most `floor`."""
    ma, mb = mean(a), mean(b)
    da, db = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
    va, vb = dot(da, da), dot(db, db)
    flat = (F.sqrt(va / F.size(a)) <= floor) | (F.sqrt(vb / F.size(b)) <= floor)
    return F.when(flat, 0.0).otherwise(dot(da, db) / F.sqrt(va * vb))


def ordinal_pattern(a: Column) -> Column:
    """The positions of a's values from least to greatest, as a text; of equal values the earlier comes first."""
    placed = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.array_join(F.transform(F.array_sort(placed), lambda p: p["i"].cast("string")), ",")
