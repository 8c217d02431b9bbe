"""Comparison of histograms kept as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two equally long arrays; 1 when either is constant."""
    n = F.size(a)
    products = F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double"))
    square = lambda h: _total(F.transform(h, lambda v: v.cast("double") * v.cast("double")))
    covariance = _total(products) - _total(a) * _total(b) / n
    spread = (square(a) - _total(a) * _total(a) / n) * (square(b) - _total(b) * _total(b) / n)
    return F.when(F.abs(spread) <= 2.220446049250313e-16, 1.0).otherwise(covariance / F.sqrt(spread))
