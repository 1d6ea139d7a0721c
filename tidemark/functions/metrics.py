"""Forecast metrics as aggregate expressions.

Each is a sum over a count, so DECIMAL inputs give the same answer whatever
order the partial sums are merged in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalar import col


def mean(x: Column) -> Column:
    return F.sum(x).cast("double") / F.count(x)


def mae(actual, predicted) -> Column:
    return mean(F.abs(col(actual) - col(predicted)))


def rmse(actual, predicted) -> Column:
    e = col(actual) - col(predicted)
    return F.sqrt(mean(e * e))


def bias(actual, predicted) -> Column:
    """Positive when the forecast runs high."""
    return mean(col(predicted) - col(actual))


def mase(actual, predicted, scale: Column) -> Column:
    """NaN where the scale is not positive, as a ratio to it means nothing."""
    s = F.max(scale)
    return F.when(s > 0, mae(actual, predicted) / s).otherwise(F.lit(float("nan")))


def pinball_loss(actual, q, tau: float) -> Column:
    """Per-row pinball loss; null when the quantile is."""
    d = col(actual).cast("double") - col(q).cast("double")
    return F.when(d.isNotNull(), F.greatest(F.lit(tau) * d, F.lit(tau - 1) * d))


def pinball(actual, q, tau: float) -> Column:
    return F.avg(pinball_loss(actual, q, tau))


def inside(actual, lo, hi) -> Column:
    return col(actual).between(col(lo), col(hi))


def coverage(actual, lo, hi) -> Column:
    hit = inside(actual, lo, hi)
    return F.sum(F.when(hit, 1).otherwise(0)) / F.count(F.when(hit.isNotNull(), 1))


def width(lo, hi) -> Column:
    return mean(col(hi) - col(lo))
