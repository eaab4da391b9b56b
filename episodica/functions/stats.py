"""Ratios, intervals and draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054


def rate(num: Column, den: Column) -> Column:
    """num / den; null on zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null for n = 0."""
    p, m = rate(k, n), n.cast("double")
    d = 1 + Z * Z / m
    mid, half = p + Z * Z / (2 * m), Z * F.sqrt(p * (1 - p) / m + Z * Z / (4 * m * m))
    ok = lambda c: F.when(n > 0, c)
    return ok(F.greatest(F.lit(0.0), (mid - half) / d)), ok(F.least(F.lit(1.0), (mid + half) / d))


def balanced_accuracy(tp: Column, fn: Column, tn: Column, fp: Column) -> Column:
    return (rate(tp, tp + fn) + rate(tn, tn + fp)) / 2


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def md5_draw(key: Column, n: Column) -> Column:
    """A number below n from the first eight hex digits of a digest: the same in any engine, on any partitioning."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n
