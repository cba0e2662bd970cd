"""Window expressions with the null rules of time-series work: a frame gives a value only if it holds enough readings."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def guarded(value: Column, of: Column, frame: WindowSpec, least: int) -> Column:
    """``value`` (an aggregate over ``frame``) where the frame has at least ``least`` non-null readings of ``of``."""
    return F.when(F.count(of).over(frame) >= least, value)


def rolling_mean(c: Column, order: WindowSpec, n: int, least: int | None = None) -> Column:
    w = order.rowsBetween(-(n - 1), 0)
    return guarded(F.avg(c).over(w), c, w, least or n)


def rolling_sum(c: Column, order: WindowSpec, n: int, least: int | None = None) -> Column:
    w = order.rowsBetween(-(n - 1), 0)
    return guarded(F.sum(c).over(w), c, w, least or n)


def rolling_std(c: Column, order: WindowSpec, n: int) -> Column:
    """Sample deviation (n - 1 in the denominator)."""
    w = order.rowsBetween(-(n - 1), 0)
    return guarded(F.stddev_samp(c).over(w), c, w, n)


def rolling_median(c: Column, order: WindowSpec, n: int) -> Column:
    w = order.rowsBetween(-(n - 1), 0)
    return guarded(F.percentile(c, 0.5).over(w), c, w, n)


def rolling_any(flag: Column, order: WindowSpec, n: int) -> Column:
    w = order.rowsBetween(-(n - 1), 0)
    return guarded(F.bool_or(flag).over(w), flag, w, n)


def slope(c: Column, order: WindowSpec, n: int) -> Column:
    """Least-squares slope of the last n readings against 0..n-1; null if any of them is null. Its weights are fixed, so it
    is a sum of lags in closed form."""
    mean = (n - 1) / 2
    spread = sum((i - mean) ** 2 for i in range(n))
    total = None
    for back in range(n):
        weight = ((n - 1 - back) - mean) / spread
        term = F.lag(c, back).over(order) * F.lit(weight)
        total = term if total is None else total + term
    return total


def average_rank(value: Column, partition: WindowSpec, by_value: WindowSpec, ties: WindowSpec) -> Column:
    """Rank from 1, tied values sharing the mean of theirs; nulls have none and count for nothing.

    partition: the cross section; by_value: it in order of value (nulls last); ties: it split by value."""
    return F.when(value.isNotNull(), F.rank().over(by_value) + (F.count(value).over(ties) - 1) / F.lit(2.0))


def percentile_midrank(value: Column, history: Column, least: int, fallback: float = 50.0) -> Column:
    """100 x (values below + half of those equal) / values of ``history`` (an array without nulls); ``fallback`` if short."""
    n = F.size(history)
    below = F.size(F.filter(history, lambda h: h < value))
    equal = F.size(F.filter(history, lambda h: h == value))
    return F.when(value.isNull(), None).when(n < least, F.lit(fallback)).otherwise(F.lit(100.0) * (below + equal / F.lit(2.0)) / n)


def run_id(starts: Column, order: WindowSpec) -> Column:
    """Number of the unbroken run a row belongs to, from a flag that marks first rows (gaps and islands)."""
    return F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(-(2**62), 0))
