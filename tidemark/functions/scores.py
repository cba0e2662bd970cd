"""Weighted scores over parts that may be missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_score(weights: dict[str, float]) -> Column:
    """Mean of the columns by weight, over those that are there: the weights of nulls fall away and the others grow in
    proportion. Null if all are."""
    add = lambda a, b: a + b
    total = reduce(add, [F.coalesce(F.col(c) * F.lit(w), F.lit(0.0)) for c, w in weights.items()])
    there = reduce(add, [F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in weights.items()])
    return F.when(there > 0, total / there)


def clamp(c: Column, low: float, high: float) -> Column:
    """Into [low, high]; null stays null, NaN becomes null."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.least(F.greatest(c, F.lit(low)), F.lit(high)))
