"""Bootstrap intervals whose work is spread by iteration and whose data stays where it is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def poisson_bootstrap_mean(rows: DataFrame, group: list[str], value: str, unit: list[str], iterations: int = 200, confidence: float = 0.95) -> DataFrame:
    """(group, n, mean, low, high): percentile interval of the mean.

    Each row enters each iteration as often as a Poisson(1) draw says, taken from a hash of its identity and the iteration:
    the same on every run and in any partitioning, without collecting or resampling anything. Sums per group and iteration
    combine before the shuffle, so what is shuffled has the size groups x iterations."""
    x = rows.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__x"), F.xxhash64(*unit).alias("__id"))
    draws = x.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    uniform = F.pmod(F.xxhash64("__id", "__k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # the distribution function of Poisson(1) at 0, 1, 2, ...
    steps, p, total = [], 0.36787944117144233, 0.0
    for i in range(9):
        total += p
        steps.append(total)
        p /= i + 1
    times = sum((F.when(uniform >= s, 1).otherwise(0) for s in steps), F.lit(0))
    per = draws.withColumn("__n", times).groupBy(*group, "__k").agg(F.sum(F.col("__x") * F.col("__n")).alias("__s"), F.sum("__n").alias("__c"))
    means = per.filter("__c > 0").withColumn("__m", F.col("__s") / F.col("__c"))
    tail = (1 - confidence) / 2
    bounds = means.groupBy(*group).agg(F.percentile("__m", tail).alias("low"), F.percentile("__m", 1 - tail).alias("high"))
    centre = x.groupBy(*group).agg(F.count("*").alias("n"), F.avg("__x").alias("mean"))
    return centre.join(bounds, group, "left").select(*group, "n", "mean", "low", "high")


def _ranks(n: int, seed: int, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, from 1, of the two middle draws (one and the same for odd n) in each of the resamples of n out of n.

    The k-th smallest of n uniform draws is Beta(k, n - k + 1), the next one above it the least of the n - k others: so a
    resample's middle is drawn as such, with just the distribution it has if all n are drawn."""
    rng = np.random.default_rng([seed & 0xFFFFFFFF, seed >> 32 & 0xFFFFFFFF])
    k = (n + 1) // 2
    u = rng.beta(k, n - k + 1, iterations)
    low = np.clip(np.ceil(n * u), 1, n).astype(np.int64)
    if n % 2:
        return low, low
    v = u - (1 - u) * np.expm1(np.log1p(-rng.random(iterations)) / (n - k))
    return low, np.clip(np.ceil(n * v), 1, n).astype(np.int64)


def _span(n: int, seed: int, iterations: int) -> tuple[int, int]:
    a, b = _ranks(n, seed, iterations)
    return min(int(a.min()), (n + 1) // 2), max(int(b.max()), n // 2 + 1)


def _medians(n: int, seed: int, iterations: int, upto: list[int], x: list[float]) -> tuple[float, list[float]]:
    """(median, medians of the resamples); upto: last rank of each value of x, which hold the ranks drawn."""
    at = np.asarray(upto)
    values = np.asarray(x)
    pick = lambda r: values[np.searchsorted(at, r)]
    a, b = _ranks(n, seed, iterations)
    return float((pick((n + 1) // 2) + pick(n // 2 + 1)) / 2), ((pick(a) + pick(b)) / 2).tolist()


def medians(rows: DataFrame, group: list[str], value: str, iterations: int = 2000, seed: int = 0) -> DataFrame:
    """(group, n, median, draws): the medians of ``iterations`` resamples of each group, each as large as the group.

    Null and infinite values and NaN are left out; a group without others has n 0 and nulls. Values are counted before the
    shuffle; as the ranks of the resamples' middles are drawn from n alone, just the values at those ranks, some times the
    square root of n around the middle, come together in a row per group. The same on every run and in any partitioning."""
    x = rows.select(F.struct(*group).alias("g"), F.col(value).cast("double").alias("x")).withColumn("x", F.when(F.abs("x") < float("inf"), F.col("x")))
    seeds = F.xxhash64(F.lit(seed), "g")
    groups = x.groupBy("g").agg(F.count("x").alias("n"))
    span = F.udf(lambda n, s: _span(n, s, iterations) if n else None, "low long, high long")
    spans = groups.withColumn("s", span("n", seeds)).select("g", "n", "s.low", "s.high")
    counted = x.filter("x is not null").groupBy("g", "x").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    near = counted.withColumn("upto", upto).join(spans, "g").filter((F.col("upto") >= F.col("low")) & (F.col("upto") - F.col("c") < F.col("high")))
    each = near.groupBy("g", "n").agg(F.sort_array(F.collect_list(F.struct("upto", "x"))).alias("v"))
    draw = F.udf(lambda n, s, u, v: _medians(n, s, iterations, u, v), "median double, draws array<double>")
    drawn = each.withColumn("m", draw("n", seeds, "v.upto", "v.x")).select("g", "m.median", "m.draws")
    return groups.join(drawn, "g", "left").select("g.*", "n", "median", "draws")


def percentile_bounds(draws: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Percentile interval of an array of draws, interpolated between its order statistics (type 7)."""
    tail, ordered = (1 - confidence) / 2, F.sort_array(draws)

    def at(p: float) -> Column:
        place = (F.size(ordered) - 1) * F.lit(p)
        low, high = (F.try_element_at(ordered, f(place).cast("int") + 1) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return at(tail), at(1 - tail)


def median_intervals(drawn: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(group, n, median, low, high) out of ``medians``."""
    low, high = percentile_bounds(F.col("draws"), confidence)
    return drawn.withColumns({"low": low, "high": high}).drop("draws")


def median_difference(first: Column, first_draws: Column, second: Column, second_draws: Column, confidence: float = 0.95) -> tuple[Column, Column, Column]:
    """(difference, low, high) of the medians of two groups drawn independently, null if either is empty."""
    low, high = percentile_bounds(F.zip_with(first_draws, second_draws, lambda a, b: a - b), confidence)
    return first - second, low, high
