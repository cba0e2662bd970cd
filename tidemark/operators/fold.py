"""Decisions that depend on earlier decisions: folds over an entity's events in order.

The fold runs in the JVM as a higher-order function over a sorted array per key. What is collected is only what the
decision needs (an ordinal and an id), after repeated ordinals of a key have been reduced, so an array is no longer than
the calendar the ordinals count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_spacing(events: DataFrame, key: list[str], ordinal: str, spacing: int) -> DataFrame:
    """(key, ordinal): those ordinals of a key that are kept when one is kept only if it is at least ``spacing`` after the
    last one kept. Null ordinals and null keys are never kept; equal ordinals are one."""
    once = events.select(*key, F.col(ordinal).cast("long").alias("__o")).filter(F.col("__o").isNotNull()).filter(" and ".join(f"`{k}` is not null" for k in key)).distinct()
    arrays = once.groupBy(*key).agg(F.array_sort(F.collect_list("__o")).alias("__all"))
    kept = F.aggregate("__all", F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("kept")),
        lambda acc, o: F.when(acc["last"].isNull() | (o - acc["last"] >= spacing),
            F.struct(o.alias("last"), F.concat(acc["kept"], F.array(o)).alias("kept"))).otherwise(acc), lambda acc: acc["kept"])
    return arrays.select(*key, F.explode(kept).alias(ordinal))


def hysteresis(level: Column, steps: Column, top: int, failures: int) -> Column:
    """Levels after each of ``steps``, an array of structs with flags ``up`` and ``down``: one level up per step with ``up``, one down after ``failures`` steps running with ``down``, never beyond 0 and ``top``."""
    start = F.struct(level.cast("int").alias("level"), F.lit(0).alias("failed"), F.array().cast("array<int>").alias("path"))

    def step(acc: Column, x: Column) -> Column:
        failed = F.when(x["down"], acc["failed"] + 1).otherwise(F.lit(0))
        drop = failed >= failures
        new = F.when(x["up"], F.least(acc["level"] + 1, F.lit(top))).when(drop, F.greatest(acc["level"] - 1, F.lit(0))).otherwise(acc["level"])
        return F.struct(new.cast("int").alias("level"), F.when(drop, F.lit(0)).otherwise(failed).cast("int").alias("failed"), F.concat(acc["path"], F.array(new.cast("int"))).alias("path"))

    return F.aggregate(steps, start, step, lambda acc: acc["path"])


def cooldown(steps: Column, days: int, least_move: float) -> Column:
    """(kept, overridden) over an array of (day, score) in order: a step is kept when ``days`` have gone by since the last one
    kept, or when the score has moved by ``least_move`` since, which counts as overridden."""
    start = F.struct(F.lit(None).cast("int").alias("day"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("kept"), F.lit(0).alias("overridden"))

    def step(acc: Column, x: Column) -> Column:
        due = acc["day"].isNull() | (x["day"] - acc["day"] >= days)
        moved = ~due & (F.abs(x["score"] - acc["score"]) >= least_move)
        new = F.struct(x["day"].alias("day"), x["score"].cast("double").alias("score"), (acc["kept"] + 1).alias("kept"),
            (acc["overridden"] + F.when(moved, 1).otherwise(0)).alias("overridden"))
        return F.when(due | moved, new).otherwise(acc)

    return F.aggregate(steps, start, step)
