"""Constraints as queries whose result must be empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, copies) of keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key no parent has; a null key refers to nothing and is an orphan too."""
    p = parents.select(F.col(parent_key).alias("__parent")).distinct()
    return children.join(p, F.col(child_key) == F.col("__parent"), "left_anti")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, rows): how many rows break each rule; a rule that gives null counts as broken."""
    sums = [F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("rows")) for n in rules]))
    return rows.agg(*sums).select(pairs.alias("p")).select("p.rule", "p.rows")


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``reasons``): one plan, two outlets."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    marked = rows.withColumn("reasons", reasons)
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def set_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key, side): keys on one side only; null keys compare as values."""
    a, b = left.select(*key).distinct().withColumn("__a", F.lit(1)), right.select(*key).distinct().withColumn("__b", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True).groupBy(*key).agg(F.max("__a").alias("__in_a"), F.max("__b").alias("__in_b"))
    return both.filter("__in_a is null or __in_b is null").select(*key, F.when(F.col("__in_b").isNull(), "left").otherwise("right").alias("side"))


def changes(before: DataFrame, after: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """(key, change): ADDED, REMOVED or CHANGED between two snapshots, by one full join on the key."""
    mark = lambda df, side: df.select(*key, F.struct(*content).alias(f"__{side}"))
    j = mark(before, "old").join(mark(after, "new"), key, "full")
    kind = F.when(F.col("__old").isNull(), "ADDED").when(F.col("__new").isNull(), "REMOVED").when(~F.col("__old").eqNullSafe(F.col("__new")), "CHANGED")
    return j.select(*key, kind.alias("change")).filter("change is not null")


def content_hash(columns: list[str]) -> Column:
    """SHA-256 over the columns in order; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return F.sha2(reduce(lambda a, b: F.concat(a, F.lit("|"), b), parts), 256)


def day_checkpoints(keys: DataFrame, day: str, key: str, stored: str) -> DataFrame:
    """(day, discovered, stored, failed, complete, name): a day's keys, each once, by whether they were stored. ``name`` is the
    hash of the sorted keys and their outcome, the same for the same content on any run. A day's keys are one row's size."""
    mark = F.concat(F.col(key), F.when(F.col(stored), "+").otherwise("-"))
    g = keys.groupBy(day).agg(F.count("*").alias("discovered"), F.count_if(F.col(stored)).alias("stored"), F.count_if(~F.col(stored)).alias("failed"),
        F.array_sort(F.collect_list(mark)).alias("__marks"))
    return g.select(day, "discovered", "stored", "failed", (F.col("failed") == 0).alias("complete"), F.sha2(F.array_join("__marks", ","), 256).alias("name"))


def overlay(base: DataFrame, over: DataFrame, key: list[str], value: str, corrected: str) -> DataFrame:
    """(*key, value, origin): ``corrected`` of the overlay's row with the very same key in place of ``value``. origin: BASE
    without such a row, WITHDRAWN where it states no value, else OVERLAY. A base without repeated keys gives none."""
    o = over.select(*key, F.col(corrected).alias("__corrected"), F.lit(True).alias("__there"))
    origin = F.when(F.col("__there").isNull(), "BASE").when(F.col("__corrected").isNull(), "WITHDRAWN").otherwise("OVERLAY")
    return base.join(o, key, "left").select(*key, F.coalesce("__corrected", value).alias(value), origin.alias("origin"))


def scope_difference(base: DataFrame, over: DataFrame, key: list[str]) -> DataFrame:
    """(key, side): keys that only one of the two has; empty where an overlay covers exactly its base."""
    return set_difference(base, over, key)
