"""Messages delivered more than once: exactly one copy of each identifier stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__arrival_rank"


def _first(work: DataFrame, order: list[Column]) -> DataFrame:
    """Of rows with an identifier the earliest of each. Rank 1 is asked for directly above the window, so Spark limits the ranks
    in every task before the shuffle: a message with a third of all rows sends one row per task."""
    w = Window.partitionBy("__identifier").orderBy(*[o.asc_nulls_last() for o in order])
    return work.withColumn(_RANK, F.row_number().over(w)).filter(F.col(_RANK) == 1).drop(_RANK)


def keep_first(messages: DataFrame, identifier: Column, order: list[Column]) -> DataFrame:
    """The earliest copy of each message, by ``order`` (nulls last), which must end in a column that breaks ties.

    Rows without identifier can't be copies of anything and all stay."""
    work = messages.withColumn("__identifier", identifier)
    first = _first(work.filter(F.col("__identifier").isNotNull()), order)
    return first.unionByName(work.filter(F.col("__identifier").isNull())).drop("__identifier")


def copies(messages: DataFrame, identifier: Column, order: list[Column], unique: str) -> DataFrame:
    """All rows that ``keep_first`` drops. ``unique`` names a column without repetitions, by which kept rows are told
    from dropped ones; a join on it can't be skewed, while one on the identifier could. Rows with a null there or without
    identifier are copies of nothing."""
    work = messages.withColumn("__identifier", identifier).filter(F.col("__identifier").isNotNull() & F.col(unique).isNotNull())
    return work.join(_first(work, order).select(unique), unique, "left_anti").drop("__identifier")


def new_messages(batch: DataFrame, stored: DataFrame, identifier: Column, stored_identifier: Column, order: list[Column]) -> DataFrame:
    """First copies within a new batch whose identifier isn't stored yet; rows without identifier pass.

    Only the batch's first copies meet the stored identifiers, each once, so neither side of the join has hot keys."""
    known = stored.select(stored_identifier.alias("__known")).filter("__known is not null").distinct()
    return keep_first(batch, identifier, order).withColumn("__own", identifier).join(known, F.col("__own") == F.col("__known"), "left_anti").drop("__own")
