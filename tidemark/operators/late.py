"""Late and out-of-order events: totals per period, corrected by retraction as records arrive.

Each key (a filing) has a state that new records may change: when it was first seen, and the day it counts for. A key
whose first record arrives at or after its period's cut-off is late there, else it counts. Every change is a new version
of the key's state; where a version puts the key elsewhere than the one before, the operator emits -1 for the old place
and +1 for the new. Both results are integrals of that stream of deltas and are never recomputed: the totals sum what
counts, the list of late keys holds those whose late deltas sum to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATENESS_DAYS = 45


def facts(records: DataFrame) -> DataFrame:
    """What a set of records says about each key, pre-aggregated before the shuffle: one row per key and stated day.

    records: key string, stated_day date, accepted_at, arrived_at timestamp_ntz, record_id long. Rows without key are left
    out. So that a key with a third of all records is not one task's work, everything later runs on these rows."""
    return records.filter("key is not null").groupBy("key",
        "stated_day").agg(F.min(F.struct(F.col("arrived_at").isNull().alias("unknown"), "arrived_at", "record_id")).alias("first"),
        F.min("accepted_at").alias("accepted_at"))


def period_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def cut_off(day: Column, lateness_days: int) -> Column:
    """The instant from which a first arrival is too late for the day's month."""
    return F.date_add(F.add_months(F.trunc(day, "month"), 1), lateness_days).cast("timestamp_ntz")


def versions(fact_rows: DataFrame, lateness_days: int = LATENESS_DAYS) -> DataFrame:
    """(key, version, at, day, first_seen, period, late): the key's state after each record that could change it.

    day: the stated day that arrived first, else the date of the earliest accepted_at so far. A key without any day has
    period null and is never late; one without any arrival time can't be shown to be late and counts."""
    so_far = Window.partitionBy("key").orderBy("first", F.col("stated_day").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    order = Window.partitionBy("key").orderBy("first", F.col("stated_day").asc_nulls_last())
    day = F.coalesce(F.first("stated_day", ignorenulls=True).over(so_far), F.to_date(F.min("accepted_at").over(so_far)))
    return (
        fact_rows.withColumns({"version": F.row_number().over(order), "at": F.col("first.arrived_at"), "day": day, "first_seen": F.min("first.arrived_at").over(so_far)})
        .withColumns({"period": period_of(F.col("day")), "late": F.coalesce(F.col("first_seen") >= cut_off(F.col("day"), lateness_days), F.lit(False))})
        .withColumn("last", F.lead("version").over(order).isNull())
        .select("key", "version", "at", "day", "first_seen", "period", "late", "last")
    )


def place(period: Column, late: Column) -> Column:
    """Where a key is counted: its period and on which side of the cut-off; null for a key without period."""
    return F.when(period.isNotNull(), F.struct(period.alias("period"), late.alias("late")))


def retractions(changes: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, period, late, delta) of rows with two places ``was`` and ``now``: -1 where a key was, +1 where it is now,
    nothing where it stays. Batches and streams emit their deltas through this."""
    both = F.array(F.struct(F.col("was").alias("place"), F.lit(-1).alias("delta")), F.struct(F.col("now").alias("place"), F.lit(1).alias("delta")))
    moved = changes.filter(~F.col("was").eqNullSafe(F.col("now"))).select(*keep, F.explode(both).alias("d"))
    return moved.filter("d.place is not null").select(*keep, "d.place.period", "d.place.late", "d.delta")


def deltas(version_rows: DataFrame) -> DataFrame:
    """(key, version, at, period, late, delta): what each version of a key's state retracts and adds."""
    was = F.lag("now").over(Window.partitionBy("key").orderBy("version"))
    return retractions(version_rows.withColumn("now", place(F.col("period"), F.col("late"))).withColumn("was", was), ["key", "version", "at"])


def totals(delta_rows: DataFrame) -> DataFrame:
    """(period, filings, added, retracted) of what counts."""
    up, down = F.when(F.col("delta") > 0, 1).otherwise(0), F.when(F.col("delta") < 0, 1).otherwise(0)
    sums = {"filings": F.sum("delta"), "added": F.sum(up), "retracted": F.sum(down)}
    return delta_rows.filter("not late").groupBy("period").agg(*[c.cast("long").alias(n) for n, c in sums.items()])


def beyond_cut_off(delta_rows: DataFrame) -> DataFrame:
    """(period, key) of every key that is late: its late deltas for the period sum to one."""
    return delta_rows.filter("late").groupBy("key", "period").agg(F.sum("delta").alias("n")).filter("n > 0").select("period", "key")
