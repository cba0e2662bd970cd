"""Rolling totals over trailing calendar days, days without activity included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def daily_totals(rows: DataFrame) -> DataFrame:
    """(entity, n_day, total, level_sum, level_n, active): one row per entity and day with activity, pre-aggregated.

    rows: entity string, day date, amount double, level decimal, whose sums are exact in any order. Null amounts and levels count for nothing; rows without
    entity or day are left out. ``active`` counts rows with a positive amount."""
    return (
        rows.filter("entity is not null and day is not null")
        .groupBy("entity", F.unix_date("day").alias("n_day"))
        .agg(F.sum("amount").alias("total"), F.sum("level").alias("level_sum"), F.count("level").alias("level_n"), F.count(F.when(F.col("amount") > 0, 1)).alias("active"))
    )


def trailing(daily: DataFrame, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """A row for every calendar day of an entity between its first and last row of ``daily`` (n_day int).

    total_k: sum over the day and the k-1 before it; mean_k = total_k / k, the denominator being fixed; level_k: mean of
    the levels there, null if there are none; active_k: active rows. Frames are ranges over the integer day number, so
    they hold whatever days are missing. Work per entity is bounded by the calendar, not by its rows."""
    days = Window.partitionBy("entity").orderBy("n_day")
    until = F.coalesce(F.lead("n_day").over(days) - 1, F.col("n_day"))
    # inactive days follow the active day before them: an explode of the gap, no join with a calendar
    filled = daily.withColumn("until", until).select("*", F.explode(F.sequence("n_day", "until")).alias("n"))
    own = F.col("n") == F.col("n_day")
    grid = filled.select("entity", F.col("n").alias("n_day"), *[F.when(own, F.col(c)).alias(c) for c in ("total", "level_sum", "level_n", "active")])
    out: dict = {}
    for k in periods:
        w = days.rangeBetween(-(k - 1), 0)
        total = F.coalesce(F.sum("total").over(w), F.lit(0.0))
        out |= {f"total_{k}": total, f"mean_{k}": total / F.lit(float(k)),
            f"level_{k}": F.sum("level_sum").over(w).cast("double") / F.nullif(F.sum("level_n").over(w).cast("double"), F.lit(0.0)),
            f"active_{k}": F.coalesce(F.sum("active").over(w), F.lit(0)).cast("long")}
    return grid.withColumns(out).withColumn("day", F.date_from_unix_date("n_day")).select("entity", "day", *out)


def ordered_index(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their position from 0 in the given total order, without one task seeing them all.

    Rows are sorted over range partitions and written to the shared folder, so that both sides of what follows see the
    same partitions; each adds what the partitions before it hold. Only one count per partition passes through a window of
    its own."""
    checkpoint_dir(rows.sparkSession)
    fixed = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    sorted_ = fixed.withColumn("__part", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = sorted_.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return sorted_.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__i")).drop("__part", "__before", "__i", "__size")


def barometer(rows: DataFrame, days: int, sides: dict[str, str]) -> DataFrame:
    """(day, purchases, sales, ratio, dollars, companies) of the ``days`` trading days up to each day, as known by its end.

    rows: issuer, code, tx_date and known_date dates, value; ``sides`` names the codes of buying and selling. A row counts
    from the later of its trading day and the day it became known until it leaves the window, or never if it is known later
    than that. So each (enters, leaves) is a sum that is added once and taken off once, and the calendar's running sum is
    the window. Dollars are exact decimals on the way; they are null while a value of their side is missing or negative. A
    company counts over the union of its rows' spans. Ratios are null without sales."""
    buy, sale = sides
    ok = F.coalesce((F.col("value") >= 0) & (F.col("value") < float("inf")), F.lit(False))
    t = rows.filter(F.col("code").isin(buy, sale) & F.col("tx_date").isNotNull() & F.col("known_date").isNotNull())
    t = t.select("issuer", "code", "tx_date", F.greatest("tx_date", "known_date").alias("enters"), F.date_add("tx_date", days).alias("leaves"),
        F.when(ok, F.col("value")).cast("decimal(28,6)").alias("value"), ok.alias("ok"))
    calendar = t.agg(F.min("tx_date").alias("a"), F.max("enters").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    seen = t.filter("enters < leaves")
    sums = {}
    for code, side in sides.items():
        own = F.col("code") == code
        sums |= {f"{side}_n": F.count_if(own), f"{side}_value": F.coalesce(F.sum(F.when(own, F.col("value"))), F.lit(0).cast("decimal(38,6)")), f"{side}_bad": F.count_if(own & ~F.col("ok"))}
    spans = seen.groupBy("enters", "leaves").agg(*[c.alias(k) for k, c in sums.items()])
    firms = seen.select("issuer", F.explode(F.array("code", F.lit("any"))).alias("kind"), "enters", "leaves").groupBy("issuer", "kind", "enters").agg(F.max("leaves").alias("leaves"))
    before = F.max("leaves").over(Window.partitionBy("issuer", "kind").orderBy("enters").rowsBetween(Window.unboundedPreceding, -1))
    # what a row adds to the span that its company's earlier rows cover
    firms = firms.withColumn("before", before).withColumn("enters", F.greatest("enters", "before")).filter("enters < leaves")
    firms = firms.filter("issuer is not null").groupBy("enters", "leaves").agg(*[F.count_if(F.col("kind") == k).alias(f"{name}_firms") for k, name in {**sides, "any": "any"}.items()])
    both = spans.unionByName(firms, allowMissingColumns=True)
    names = [c for c in both.columns if c not in ("enters", "leaves")]
    deltas = both.select(F.explode(F.array(F.struct(F.col("enters").alias("day"), *names),
        F.struct(F.col("leaves").alias("day"), *[(-F.col(c)).alias(c) for c in names]))).alias("d")).groupBy("d.day").agg(*[F.sum(f"d.{c}").alias(c) for c in names])
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    run = calendar.join(deltas, "day", "left").select("day", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in names])
    dollars = lambda side: F.when(F.col(f"{side}_bad") == 0, F.col(f"{side}_value").cast("double"))
    b, s = sides.values()
    out = run.select("day", F.col(f"{b}_n").alias(f"purchases_{days}d"), F.col(f"{s}_n").alias(f"sales_{days}d"),
        (F.col(f"{b}_n") / F.nullif(F.col(f"{s}_n"), F.lit(0))).alias("ratio"), dollars(b).alias("buy_dollars"), dollars(s).alias("sale_dollars"),
        F.col(f"{b}_firms").alias("buying_companies"), F.col(f"{s}_firms").alias("selling_companies"), F.col("any_firms").alias("active_companies"))
    return out.withColumn("dollar_ratio", F.col("buy_dollars") / F.nullif(F.col("sale_dollars"), F.lit(0.0)))
