"""Exact quantiles and tails of very large groups, without any task that sorts a group or holds its values.

Values are first counted in steps of the value axis that are about one per cent wide, of which a group has at most a few
thousand. The steps tell in which one a rank lies; only the rows of that step are then counted by value and ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step(value: Column) -> Column:
    """Number of the step a value lies in; it never falls as the value rises."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * F.lit(1e4)) * F.lit(100.0))


def _running(count: str, *by: str, order: str) -> Column:
    return F.sum(count).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def counted_steps(rows: DataFrame) -> DataFrame:
    """(g, step, count, upto, n): rows (g, x) counted by step; upto: rows of the group up to that step; n: all of them."""
    counts = rows.groupBy("g", step(F.col("x")).alias("step")).agg(F.count("*").alias("count"))
    return counts.withColumns({"upto": _running("count", "g", order="step"), "n": F.sum("count").over(Window.partitionBy("g"))})


def quantiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(*group, *shares): exact quantiles of ``value``, interpolated between neighbours (type 7).

    Nulls and NaN are left out; a group without values has no row. Null is a group of its own."""
    x = rows.select(F.struct(*group).alias("g"), F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    place = {name: (F.col("n") - 1) * F.lit(p) for name, p in shares.items()}
    # a quantile at a place between two ranks takes the rest of its weight from the upper one
    ranks = [F.struct(F.lit(name).alias("name"), (bound(at) + 1).cast("long").alias("rank"), weight(at - F.floor(at)).alias("weight")) for name,
        at in place.items() for bound, weight in ((F.floor, lambda f: 1 - f), (lambda a: F.floor(a) + 1, lambda f: f))]
    steps = counted_steps(x).withColumn("below", F.col("upto") - F.col("count"))
    wanted = F.filter(F.array(*ranks), lambda r: (r["weight"] > 0) & (r["rank"] > F.col("below")) & (r["rank"] <= F.col("upto")))
    asked = steps.select("g", "step", "below", F.explode(wanted).alias("r"))
    inside = x.withColumn("step", step(F.col("x"))).join(asked.select("g", "step").distinct(), ["g", "step"], "left_semi")
    counts = inside.groupBy("g", "step", "x").agg(F.count("*").alias("count"))
    upto = counts.withColumn("upto", _running("count", "g", "step", order="x"))
    hit = asked.join(upto, ["g", "step"]).filter((F.col("r.rank") > F.col("below") + F.col("upto") - F.col("count")) & (F.col("r.rank") <= F.col("below") + F.col("upto")))
    of = lambda name: F.sum(F.when(F.col("r.name") == name, F.col("r.weight") * F.col("x")))
    return hit.groupBy("g").agg(*[of(name).alias(name) for name in shares]).select("g.*", *shares)


def trimmed_means(rows: DataFrame, group: list[str], value: str, share: float) -> DataFrame:
    """(*group, kept, trimmed_mean): mean without the lowest and the highest ``share`` of a group, rounded down.

    Steps between the cuts come in with their sums; of the two steps that are cut, values are counted and ranked."""
    x = rows.select(F.struct(*group).alias("g"), F.col(value).cast("double").alias("x")).filter("x is not null and not isnan(x)").withColumn("step", step(F.col("x")))
    cut = F.floor(F.col("n") * F.lit(share))
    steps = counted_steps(x).withColumns({"below": F.col("upto") - F.col("count"), "low": cut, "high": F.col("n") - cut})
    whole = (F.col("below") >= F.col("low")) & (F.col("upto") <= F.col("high"))
    some = (F.col("upto") > F.col("low")) & (F.col("below") < F.col("high"))
    kept = steps.filter(some).select("g", "step", "below", "low", "high", whole.alias("whole"))
    sums = x.groupBy("g", "step").agg(F.sum("x").alias("sum"), F.count("*").alias("count"))
    inner = kept.filter("whole").join(sums, ["g", "step"]).select("g", "sum", "count")
    counts = x.join(kept.filter("not whole"), ["g", "step"]).groupBy("g", "step", "below", "low", "high", "x").agg(F.count("*").alias("c"))
    upto = F.col("below") + _running("c", "g", "step", order="x")
    ranked = counts.withColumn("upto", upto).withColumn("count", F.least("upto", "high") - F.greatest(F.col("upto") - F.col("c"), F.col("low")))
    edges = ranked.filter("count > 0").select("g", (F.col("x") * F.col("count")).alias("sum"), "count")
    total = inner.unionByName(edges).groupBy("g").agg(F.sum("count").alias("kept"), F.sum("sum").alias("sum"))
    return total.select("g.*", "kept", (F.col("sum") / F.col("kept")).alias("trimmed_mean"))


def top_rows(rows: DataFrame, group: list[str], value: str, count: Column, ties: list[str]) -> DataFrame:
    """The rows of the greatest values of each group, ``count`` (an expression in the group's size n) of them; of equal values
    those first by ``ties``. Only rows of the one step that is cut are ranked. Nulls and NaN are left out."""
    x = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumns({"__g": F.struct(*group), "__step": -step(F.col(value))})
    steps = x.groupBy("__g", "__step").agg(F.count("*").alias("__c")).withColumn("n", F.sum("__c").over(Window.partitionBy("__g")))
    steps = steps.withColumns({"__before": _running("__c", "__g", order="__step") - F.col("__c"), "__k": count})
    reached = steps.filter("__before < __k").select("__g", "__step", "__before", "__k", (F.col("__before") + F.col("__c") <= F.col("__k")).alias("__whole"))
    j = x.join(reached, ["__g", "__step"])
    rank = F.row_number().over(Window.partitionBy("__g", "__step").orderBy(F.desc(value), *ties))
    cut = j.filter("not __whole").withColumn("__rank", rank).filter("__before + __rank <= __k").drop("__rank")
    out = j.filter("__whole").unionByName(cut)
    return out.drop("__g", "__step", "__before", "__k", "__whole")


def joined_by(group: list[str], parts: list[DataFrame]) -> DataFrame:
    """Parts with one row per group each, the first with all groups, side by side; nulls in the group are equal."""

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnsRenamed({k: f"__{k}" for k in group})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in group])
        return left.join(r, same, "left").drop(*[f"__{k}" for k in group])

    return reduce(beside, parts)
