"""Points in intervals and intervals with intervals, by bins of time instead of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str, starts: str, ends: str, bin_days: int = 64) -> DataFrame:
    """Inner join on key and starts < at <= ends (dates). Columns of ``points`` come first; ``key`` comes once.

    An interval goes to each bin of ``bin_days`` days it touches, a point to its own, so the join is by (key, bin) and no
    task sees all of a key. Null keys, points and bounds match nothing; empty intervals hold nothing."""
    day = lambda c: F.floor(F.unix_date(c) / F.lit(bin_days))
    p = points.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__bin", day(F.col(at)))
    i = intervals.filter(F.col(key).isNotNull() & (F.col(starts) < F.col(ends))).withColumn("__bin", F.explode(F.sequence(day(F.col(starts)), day(F.col(ends)))))
    return p.join(i, [key, "__bin"]).filter((F.col(at) > F.col(starts)) & (F.col(at) <= F.col(ends))).drop("__bin")


def distinct_in_span(rows: DataFrame, key: str, member: str, day: str, days: int) -> DataFrame:
    """(key, day, members): on each day a key has rows, how many distinct members it has had within the ``days`` days before
    or on it.

    A member is there on the union of the spans [day, day + days] of its days. So it enters where a day isn't covered by
    the one before, and leaves where a span isn't taken over by the next: +1 and -1, summed by key and day before they
    are run through, in as many rows as the calendar has days. Null keys, members and days count for nothing."""
    once = rows.select(F.col(key).alias("k"), F.col(member).alias("m"), F.unix_date(day).alias("n")).filter("k is not null and m is not null and n is not null").distinct()
    own = Window.partitionBy("k", "m").orderBy("n")
    marked = once.withColumns({"before": F.lag("n").over(own), "next": F.lead("n").over(own)})
    enters = F.coalesce(F.col("n") > F.col("before") + days, F.lit(True)).cast("int")
    leaves = F.coalesce(F.col("next") > F.col("n") + days, F.lit(True)).cast("int")
    steps = F.array(F.struct(F.col("n").alias("n"), enters.alias("d"), F.lit(True).alias("seen")), F.struct((F.col("n") + days + 1).alias("n"), (-leaves).alias("d"), F.lit(False).alias("seen")))
    moves = marked.select("k", F.explode(steps).alias("s")).groupBy("k", "s.n").agg(F.sum("s.d").alias("d"), F.max("s.seen").alias("seen"))
    there = F.sum("d").over(Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return moves.withColumn("members", there).filter("seen").select(F.col("k").alias(key), F.date_from_unix_date("n").alias(day), F.col("members").cast("long").alias("members"))


def cluster_triggers(rows: DataFrame, days: int, least: int, strong: int) -> DataFrame:
    """(issuer, session, owners, anchor, strong): for each day of disclosure the window [anchor - days, anchor] of trading
    days with most distinct owners.

    rows: issuer, owner, tx_date and known_date dates, accession, line. A window counts rows known by the session only, its
    anchor is the trading day of one of them, and it must hold a row disclosed on the session; of windows with equally many
    owners the one whose anchor became known first is taken. Triggers have ``least`` owners or more. Only an owner's first
    word of a trading day is kept, and joins are by issuer and bin of time, so no task sees all of an issuer."""
    b = rows.filter("issuer is not null and tx_date is not null and known_date is not null").withColumn("__bin", F.floor(F.unix_date("tx_date") / F.lit(days + 1)))
    fresh = b.select("issuer", "__bin", "tx_date", F.col("known_date").alias("session")).distinct()
    first = b.groupBy("issuer", "__bin", "tx_date").agg(F.min(F.struct("known_date", "accession", "line")).alias("first"))
    # anchors follow the new row by at most ``days``: they lie in its bin or the next
    ahead = fresh.withColumn("__bin", F.explode(F.array(F.col("__bin"), F.col("__bin") + 1)))
    anchors = first.withColumnsRenamed({"tx_date": "anchor"}).join(ahead, ["issuer", "__bin"])
    anchors = anchors.filter((F.col("first.known_date") <= F.col("session")) & (F.datediff("anchor", "tx_date").between(0, days))).select("issuer",
        "__bin", "anchor", "session", "first").distinct()
    facts = b.filter("owner is not null").groupBy("issuer", "__bin", "owner", "tx_date").agg(F.min("known_date").alias("known_date"))
    back = anchors.withColumn("__bin", F.explode(F.array(F.col("__bin"), F.col("__bin") - 1)))
    members = back.join(facts, ["issuer", "__bin"]).filter((F.col("known_date") <= F.col("session")) & (F.datediff("anchor", "tx_date").between(0, days)))
    windows = members.groupBy("issuer", "session", "anchor", "first").agg(F.count_distinct("owner").alias("owners"))
    best = windows.groupBy("issuer", "session").agg(F.min(F.struct((-F.col("owners")).alias("fewer"), "first", "anchor")).alias("w"))
    return best.select("issuer", "session", (-F.col("w.fewer")).alias("owners"), "w.anchor").filter(F.col("owners") >= least).withColumn("strong", F.col("owners") >= strong)


def disjoint_filings(rows: DataFrame) -> DataFrame:
    """(issuer, accession, independent): how many other filings of the issuer have no owner in common with each.

    rows: issuer, accession, owner. Counted as all filings minus those that share an owner, by distinct sets of owners: sets
    that meet are found by the owner they share, each pair once, and filings of equal sets are never paired."""
    sets = rows.groupBy("issuer", "accession").agg(F.array_sort(F.collect_set("owner")).alias("s"))
    counted = sets.groupBy("issuer", "s").agg(F.count("*").alias("n"))
    all_ = counted.groupBy("issuer").agg(F.sum("n").alias("all"))
    by_owner = counted.withColumn("owner", F.explode("s"))
    other = by_owner.select("issuer", "owner", F.col("s").alias("met"), F.col("n").alias("met_n"))
    # a pair that shares several owners is kept at the least of them
    pairs = by_owner.join(other, ["issuer", "owner"]).filter(F.col("owner") == F.array_min(F.array_intersect("s", "met")))
    meeting = pairs.groupBy("issuer", "s").agg(F.sum("met_n").alias("meeting"))
    by_set = counted.select("issuer", "s").join(meeting, ["issuer", "s"], "left").join(all_, "issuer")
    each = by_set.select("issuer", "s", (F.col("all") - F.coalesce("meeting", F.lit(0))).alias("rest"), (F.size("s") == 0).alias("empty"))
    # a set without owners meets none, not even itself
    return sets.join(each, ["issuer", "s"]).select("issuer", "accession", (F.col("rest") - F.col("empty").cast("long")).alias("independent"))


def including_filings(rows: DataFrame) -> DataFrame:
    """(issuer, accession, candidates): how many earlier filings of the issuer's month have all owners of each, and others maybe.

    rows: issuer, accession, owner, tx_date. Filings are first reduced to one row per set of owners, with which the few sets
    of a month are compared; how many earlier filings each set has is a running count, so equal filings are never paired with
    each other."""
    o = rows.groupBy("issuer", "accession").agg(F.array_sort(F.collect_set("owner")).alias("s"), F.min("tx_date").alias("day")).withColumn("m", F.date_trunc("month", "day"))
    sets = o.select("issuer", "m", "s").distinct()
    wide = sets.select("issuer", "m", F.col("s").alias("outer"))
    # a set that includes another holds its least owner: joined by that owner, not by the month alone
    inner = sets.withColumn("owner", F.element_at("s", 1))
    holds = wide.withColumn("owner", F.explode("outer")).join(inner, ["issuer", "m", "owner"]).filter(F.size(F.array_except("s", "outer")) == 0).select("issuer", "m", "s", "outer")
    asked = o.join(holds, ["issuer", "m", "s"]).select("issuer", "m", "accession", F.col("outer").alias("s"), F.lit(1).alias("asks"))
    both = asked.unionByName(o.select("issuer", "m", "accession", "s", F.lit(0).alias("asks")))
    w = Window.partitionBy("issuer", "m", "s").orderBy("accession").rangeBetween(Window.unboundedPreceding, -1)
    earlier = both.withColumn("n", F.coalesce(F.sum(F.lit(1) - F.col("asks")).over(w), F.lit(0))).filter("asks = 1")
    return earlier.groupBy("issuer", "accession").agg(F.sum("n").alias("candidates"))


def positional(left: DataFrame, right: DataFrame) -> DataFrame:
    """(symbol, rows, other_day, other_close, alone) of two sides matched by symbol and pos; l and r: structs of date, close."""
    both = left.join(right, ["symbol", "pos"], "full")
    alone, same_day = F.col("l").isNull() | F.col("r").isNull(), F.col("l.date") == F.col("r.date")
    return both.groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if(~same_day).alias("other_day"),
        F.count_if(same_day & ~F.col("l.close").eqNullSafe(F.col("r.close"))).alias("other_close"), F.count_if(alone).alias("alone"))
