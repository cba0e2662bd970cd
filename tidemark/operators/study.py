"""Event studies: from when a thing was known to the session it can be acted on, and what prices did afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles


def session_at_or_after(events: DataFrame, sessions: DataFrame, at: str) -> DataFrame:
    """events with ``session_idx`` (replaced if there is one): the first session whose close is not before ``at``; null past the last one.

    sessions: session_date, session_idx, close_utc. The calendar becomes a table from day to next session, so this is an
    equi join on the day and one comparison with that session's close: no range join, however many events there are."""
    s = sessions.select(F.col("session_date").alias("__date"), F.col("session_idx").cast("long").alias("__own"), F.col("close_utc").cast("timestamp_ntz").alias("__close"))
    order = Window.orderBy("__own")  # over the calendar only
    spans = s.withColumn("__since", F.coalesce(F.date_add(F.lag("__date").over(order), 1), F.col("__date"))).withColumn("__next", F.lead("__own").over(order))
    days = spans.select("__own", "__close", "__next", F.explode(F.sequence("__since", "__date")).alias("__day"))
    first = s.agg(F.min("__date").alias("day"), F.min_by("__own", "__date").alias("idx")).first()  # two values
    day = F.to_date(F.col(at))
    j = events.drop("session_idx").join(days, day == F.col("__day"), "left")
    found = F.when(F.col(at) <= F.col("__close"), F.col("__own")).otherwise(F.col("__next"))
    idx = F.when(day < F.lit(first["day"]), F.lit(first["idx"])).otherwise(found)
    return j.withColumn("session_idx", idx.cast("long")).drop("__own", "__close", "__next", "__day")


def forward_outcomes(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(symbol, session_idx, horizon, forward_return, worst, complete), a row per bar and horizon.

    bars: symbol, session_idx long, open, low, close. Entry is the open of the very next session, exit the close ``horizon``
    sessions after that; a missing session is a missing outcome, not the next one found. worst: lowest low on the way
    against entry, null unless every session is there. Range frames over the session index do this in one shuffle."""
    w = Window.partitionBy("symbol").orderBy("session_idx")
    entry = F.max("open").over(w.rangeBetween(1, 1))
    b = bars.withColumn("entry", entry)
    parts = []
    for h in horizons:
        path = w.rangeBetween(1, 1 + h)
        parts.append(F.struct(F.lit(h).alias("horizon"), F.max("close").over(w.rangeBetween(1 + h, 1 + h)).alias("exit"),
            F.min("low").over(path).alias("low"), (F.count("low").over(path) == h + 1).alias("complete")))
    long = b.withColumn("__outcomes", F.array(*parts)).select("symbol", "session_idx", "entry", F.explode("__outcomes").alias("o"))
    ok = F.col("entry") > 0
    return long.select("symbol", "session_idx", F.col("o.horizon").cast("long").alias("horizon"),
        F.when(ok, F.col("o.exit") / F.col("entry") - 1).alias("forward_return"),
        F.when(ok & F.col("o.complete"), F.col("o.low") / F.col("entry") - 1).alias("worst"), F.col("o.complete").alias("complete"))


def summary(outcomes: DataFrame, group: list[str]) -> DataFrame:
    """(*group, events, outcomes, mean, median, win_rate, p10, median_worst) of ``forward_return`` and ``worst``, nulls left
    out. Quantiles are exact and need no task that holds a group's values; both columns' are found in one go."""
    x = F.col("forward_return")
    plain = outcomes.groupBy(*group).agg(F.count("*").alias("events"), F.count(x).alias("outcomes"), F.avg(x).alias("mean"), F.avg((x > 0).cast("double")).alias("win_rate"))
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("x")) for c in ("forward_return", "worst")]))
    q = quantiles.quantiles(outcomes.select(*group, kinds.alias("v")).select(*group, "v.kind", "v.x"), [*group, "kind"], "x", {"median": 0.5, "p10": 0.1})
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    both = q.groupBy(*group).agg(of("forward_return", "median").alias("median"), of("forward_return", "p10").alias("p10"), of("worst", "median").alias("median_worst"))
    return quantiles.joined_by(group, [plain, both]).select(*group, "events", "outcomes", "mean", "median", "win_rate", "p10", "median_worst")


def top_share(rows: DataFrame, group: list[str], order: list, share: float) -> DataFrame:
    """The best ``share`` of each group, rounded up, one at least, by ``order``."""
    g = Window.partitionBy(*group)
    n = F.count("*").over(g)
    return rows.withColumns({"__rn": F.row_number().over(g.orderBy(*order)), "__n": n}).filter(F.col("__rn") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(share)))).drop("__rn", "__n")
