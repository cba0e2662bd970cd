"""Features of daily price series and of cross sections of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import windows as Wf



def _by_date() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def weekly_bars(bars: DataFrame) -> DataFrame:
    """One row per symbol and week (Monday): first open, extremes, last close and adj_close, summed volume, sessions."""
    return bars.groupBy("symbol", F.to_date(F.date_trunc("week", "date")).alias("week_start")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"),
            F.max_by("adj_close", "date").alias("adj_close"),
        F.sum("volume").alias("volume"), F.bool_and("is_adjusted").alias("is_adjusted"), F.max("date").alias("session_date"), F.count("*").alias("sessions"),
    )


def split_quarantine(bars: DataFrame) -> DataFrame:
    """bars with ``discontinuous``: whether any close of the symbol is at most half or at least twice the one before, unless
    both bars are adjusted. A flag over the whole series, by the shuffle the series needs anyway."""
    before, adjusted = F.lag("close").over(_by_date()), F.lag("is_adjusted").over(_by_date())
    ratio = F.when(before > 0, F.col("close") / before)
    jump = ((ratio <= 0.5) | (ratio >= 2.0)) & ~(F.col("is_adjusted") & adjusted)
    return bars.withColumn("jump", F.coalesce(jump, F.lit(False))).withColumn("discontinuous", F.bool_or("jump").over(Window.partitionBy("symbol")))


def price_features(bars: DataFrame) -> DataFrame:
    """Rolling features per symbol, each null until its frame is full; all frames share one shuffle and one sort by date."""
    w = _by_date()
    close, adj = F.col("close"), F.col("adj_close")
    adj_before = F.lag("adj_close").over(w)
    step1 = bars.withColumns({
        "ma50": Wf.rolling_mean(close, w, 50), "ma20": Wf.rolling_mean(close, w, 20), "close_3m_ago": F.lag("close", 63).over(w),
        "high_52w": F.max("close").over(w.rowsBetween(-251, 0)), "low_52w": F.min("close").over(w.rowsBetween(-251, 0)), "prior_low_52w": F.min("close").over(w.rowsBetween(-252, -1)),
        "daily_return": F.when((adj > 0) & (adj_before > 0), adj / adj_before - 1), "median_volume_20d": Wf.rolling_median(F.col("volume"), w, 20),
        "adv63": F.avg(close * F.col("volume")).over(w.rowsBetween(-62, 0)),
        "signed": F.when(adj_before.isNotNull(), F.signum(adj - adj_before) * F.col("volume")),
    })
    ma20_lag = lambda k: F.lag("ma20", k).over(w)
    step2 = step1.withColumns({
        "return_3m": F.when(F.col("close_3m_ago") > 0, close / F.col("close_3m_ago") - 1),
        "drawdown_from_52_week_high": F.when(F.col("high_52w") > 0, close / F.col("high_52w") - 1), "new_52_week_low": close <= F.col("prior_low_52w"),
        "above_ma50": close > F.col("ma50"), "volatility_20d": Wf.rolling_std(F.col("daily_return"), w, 20), "median_volume_20d_prior": F.lag("median_volume_20d", 20).over(w),
        "ma20_slope_5d": (ma20_lag(4) * -2 - ma20_lag(3) + ma20_lag(1) + F.col("ma20") * 2) / 10,
        "signed_volume_ratio_20d": Wf.rolling_sum(F.col("signed"), w, 20) / F.nullif(F.sum(F.when(F.col("signed").isNotNull(), F.col("volume"))).over(w.rowsBetween(-19, 0)), F.lit(0.0)),
    })
    return step2.withColumns({
        "no_new_52_week_low_20_sessions": ~Wf.rolling_any(F.col("new_52_week_low"), w, 20),
            "days_above_ma50_last10": Wf.rolling_sum(F.col("above_ma50").cast("int"), w, 10),
            "volatility_20d_prior": F.lag("volatility_20d", 20).over(w),
    })


def relative_strength(rows: DataFrame, value: str) -> DataFrame:
    """rows with ``rs``: 100 x (average rank - 1) / (n - 1) of ``value`` on its date; a single value has 50, a null none."""
    day = Window.partitionBy("date")
    v = F.col(value)
    rank = Wf.average_rank(v, day, day.orderBy(v.asc_nulls_last()), Window.partitionBy("date", value))
    n = F.count(v).over(day)
    return rows.withColumn("rs", F.when(v.isNull(), None).when(n == 1, F.lit(50.0)).otherwise((rank - 1) / (n - 1) * 100))


def mansfield(weekly: DataFrame, benchmark: DataFrame, weeks: int = 52) -> DataFrame:
    """weekly with ``mansfield``: close over the benchmark's on the same last session, against its own mean of ``weeks``.

    benchmark: session_date, benchmark_close; one row per session (the last written of repeated ones isn't known, so the
    greatest close is taken)."""
    one = benchmark.groupBy("session_date").agg(F.max("benchmark_close").alias("benchmark_close"))
    w = Window.partitionBy("symbol").orderBy("week_start")
    both = (F.col("benchmark_close") > 0) & (F.col("adj_close") > 0)
    joined = weekly.join(one, "session_date", "left").withColumn("ratio", F.when(both, F.col("adj_close") / F.col("benchmark_close")))
    mean = Wf.rolling_mean(F.col("ratio"), w, weeks)
    return joined.withColumn("mansfield", F.when(mean > 0, F.col("ratio") / mean - 1))


def history_percentile(rows: DataFrame, value: str, limit: int, least: int, at: str = "date") -> DataFrame:
    """Non-null rows with ``percentile``: mid-rank among the last ``limit`` strictly earlier values of the symbol."""
    w = Window.partitionBy("symbol").orderBy(at).rowsBetween(-limit, -1)
    return rows.filter(F.col(value).isNotNull()).withColumn("percentile", Wf.percentile_midrank(F.col(value), F.collect_list(value).over(w), least))


#: Weeks that a weekly percentile looks back, and those it needs.
WEEKS, LEAST_WEEKS = 104, 26


def relative_strength_features(bars: DataFrame, benchmark: DataFrame, value: str) -> DataFrame:
    """(symbol, week_start, rs, mansfield, rs_slope_4w, mansfield_slope_4w, rs_percentile, mansfield_percentile), a row per symbol
    and week with bars.

    bars: with ``value``, whose rank on each date is the relative strength; the week takes the last rank it has. Slopes are
    null where any of four weeks is, percentiles are of the last WEEKS earlier weeks that have the value."""
    by_week = F.to_date(F.date_trunc("week", "date"))
    rs = relative_strength(bars, value).filter("rs is not null").groupBy("symbol", by_week.alias("week_start")).agg(F.max_by("rs", "date").alias("rs"))
    weeks = mansfield(weekly_bars(bars), benchmark).select("symbol", "week_start", "mansfield").join(rs, ["symbol", "week_start"], "left")
    weeks = weeks.withColumns({c: F.round(c, 8) for c in ("rs", "mansfield")})
    w = Window.partitionBy("symbol").orderBy("week_start")
    out = weeks.withColumns({f"{c}_slope_4w": Wf.slope(F.col(c), w, 4) for c in ("rs", "mansfield")})
    for c in ("rs", "mansfield"):
        # a column for each value's own weeks: a week without it neither counts nor ends the history
        earlier = F.collect_list(c).over(w.rowsBetween(Window.unboundedPreceding, -1))
        own = F.slice(earlier, F.greatest(F.size(earlier) - (WEEKS - 1), F.lit(1)), WEEKS)
        out = out.withColumn(f"{c}_percentile", Wf.percentile_midrank(F.col(c), own, LEAST_WEEKS))
    return out


def coverage(requested: DataFrame, bars: DataFrame, max_lag_days: int) -> DataFrame:
    """Of each requested symbol: last session, lag behind the newest of all, and MISSING, STALE or COVERED."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_session"))
    newest = last.agg(F.max("last_session")).first()[0]  # one value
    joined = requested.select("symbol").distinct().join(last, "symbol", "left")
    lag = F.datediff(F.lit(newest).cast("date"), "last_session")
    return joined.select("symbol", "last_session", lag.alias("lag_days"),
        F.when(F.col("last_session").isNull(), "MISSING").when(lag > max_lag_days, "STALE").otherwise("COVERED").alias("status"))
