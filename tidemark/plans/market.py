"""Queries over daily bars: weekly bars, rolling features, relative strength, source choice, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import normal as N
from ..functions import windows as Wf
from ..operators import market as M
from ..operators import rolling
from ..sources.tables import table
from .adapters import BARS_SQL, bars

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):  # noqa: ANN202
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _w() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def _r(*names: str) -> list:
    return [(F.round(n, 9) + 0.0).alias(n) for n in names]


@_query(f"""WITH {BARS_SQL} SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS week_start, arg_min(open, date) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, date) AS close, arg_max(adj_close, date) AS adj_close,
 sum(volume) AS volume, bool_and(is_adjusted) AS is_adjusted, max(date) AS session_date, count(*) AS sessions FROM bars GROUP BY ALL""")
def weekly_bars(spark: SparkSession, d: str) -> DataFrame:
    return M.weekly_bars(bars(spark, d))


@_query(f"""WITH {BARS_SQL} SELECT symbol, isoyear(date) AS iso_year, weekofyear(date) AS iso_week, arg_min(open, date) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY ALL""")
def iso_week_bars(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return b.groupBy("symbol", F.extract(F.lit("YEAROFWEEK"), "date").cast("long").alias("iso_year"), F.weekofyear("date").cast("long").alias("iso_week")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume")
    )


_FEATURES_SQL = f"""WITH {BARS_SQL},
a AS (SELECT *, lag(close, 63) OVER w AS close_3m_ago, max(close) OVER (w ROWS 251 PRECEDING) AS high_52w,
  min(close) OVER (w ROWS 251 PRECEDING) AS low_52w, min(close) OVER (w ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS prior_low_52w,
   CASE WHEN count(close) OVER (w ROWS 49 PRECEDING) >= 50 THEN avg(close) OVER (w ROWS 49 PRECEDING) END AS ma50, CASE
  WHEN count(close) OVER (w ROWS 19 PRECEDING) >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS ma20,
   CASE WHEN adj_close > 0 AND lag(adj_close) OVER w > 0 THEN adj_close / lag(adj_close) OVER w - 1 END AS daily_return,
   CASE WHEN count(volume) OVER (w ROWS 19 PRECEDING) >= 20 THEN median(volume) OVER (w ROWS 19 PRECEDING) END AS median_volume_20d, avg(close * volume) OVER (w ROWS 62 PRECEDING) AS adv63,
   CASE WHEN lag(adj_close) OVER w IS NOT NULL THEN sign(adj_close - lag(adj_close) OVER w) * volume END AS signed
   FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
b AS (SELECT *, CASE WHEN close_3m_ago > 0 THEN close / close_3m_ago - 1 END AS return_3m, CASE WHEN high_52w > 0 THEN close / high_52w - 1
  END AS drawdown_from_52_week_high, close <= prior_low_52w AS new_52_week_low, close > ma50 AS above_ma50,
   CASE WHEN count(daily_return) OVER (w ROWS 19 PRECEDING) >= 20 THEN stddev_samp(daily_return) OVER (w ROWS 19 PRECEDING) END AS volatility_20d,
  lag(median_volume_20d, 20) OVER w AS median_volume_20d_prior,
   (-2 * lag(ma20, 4) OVER w - lag(ma20, 3) OVER w + lag(ma20, 1) OVER w + 2 * ma20) / 10 AS ma20_slope_5d,
   CASE WHEN count(signed) OVER (w ROWS 19 PRECEDING) >= 20 THEN sum(signed) OVER (w ROWS 19 PRECEDING) / nullif(sum(CASE
  WHEN signed IS NOT NULL THEN volume END) OVER (w ROWS 19 PRECEDING), 0) END AS signed_volume_ratio_20d
   FROM a WINDOW w AS (PARTITION BY symbol ORDER BY date)),
c AS (SELECT *, CASE WHEN count(new_52_week_low) OVER (w ROWS 19 PRECEDING) >= 20 THEN NOT bool_or(new_52_week_low) OVER (w ROWS 19 PRECEDING) END AS no_new_52_week_low_20_sessions,
   CASE WHEN count(above_ma50) OVER (w ROWS 9 PRECEDING) >= 10 THEN CAST(sum(CAST(above_ma50 AS INT)) OVER (w ROWS 9 PRECEDING) AS BIGINT)
  END AS days_above_ma50_last10, lag(volatility_20d, 20) OVER w AS volatility_20d_prior
   FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date))
"""


def _features(spark: SparkSession, d: str, *names: str, plain: tuple[str, ...] = ()) -> DataFrame:
    return M.price_features(bars(spark, d)).select("symbol", "date", *plain, *_r(*names))


def _features_sql(*names: str, plain: tuple[str, ...] = ()) -> str:
    return _FEATURES_SQL + f"SELECT symbol, date, {', '.join([*plain, *[f'round({n}, 9) + 0.0 AS {n}' for n in names]])} FROM c"


def _feature_query(key: str, doc: str, *names: str, plain: tuple[str, ...] = ()) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return _features(spark, d, *names, plain=plain)

    f.__name__, f.__doc__ = key, doc
    QUERIES[key], SQL[key] = f, _features_sql(*names, plain=plain)


_feature_query("rolling_means", "Means of close over 20 and 50 sessions, null until the frame is full.", "ma20", "ma50")
_feature_query("return_3m", "Close against that of 63 sessions before.", "close_3m_ago", "return_3m")
_feature_query("high_low_52w", "Extremes of 252 sessions and the draw-down from the high.", "high_52w", "low_52w", "prior_low_52w", "drawdown_from_52_week_high")
_feature_query("new_low_flags", "New lows against the 252 sessions before, and 20 sessions without one.", plain=("new_52_week_low", "no_new_52_week_low_20_sessions"))
_feature_query("days_above_mean", "Sessions of the last ten that closed above their mean of 50.", plain=("above_ma50", "days_above_ma50_last10"))
_feature_query("volatility_20d", "Deviation of daily returns over 20 sessions, and that of 20 sessions before.", "daily_return", "volatility_20d", "volatility_20d_prior")
_feature_query("median_volume_20d", "Rolling median of volume, and that of 20 sessions before.", "median_volume_20d", "median_volume_20d_prior")
_feature_query("ma20_slope", "Least-squares slope of the mean of 20 over five sessions.", "ma20_slope_5d")
_feature_query("signed_volume_ratio", "Volume signed by the day's direction, over all volume of 20 sessions.", "signed_volume_ratio_20d")
@_query(f"""WITH {BARS_SQL}, t AS (SELECT symbol, date, CAST(close * volume AS DECIMAL(28, 4)) AS traded FROM bars)
SELECT symbol, date, CAST(sum(traded) OVER w AS DOUBLE) / nullif(count(traded) OVER w, 0) AS adv63 FROM t WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING)""")
def adv63(spark: SparkSession, d: str) -> DataFrame:
    """Mean traded value of 63 sessions, from the first on; summed in decimals, so in any order the same."""
    w = _w().rowsBetween(-62, 0)
    t = bars(spark, d).select("symbol", "date", (F.col("close") * F.col("volume")).cast("decimal(28,4)").alias("traded"))
    return t.select("symbol", "date", (F.sum("traded").over(w).cast("double") / F.nullif(F.count("traded").over(w).cast("double"), F.lit(0.0))).alias("adv63"))


@_query(_FEATURES_SQL + """SELECT symbol, date, round(ma50, 9) + 0.0 AS ma50, round(ma20, 9) + 0.0 AS ma20, round(return_3m, 9) + 0.0 AS return_3m,
  round(high_52w, 9) + 0.0 AS high_52w, new_52_week_low, round(volatility_20d, 9) + 0.0 AS volatility_20d, round(median_volume_20d,
  9) + 0.0 AS median_volume_20d, round(signed_volume_ratio_20d, 9) + 0.0 AS signed_volume_ratio_20d FROM c""")
def price_features(spark: SparkSession, d: str) -> DataFrame:
    """All rolling features of a series in one pass over it."""
    return _features(spark, d, "ma50", "ma20", "return_3m", "high_52w", "volatility_20d", "median_volume_20d", "signed_volume_ratio_20d", plain=("new_52_week_low",))


@_query(_FEATURES_SQL + """SELECT symbol, arg_max(date, date) AS date, arg_max(close, date) AS close, arg_max(round(ma50, 6),
  date) FILTER (date = last) AS ma50, arg_max(round(high_52w, 6), date) FILTER (date = last) AS high_52w FROM (SELECT *,
  max(date) OVER (PARTITION BY symbol) AS last FROM c) GROUP BY symbol""")
def latest_price_facts(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each symbol, by an aggregate, which combines before the shuffle where a rank would not."""
    f = M.price_features(bars(spark, d))
    return f.groupBy("symbol").agg(F.max_by(F.struct("date", "close", F.round("ma50", 6).alias("ma50"), F.round("high_52w", 6).alias("high_52w")), "date").alias("r")).select("symbol", "r.*")


_SPLIT_SQL = f"""WITH {BARS_SQL}, j AS (SELECT *, coalesce((close / nullif(greatest(lag(close) OVER w, 0), 0) <= 0.5
  OR close / nullif(greatest(lag(close) OVER w, 0), 0) >= 2) AND NOT (is_adjusted AND lag(is_adjusted) OVER w), false) AS jump FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY date)),
q AS (SELECT *, bool_or(jump) OVER (PARTITION BY symbol) AS discontinuous FROM j) """


@_query(_SPLIT_SQL + "SELECT symbol, date, jump, discontinuous FROM q")
def split_discontinuity(spark: SparkSession, d: str) -> DataFrame:
    return M.split_quarantine(bars(spark, d)).select("symbol", "date", "jump", "discontinuous")


@_query(_SPLIT_SQL + "SELECT symbol, count(*) AS rows_kept, sum(volume) AS volume FROM q WHERE NOT discontinuous GROUP BY symbol")
def split_quarantined_out(spark: SparkSession, d: str) -> DataFrame:
    """Symbols without a discontinuity."""
    return M.split_quarantine(bars(spark, d)).filter("not discontinuous").groupBy("symbol").agg(F.count("*").alias("rows_kept"), F.sum("volume").alias("volume"))


_RS_SQL = _FEATURES_SQL + """, r AS (SELECT symbol, date, return_3m, count(return_3m) OVER (PARTITION BY date) AS n, rank() OVER (PARTITION BY date
  ORDER BY return_3m NULLS LAST) AS k, count(return_3m) OVER (PARTITION BY date, return_3m) AS t FROM c),
rs AS (SELECT symbol, date, CASE WHEN return_3m IS NULL THEN NULL WHEN n = 1 THEN 50.0 ELSE (k + (t - 1) / 2.0 - 1) / (n - 1) * 100 END AS rs FROM r) """


@_query(_RS_SQL + "SELECT symbol, date, round(rs, 9) + 0.0 AS rs FROM rs")
def ordinary_rs(spark: SparkSession, d: str) -> DataFrame:
    """Cross-sectional average rank of the three-month return on each date, from 0 to 100."""
    return M.relative_strength(M.price_features(bars(spark, d)), "return_3m").select("symbol", "date", *_r("rs"))


@_query(_RS_SQL + "SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS week_start, arg_max(round(rs, 6), date) AS rs FROM rs WHERE rs IS NOT NULL GROUP BY ALL")
def weekly_rs(spark: SparkSession, d: str) -> DataFrame:
    """Last known relative strength of each week."""
    r = M.relative_strength(M.price_features(bars(spark, d)), "return_3m").filter("rs is not null")
    return r.groupBy("symbol", F.to_date(F.date_trunc("week", "date")).alias("week_start")).agg(F.max_by(F.round("rs", 6), "date").alias("rs"))


_BENCH_SQL = "bench AS (SELECT date AS session_date, exp(avg(ln(adj_close))) AS benchmark_close FROM bars WHERE adj_close > 0 GROUP BY date)"
_WEEK_SQL = "wk AS (SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS week_start, arg_max(adj_close, date) AS adj_close, max(date) AS session_date FROM bars GROUP BY ALL)"
_MANSFIELD_CTES = f"""{_BENCH_SQL}, {_WEEK_SQL},
x AS (SELECT wk.*, CASE WHEN benchmark_close > 0 AND adj_close > 0 THEN adj_close / benchmark_close END AS ratio FROM wk LEFT JOIN bench USING (session_date)),
m AS (SELECT *, CASE WHEN count(ratio) OVER (w ROWS 51 PRECEDING) >= 52 THEN avg(ratio) OVER (w ROWS 51 PRECEDING) END AS mean FROM x WINDOW w AS (PARTITION BY symbol ORDER BY week_start)),
f AS (SELECT symbol, week_start, CASE WHEN mean > 0 THEN ratio / mean - 1 END AS mansfield FROM m) """
_MANSFIELD_SQL = f"WITH {BARS_SQL}, {_MANSFIELD_CTES}"


def _benchmark(b: DataFrame) -> DataFrame:
    """The market as the geometric mean of its closes."""
    return b.filter("adj_close > 0").groupBy(F.col("date").alias("session_date")).agg(F.exp(F.avg(F.log("adj_close"))).alias("benchmark_close"))


def _mansfield(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    return M.mansfield(M.weekly_bars(b), _benchmark(b))


@_query(_MANSFIELD_SQL + "SELECT symbol, week_start, round(mansfield, 9) + 0.0 AS mansfield FROM f")
def mansfield_market(spark: SparkSession, d: str) -> DataFrame:
    """Weekly strength against a benchmark joined by the very same last session."""
    return _mansfield(spark, d).select("symbol", "week_start", *_r("mansfield"))


@_query(f"""WITH {BARS_SQL}, {_WEEK_SQL}, sb AS (SELECT provider AS etf, date AS session_date, exp(avg(ln(adj_close))) AS benchmark_close FROM bars WHERE adj_close > 0 GROUP BY ALL),
own AS (SELECT symbol, min(provider) AS etf FROM bars GROUP BY symbol)
SELECT symbol, week_start, etf, round(adj_close / nullif(benchmark_close, 0), 6) AS ratio FROM wk JOIN own USING (symbol) LEFT JOIN sb USING (etf, session_date)""")
def sector_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Each symbol against the benchmark its group names: one join on (benchmark, session), no loop over benchmarks."""
    b = bars(spark, d)
    bench = b.filter("adj_close > 0").groupBy(F.col("provider").alias("etf"), F.col("date").alias("session_date")).agg(F.exp(F.avg(F.log("adj_close"))).alias("benchmark_close"))
    own = b.groupBy("symbol").agg(F.min("provider").alias("etf"))
    j = M.weekly_bars(b).join(own, "symbol").join(bench, ["etf", "session_date"], "left")
    return j.select("symbol", "week_start", "etf", F.round(F.col("adj_close") / F.nullif(F.col("benchmark_close"), F.lit(0.0)), 6).alias("ratio"))


@_query(_MANSFIELD_SQL + """SELECT symbol, week_start, round(s, 9) + 0.0 AS slope_4w, round(s, 9) > 0 AS improving FROM (SELECT symbol, week_start,
 lag(mansfield, 3) OVER w * -0.3 + lag(mansfield, 2) OVER w * -0.1 + lag(mansfield, 1) OVER w * 0.1 + mansfield * 0.3 AS s FROM f WINDOW w AS (PARTITION BY symbol ORDER BY week_start))""")
def slope_4w(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares slope over four weeks, null where any of them is."""
    s = Wf.slope(F.col("mansfield"), Window.partitionBy("symbol").orderBy("week_start"), 4)
    return _mansfield(spark, d).withColumn("slope_4w", s).select("symbol", "week_start", (F.round("slope_4w", 9) + 0.0).alias("slope_4w"), (F.round("slope_4w", 9) > 0).alias("improving"))


def _percentile_sql(value: str) -> str:
    """Of each week that has ``value``, its mid-rank among the earlier weeks that have it."""
    return f"""h_{value} AS (SELECT symbol, week_start, {value} AS v, row_number() OVER (PARTITION BY symbol ORDER BY week_start) AS n FROM weeks WHERE {value} IS NOT NULL),
p_{value} AS (SELECT a.symbol, a.week_start, CASE WHEN count(b.v) < {M.LEAST_WEEKS} THEN 50.0
  ELSE 100.0 * (count(*) FILTER (b.v < a.v) + count(*) FILTER (b.v = a.v) / 2.0) / count(b.v) END AS {value}_percentile
  FROM h_{value} a LEFT JOIN h_{value} b ON a.symbol = b.symbol AND b.n < a.n AND b.n >= a.n - {M.WEEKS} GROUP BY a.symbol, a.week_start)"""


def _slope_sql(value: str) -> str:
    return f"round(lag({value}, 3) OVER w * -0.3 + lag({value}, 2) OVER w * -0.1 + lag({value}, 1) OVER w * 0.1 + {value} * 0.3, 7) + 0.0 AS {value}_slope_4w"


@_query(_RS_SQL + f""", {_MANSFIELD_CTES}, rw AS (SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS week_start, arg_max(rs, date) AS rs FROM rs WHERE rs IS NOT NULL GROUP BY ALL),
weeks AS (SELECT f.symbol, f.week_start, round(rw.rs, 8) AS rs, round(f.mansfield, 8) AS mansfield FROM f LEFT JOIN rw ON rw.symbol = f.symbol AND rw.week_start = f.week_start),
{_percentile_sql("rs")}, {_percentile_sql("mansfield")}
SELECT symbol, week_start, rs + 0.0 AS rs, mansfield + 0.0 AS mansfield, {_slope_sql("rs")}, {_slope_sql("mansfield")}, round(rs_percentile,
  6) AS rs_percentile, round(mansfield_percentile, 6) AS mansfield_percentile
FROM weeks LEFT JOIN p_rs USING (symbol, week_start) LEFT JOIN p_mansfield USING (symbol, week_start) WINDOW w AS (PARTITION BY symbol ORDER BY week_start)""")
def relative_strength_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of relative strength by week, their slopes, and their percentiles among up to 104 earlier weeks."""
    f = M.price_features(bars(spark, d))
    r = M.relative_strength_features(f, _benchmark(f), "return_3m")
    slopes = {f"{c}_slope_4w": F.round(f"{c}_slope_4w", 7) + 0.0 for c in ("rs", "mansfield")}
    percentiles = {f"{c}_percentile": F.round(f"{c}_percentile", 6) for c in ("rs", "mansfield")}
    return r.withColumns({**slopes, **percentiles, "rs": F.col("rs") + 0.0, "mansfield": F.col("mansfield") + 0.0})


_MIDRANK_SQL = _FEATURES_SQL + """, v AS (SELECT symbol, date, round(volatility_20d, 8) AS x, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n
  FROM c WHERE volatility_20d IS NOT NULL)
SELECT a.symbol, a.date, round(CASE WHEN count(b.x) < 60 THEN 50.0 ELSE 100.0 * (count(*) FILTER (b.x < a.x) + count(*) FILTER (b.x = a.x) / 2.0) / count(b.x) END, 9) + 0.0 AS percentile
FROM v a LEFT JOIN v b ON a.symbol = b.symbol AND b.n < a.n AND b.n >= a.n - 252 GROUP BY a.symbol, a.date"""


@_query(_MIDRANK_SQL)
def midrank_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Percentile of today's volatility among the last 252 strictly earlier ones; 50 until there are 60."""
    f = M.price_features(bars(spark, d))
    return M.history_percentile(f.withColumn("volatility_20d", F.round("volatility_20d", 8)), "volatility_20d", 252, 60).select("symbol", "date", *_r("percentile"))


@_query(f"""WITH {BARS_SQL}, req AS (SELECT DISTINCT upper(trim(ticker)) AS symbol FROM identity_snapshots WHERE ticker IS NOT NULL UNION SELECT DISTINCT symbol FROM bars),
l AS (SELECT symbol, max(date) AS last_session FROM bars GROUP BY symbol), m AS (SELECT max(date) AS newest FROM bars)
SELECT symbol, last_session, date_diff('day', last_session, newest) AS lag_days, CASE WHEN last_session IS NULL THEN 'MISSING' WHEN date_diff('day',
  last_session, newest) > 10 THEN 'STALE' ELSE 'COVERED' END AS status FROM req LEFT JOIN l USING (symbol), m""")
def market_coverage(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    wanted = table(spark, d, "identity_snapshots").filter("ticker is not null").select(F.upper(F.trim("ticker")).alias("symbol")).union(b.select("symbol"))
    return M.coverage(wanted, b, 10).withColumn("lag_days", F.col("lag_days").cast("long"))


@_query("""WITH b AS (SELECT DISTINCT upper(trim(symbol)) AS symbol, date, provider, CAST(close AS DOUBLE) AS close FROM daily_bars),
p AS (SELECT symbol, provider, max(date) AS fresh FROM b GROUP BY ALL),
x AS (SELECT b.symbol, b.provider, max(c.date) AS overlap, arg_max(b.close, b.date) AS own, arg_max(c.med, b.date) AS med FROM b JOIN (SELECT symbol,
  date, median(close) AS med, count(*) AS n FROM b GROUP BY ALL HAVING count(*) > 1) c USING (symbol, date) GROUP BY ALL),
o AS (SELECT p.symbol, p.provider, p.fresh, coalesce(abs(own / nullif(med, 0) - 1) <= 0.05, true) AS agrees FROM p LEFT JOIN x USING (symbol, provider))
SELECT symbol, arg_min(provider, (CASE WHEN agrees THEN 0 ELSE 1 END, -date_diff('day', DATE '1970-01-01', fresh), provider)) AS chosen,
  count(*) AS providers, count(*) FILTER (agrees) AS agreeing FROM o GROUP BY symbol""")
def redundant_source_choice(spark: SparkSession, d: str) -> DataFrame:
    """Of several providers the freshest whose last session shared with others lies within 5 % of their median."""
    b = table(spark, d, "daily_bars").select(N.symbol(F.col("symbol")).alias("symbol"), "date", "provider", F.col("close").cast("double").alias("close")).distinct()
    shared = b.groupBy("symbol", "date").agg(F.percentile("close", 0.5).alias("med"), F.count("*").alias("n")).filter("n > 1")
    last = b.join(shared, ["symbol", "date"]).groupBy("symbol", "provider").agg(F.max_by("close", "date").alias("own"), F.max_by("med", "date").alias("med"))
    o = b.groupBy("symbol", "provider").agg(F.max("date").alias("fresh")).join(last, ["symbol", "provider"], "left")
    o = o.withColumn("agrees", F.coalesce(F.abs(F.col("own") / F.nullif(F.col("med"), F.lit(0.0)) - 1) <= 0.05, F.lit(True)))
    best = F.min_by("provider", F.struct(F.when(F.col("agrees"), 0).otherwise(1), -F.unix_date("fresh"), "provider"))
    return o.groupBy("symbol").agg(best.alias("chosen"), F.count("*").alias("providers"), F.count_if("agrees").alias("agreeing"))


@_query("""WITH s AS (SELECT DISTINCT upper(trim(symbol)) AS symbol FROM daily_bars WHERE symbol IS NOT NULL) SELECT symbol, (row_number() OVER (ORDER BY symbol) - 1) % 3 AS shard FROM s""")
def symbol_shards(spark: SparkSession, d: str) -> DataFrame:
    """Distinct symbols dealt over three shards in order. The order number comes from sorted partitions and their sizes,
    not from one window over everything."""
    s = table(spark, d, "daily_bars").select(N.symbol(F.col("symbol")).alias("symbol")).filter("symbol is not null").distinct()
    ranked = rolling.ordered_index(s, ["symbol"], "i")
    return ranked.select("symbol", (F.col("i") % 3).alias("shard"))


@_query(f"""WITH {BARS_SQL}, f AS (SELECT symbol, date, coalesce(volume, 0) <= 0 AS dead, count(*) OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars),
t AS (SELECT *, sum(CASE WHEN dead THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY date DESC) AS alive FROM f) SELECT symbol,
  count(*) FILTER (alive = 0) AS tail, min(date) FILTER (alive = 0) AS tail_from FROM t GROUP BY symbol""")
def terminal_tail(spark: SparkSession, d: str) -> DataFrame:
    """Trailing run of sessions without volume."""
    w = Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    t = bars(spark, d).select("symbol", "date", (F.coalesce("volume", F.lit(0.0)) <= 0).alias("dead")).withColumn("alive", F.sum(F.when(F.col("dead"), 0).otherwise(1)).over(w))
    return t.groupBy("symbol").agg(F.count_if(F.col("alive") == 0).alias("tail"), F.min(F.when(F.col("alive") == 0, F.col("date"))).alias("tail_from"))


@_query(f"""WITH {BARS_SQL}, f AS (SELECT symbol, date, close > lag(close) OVER (PARTITION BY symbol ORDER BY date) AS up FROM bars),
g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - row_number() OVER (PARTITION BY symbol, up ORDER BY date) AS island FROM f),
n AS (SELECT symbol, count(*) AS n FROM g WHERE up GROUP BY symbol, island) SELECT symbol, max(n) AS longest_run FROM n GROUP BY symbol""")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    """Longest run of rising closes."""
    f = bars(spark, d).select("symbol", "date", (F.col("close") > F.lag("close").over(_w())).alias("up"))
    island = F.row_number().over(_w()) - F.row_number().over(Window.partitionBy("symbol", "up").orderBy("date"))
    return f.withColumn("island", island).filter("up").groupBy("symbol", "island").count().groupBy("symbol").agg(F.max("count").alias("longest_run"))


@_query(f"""WITH {BARS_SQL}, i AS (SELECT symbol, session_idx, lead(session_idx) OVER (PARTITION BY symbol
  ORDER BY session_idx) - session_idx - 1 AS gap FROM bars JOIN market_sessions ON date = session_date)
SELECT symbol, CAST(max(gap) AS BIGINT) AS max_gap, CAST(arg_max(session_idx, (gap, -session_idx)) FILTER (gap IS NOT NULL) AS BIGINT) AS gap_after FROM i GROUP BY symbol""")
def max_gap(spark: SparkSession, d: str) -> DataFrame:
    """Most sessions missing between two bars of a symbol, and after which session."""
    j = bars(spark, d).join(table(spark, d, "market_sessions"), F.col("date") == F.col("session_date"))
    g = j.select("symbol", F.col("session_idx").cast("long").alias("i")).withColumn("gap", F.lead("i").over(Window.partitionBy("symbol").orderBy("i")) - F.col("i") - 1)
    return g.groupBy("symbol").agg(F.max("gap").alias("max_gap"), F.max_by("i", F.when(F.col("gap").isNotNull(), F.struct("gap", -F.col("i")))).alias("gap_after"))


@_query(f"""WITH {BARS_SQL}, c AS (SELECT symbol, date, close, avg(close) OVER (w ROWS 89 PRECEDING) AS basis FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
x AS (SELECT *, close > basis AND lag(close) OVER w <= lag(basis) OVER w AS crossed FROM c WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, coalesce(bool_or(crossed) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING), false) AS fresh_cross FROM x""")
def fresh_cross(spark: SparkSession, d: str) -> DataFrame:
    """Whether close came up over a moving basis within the last ten sessions."""
    c = bars(spark, d).withColumn("basis", F.avg("close").over(_w().rowsBetween(-89, 0)))
    crossed = (F.col("close") > F.col("basis")) & (F.lag("close").over(_w()) <= F.lag("basis").over(_w()))
    return c.withColumn("crossed", crossed).select("symbol", "date", F.coalesce(F.bool_or("crossed").over(_w().rowsBetween(-9, 0)), F.lit(False)).alias("fresh_cross"))


@_query(f"""WITH {BARS_SQL}, r AS (SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS week_start, arg_max(close, date) AS close FROM bars
  GROUP BY ALL) SELECT symbol, week_start, close FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY week_start DESC) <= 26""")
def last_26_weeks(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("week_start"))
    return M.weekly_bars(bars(spark, d)).withColumn("rn", F.row_number().over(w)).filter("rn <= 26").select("symbol", "week_start", "close")


@_query(f"""WITH {BARS_SQL}, g AS (SELECT symbol, date, array_agg(volume) OVER (w ROWS 9 PRECEDING) AS v,
  array_agg(close) OVER (w ROWS 10 PRECEDING) AS c FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)), b AS (SELECT symbol, date, close,
  volume, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM bars)
SELECT symbol, round(sum(sign(close - p) * volume) / nullif(sum(volume) FILTER (p IS NOT NULL), 0), 6) AS ratio FROM b WHERE p IS NOT NULL AND volume IS NOT NULL GROUP BY symbol""")
def signed_volume_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The signed volume ratio of whole histories held as arrays, by higher-order functions."""
    a = bars(spark, d).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "close", "volume"))).alias("h"))
    steps = F.zip_with(F.slice("h", 1, F.greatest(F.size("h") - 1, F.lit(0))), F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(0))), lambda x,
        y: F.struct((F.signum(y["close"] - x["close"]) * y["volume"]).alias("s"), y["volume"].alias("v")))
    a = a.withColumn("steps", F.filter(steps, lambda t: t["v"].isNotNull())).filter(F.size("steps") > 0)
    total = lambda f: F.aggregate("steps", F.lit(0.0), lambda acc, t: acc + t[f])
    return a.select("symbol", F.round(total("s") / F.nullif(total("v"), F.lit(0.0)), 6).alias("ratio"))
