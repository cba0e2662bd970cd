"""Queries of event studies: scheduling, spacing, outcomes and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import fold
from ..operators import quantiles as Q
from ..operators import study as S
from .adapters import BARS_SQL, SIGNALS_SQL, bars, sessions, signals
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
HORIZONS = (21, 63, 126)


def _scheduled(spark: SparkSession, d: str) -> DataFrame:
    return S.session_at_or_after(signals(spark, d), sessions(spark, d), "known_at")


_SCHED = f"WITH {SIGNALS_SQL}, sch AS (SELECT sig.*, CAST(s.session_idx AS BIGINT) AS session_idx FROM sig ASOF LEFT JOIN market_sessions s ON sig.known_at <= s.close_utc)"


@query(_SCHED + " SELECT signal_id, session_idx, session_idx + 1 AS entry_idx FROM sch")
def schedule_events(spark: SparkSession, d: str) -> DataFrame:
    """The session at which each signal can be evaluated, and the next, at which it can be acted on."""
    return _scheduled(spark, d).select("signal_id", "session_idx", (F.col("session_idx") + 1).alias("entry_idx"))


@query(_SCHED.replace("WITH ", "WITH RECURSIVE ", 1) + """, u AS (SELECT DISTINCT cik, family, session_idx FROM sch WHERE cik IS NOT NULL AND family IS NOT NULL AND session_idx IS NOT NULL),
k AS (SELECT cik, family, min(session_idx) AS session_idx FROM u GROUP BY ALL UNION ALL SELECT u.cik, u.family, min(u.session_idx) FROM k
  JOIN u ON u.cik = k.cik AND u.family = k.family AND u.session_idx >= k.session_idx + 21 GROUP BY u.cik, u.family, k.session_idx)
SELECT cik, family, session_idx FROM k""")
def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of an issuer and family kept when 21 sessions after the last one kept."""
    return fold.greedy_spacing(_scheduled(spark, d), ["cik", "family"], "session_idx", 21)


@query(_SCHED.replace("WITH ", "WITH RECURSIVE ", 1) + """, u AS (SELECT DISTINCT cik, signal_type, date_diff('day', DATE '1970-01-01',
  CAST(known_at AS DATE)) AS day FROM sch WHERE cik IS NOT NULL AND signal_type IS NOT NULL AND known_at IS NOT NULL),
k AS (SELECT cik, signal_type, min(day) AS day FROM u GROUP BY ALL UNION ALL SELECT u.cik, u.signal_type, min(u.day) FROM k JOIN u ON u.cik = k.cik
  AND u.signal_type = k.signal_type AND u.day >= k.day + 14 GROUP BY u.cik, u.signal_type, k.day)
SELECT cik, signal_type, CAST(count(*) AS BIGINT) AS alerts FROM k GROUP BY ALL""")
def alert_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """How many alerts are left of each issuer and type with 14 days between them."""
    s = signals(spark, d).withColumn("day", F.unix_date(F.to_date("known_at")))
    return fold.greedy_spacing(s, ["cik", "signal_type"], "day", 14).groupBy("cik", "signal_type").agg(F.count("*").alias("alerts"))


_STEPS = _SCHED + """, s AS (SELECT cik, session_idx, max(score) AS score FROM sch WHERE cik IS NOT NULL AND session_idx IS NOT NULL
  AND score IS NOT NULL GROUP BY ALL), o AS (SELECT cik, session_idx, score, row_number() OVER (PARTITION BY cik ORDER BY session_idx) AS n FROM s)"""


@query(_STEPS.replace("WITH ", "WITH RECURSIVE ", 1) + """, m AS (SELECT cik, n, session_idx, CASE WHEN score >= 60 THEN 1 ELSE 0 END AS level, CASE
  WHEN score < 40 THEN 1 ELSE 0 END AS failed FROM o WHERE n = 1
UNION ALL SELECT o.cik, o.n, o.session_idx, CASE WHEN score >= 60 THEN least(level + 1, 4) WHEN score < 40 AND failed + 1 >= 2 THEN greatest(level - 1, 0) ELSE level END,
 CASE WHEN score < 40 THEN CASE WHEN failed + 1 >= 2 THEN 0 ELSE failed + 1 END ELSE 0 END FROM m JOIN o ON o.cik = m.cik AND o.n = m.n + 1)
  SELECT cik, session_idx, CAST(level AS BIGINT) AS level FROM m""")
def state_machine(spark: SparkSession, d: str) -> DataFrame:
    """A level per issuer that rises a step at a time and falls after two failures running."""
    s = _scheduled(spark, d).filter("cik is not null and session_idx is not null and score is not null").groupBy("cik", "session_idx").agg(F.max("score").alias("score"))
    a = s.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct("session_idx", (F.col("score") >= 60).alias("up"), (F.col("score") < 40).alias("down")))).alias("steps"))
    paths = a.select("cik", F.arrays_zip(F.transform("steps", lambda x: x["session_idx"]).alias("i"), fold.hysteresis(F.lit(0), F.col("steps"), 4, 2).alias("level")).alias("z"))
    return paths.select("cik", F.explode("z").alias("z")).select("cik", F.col("z.i").alias("session_idx"), F.col("z.level").cast("long").alias("level"))


@query(_SCHED + """ SELECT session_idx, signal_id FROM sch WHERE session_idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_idx
  ORDER BY score DESC NULLS LAST, ticker NULLS LAST, signal_id) <= greatest(1, ceil(count(*) OVER (PARTITION BY session_idx) * 0.1))""")
def top_decile(spark: SparkSession, d: str) -> DataFrame:
    """The best tenth of each session's signals."""
    s = _scheduled(spark, d).filter("session_idx is not null")
    return S.top_share(s, ["session_idx"], [F.desc_nulls_last("score"), F.asc_nulls_last("ticker"), F.asc("signal_id")], 0.1).select("session_idx", "signal_id")


def _bars(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).filter("close > 0")
    return b.join(sessions(spark, d), F.col("date") == F.col("session_date")).select("symbol", "date", "provider",
        F.col("session_idx").cast("long").alias("session_idx"), "open", "low", "close")


_OUT = f"""WITH {BARS_SQL}, bi AS (SELECT symbol, date, provider, CAST(session_idx AS BIGINT) AS session_idx, open, low, close FROM bars
  JOIN market_sessions ON date = session_date WHERE close > 0),
e AS (SELECT a.symbol, a.session_idx, a.date, a.provider, n.open AS entry, h.h AS horizon FROM bi a CROSS JOIN (VALUES (21), (63), (126)) h(h) LEFT
  JOIN bi n ON n.symbol = a.symbol AND n.session_idx = a.session_idx + 1),
p AS (SELECT e.symbol, e.session_idx, e.horizon, min(b.low) AS low, count(b.low) AS n FROM e LEFT JOIN bi b ON b.symbol = e.symbol
  AND b.session_idx BETWEEN e.session_idx + 1 AND e.session_idx + 1 + e.horizon GROUP BY ALL),
o AS (SELECT e.symbol, e.session_idx, e.date, e.provider, CAST(e.horizon AS BIGINT) AS horizon, CASE WHEN entry > 0 THEN x.close / entry - 1
  END AS forward_return, CASE WHEN entry > 0 AND p.n = e.horizon + 1 THEN p.low / entry - 1 END AS worst, p.n = e.horizon + 1 AS complete
 FROM e JOIN p ON p.symbol = e.symbol AND p.session_idx = e.session_idx AND p.horizon = e.horizon LEFT JOIN bi x ON x.symbol = e.symbol AND x.session_idx = e.session_idx + 1 + e.horizon)
"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    return S.forward_outcomes(_bars(spark, d), HORIZONS)


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    b = _bars(spark, d).select("symbol", "session_idx", "date", "provider")
    return _outcomes(spark, d).join(b, ["symbol", "session_idx"])


@query(_OUT + "SELECT symbol, session_idx, horizon, round(forward_return, 9) + 0.0 AS forward_return, round(worst, 9) + 0.0 AS worst, complete FROM o")
def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    """Exact-session outcomes of entering at every bar, with the worst point on the way."""
    return _outcomes(spark, d).withColumns({"forward_return": F.round("forward_return", 9) + 0.0, "worst": F.round("worst", 9) + 0.0})


_SUMMARY = "count(*) AS events, count(forward_return) AS outcomes, round(avg(forward_return), 8) + 0.0 AS mean, round(median(forward_return), 8) + 0.0 AS median, round(avg(CASE WHEN forward_return > 0 THEN 1.0 WHEN forward_return IS NOT NULL THEN 0.0 END), 8) AS win_rate, round(quantile_cont(forward_return, 0.1), 8) + 0.0 AS p10, round(median(worst), 8) + 0.0 AS median_worst"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) + 0.0 for c in ("mean", "median", "win_rate", "p10", "median_worst") if c in df.columns})


@query(_OUT + f"SELECT horizon, {_SUMMARY} FROM o GROUP BY horizon")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(S.summary(_outcomes(spark, d), ["horizon"]))


@query(_OUT + f"""SELECT horizon, year(date) AS year, provider, GROUPING_ID(year(date), provider) AS level, {_SUMMARY} FROM o
  GROUP BY GROUPING SETS ((horizon, year(date)), (horizon, provider), (horizon))""")
def regime_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes by period, by group and together: each outcome goes to its three groups, as grouping sets would send it."""
    g = _grouped(spark, d)
    none = F.lit(None)
    sets = [(F.year("date").cast("long"), none.cast("string"), 1), (none.cast("long"), F.col("provider"), 2), (none.cast("long"), none.cast("string"), 3)]
    keys = F.explode(F.array(*[F.struct(y.alias("year"), p.alias("provider"), F.lit(n).cast("long").alias("level")) for y, p, n in sets]))
    long = g.select("horizon", keys.alias("k"), "forward_return", "worst").select("horizon", "k.*", "forward_return", "worst")
    return _rounded(S.summary(long, ["horizon", "year", "provider", "level"]))


@query(_OUT + """, r AS (SELECT symbol, session_idx, unnest(list_filter([CASE WHEN forward_return IS NULL THEN 'NO_EXIT_' || horizon END, CASE
  WHEN NOT complete THEN 'GAP_' || horizon END], lambda x: x IS NOT NULL)) AS reason FROM o) SELECT reason, count(DISTINCT (symbol,
  session_idx)) AS events FROM r GROUP BY reason""")
def attrition(spark: SparkSession, d: str) -> DataFrame:
    """Why events have no or no full outcome: a histogram of reasons, each once per event."""
    o = _outcomes(spark, d)
    reasons = F.array_compact(F.array(F.when(F.col("forward_return").isNull(), F.concat(F.lit("NO_EXIT_"), F.col("horizon"))),
        F.when(~F.col("complete"), F.concat(F.lit("GAP_"), F.col("horizon")))))
    return o.select("symbol", "session_idx", F.explode(reasons).alias("reason")).distinct().groupBy("reason").agg(F.count("*").alias("events"))


_RANKED = _OUT + """, q AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY forward_return, symbol, session_idx) AS k,
  count(*) OVER (PARTITION BY horizon) AS n FROM o WHERE forward_return IS NOT NULL)"""


@query(_RANKED + "SELECT horizon, count(*) AS kept, round(avg(forward_return), 8) + 0.0 AS trimmed_mean FROM q WHERE k > floor(n * 0.05) AND k <= n - floor(n * 0.05) GROUP BY horizon")
def trimmed_tail(spark: SparkSession, d: str) -> DataFrame:
    """Mean without the lowest and highest 5 %."""
    t = Q.trimmed_means(_outcomes(spark, d), ["horizon"], "forward_return", 0.05)
    return t.withColumn("trimmed_mean", F.round("trimmed_mean", 8) + 0.0)


@query(_OUT + """, t AS (SELECT horizon, CAST(floor(count(forward_return) * 0.01) AS BIGINT) AS k FROM o GROUP BY horizon), q AS (SELECT o.*,
  row_number() OVER (PARTITION BY horizon ORDER BY forward_return DESC, symbol, session_idx) AS rn FROM o WHERE forward_return IS NOT NULL)
  SELECT horizon, count(*) AS top, round(sum(forward_return), 6) AS top_sum, count(DISTINCT symbol) AS symbols FROM q JOIN t USING (horizon)
  WHERE rn <= k GROUP BY horizon""")
def top1pct(spark: SparkSession, d: str) -> DataFrame:
    """The best hundredth of all outcomes and how many symbols it comes from."""
    top = Q.top_rows(_outcomes(spark, d), ["horizon"], "forward_return", F.floor(F.col("n") * 0.01), ["symbol", "session_idx"])
    return top.groupBy("horizon").agg(F.count("*").alias("top"), F.round(F.sum("forward_return"), 6).alias("top_sum"), F.count_distinct("symbol").alias("symbols"))


@query(_OUT + """, s AS (SELECT horizon, symbol, avg(forward_return) AS m, count(forward_return) AS n FROM o GROUP BY ALL) SELECT horizon,
  count(m) AS symbols, round(avg(m), 8) + 0.0 AS equal_weight, median(n) AS median_count, max(n) AS largest FROM s GROUP BY horizon""")
def group_dependence(spark: SparkSession, d: str) -> DataFrame:
    """Mean of means by symbol, and how unevenly events are spread."""
    s = _outcomes(spark, d).groupBy("horizon", "symbol").agg(F.avg("forward_return").alias("m"), F.count("forward_return").alias("n"))
    return s.groupBy("horizon").agg(F.count("m").alias("symbols"), (F.round(F.avg("m"), 8) + 0.0).alias("equal_weight"),
        F.percentile("n", 0.5).alias("median_count"), F.max("n").alias("largest"))


@query(_SCHED + """, b AS (SELECT strftime(CAST(known_at AS DATE), '%Y-%m') AS bucket, count(*) AS n FROM sch GROUP BY ALL),
  t AS (SELECT sum(n) AS total FROM b) SELECT round(sum((n / total) * (n / total)), 10) AS hhi, count(*) AS buckets, CAST(max(n) AS BIGINT) AS largest
  FROM b, t""")
def temporal_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Concentration of signals over months."""
    b = signals(spark, d).groupBy(F.date_format("known_at", "yyyy-MM").alias("bucket")).agg(F.count("*").alias("n"))
    t = b.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.count("*").alias("buckets"), F.max("n").alias("largest"))
    return t.select(F.round(F.col("sq") / (F.col("total") * F.col("total")), 10).alias("hhi"), "buckets", "largest")


@query(_OUT + """, y AS (SELECT DISTINCT year(date) AS year FROM o) SELECT y.year, o.horizon, count(forward_return) AS outcomes,
  round(avg(forward_return), 8) + 0.0 AS mean FROM y JOIN o ON year(o.date) <> y.year GROUP BY ALL HAVING count(forward_return) > 0""")
def leave_one_year_out(spark: SparkSession, d: str) -> DataFrame:
    """Means without each year, as total less the year's own: the rows are not read once per year."""
    g = _grouped(spark, d).groupBy(F.year("date").cast("long").alias("year"), "horizon").agg(F.count("forward_return").alias("n"), F.coalesce(F.sum("forward_return"), F.lit(0.0)).alias("s"))
    all_ = g.groupBy("horizon").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.collect_set("year").alias("years"))  # every horizon has every year
    grid = all_.select("horizon", "all_n", "all_s", F.explode("years").alias("year"))
    left = grid.join(g, ["year", "horizon"], "left").na.fill(0, ["n", "s"])
    return left.select("year", "horizon", (F.col("all_n") - F.col("n")).alias("outcomes"),
        ((F.col("all_s") - F.col("s")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))).alias("mean")).filter("outcomes > 0").withColumn("mean",
        F.round("mean", 8) + 0.0)


@query(_SCHED + """, g AS (SELECT cik, session_idx, min(known_at) AS first_known, max(known_at) AS last_known,
  list_sort(list_distinct(list(ticker))) AS tickers, count(*) AS n FROM sch WHERE session_idx IS NOT NULL AND cik IS NOT NULL GROUP BY ALL) SELECT cik,
  session_idx, first_known, last_known, tickers, n FROM g""")
def issuer_session_events(spark: SparkSession, d: str) -> DataFrame:
    """Signals of one issuer and session as one event."""
    s = _scheduled(spark, d).filter("session_idx is not null and cik is not null")
    return s.groupBy("cik", "session_idx").agg(F.min("known_at").alias("first_known"), F.max("known_at").alias("last_known"),
        F.array_sort(F.collect_set("ticker")).alias("tickers"), F.count("*").alias("n"))


@query(_SCHED + """, a AS (SELECT DISTINCT cik, session_idx, ticker FROM sch WHERE signal_type = 'CEO_BUY'), b AS (SELECT DISTINCT cik, session_idx,
  ticker FROM sch WHERE signal_type = 'CLUSTER_BUY') SELECT cik, session_idx, bool_or(a.ticker = b.ticker) AS same_ticker FROM a JOIN b USING (cik,
  session_idx) GROUP BY ALL""")
def event_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Issuer sessions that two kinds of events share, and whether any ticker agrees."""
    s = _scheduled(spark, d).select("cik", "session_idx", "ticker", "signal_type").filter("cik is not null and session_idx is not null")
    of = lambda kind: s.filter(F.col("signal_type") == kind).groupBy("cik", "session_idx").agg(F.collect_set("ticker").alias("t"))
    a, b = of("CEO_BUY").withColumnRenamed("t", "a"), of("CLUSTER_BUY").withColumnRenamed("t", "b")
    known = (F.size("a") > 0) & (F.size("b") > 0)
    return a.join(b, ["cik", "session_idx"]).select("cik", "session_idx", F.when(known, F.arrays_overlap("a", "b")).alias("same_ticker"))


@query(_SCHED + """, c AS (SELECT ticker, session_idx, cik, min(known_at) AS k FROM sch WHERE ticker IS NOT NULL AND session_idx IS NOT NULL
  GROUP BY ALL) SELECT ticker, session_idx, count(DISTINCT cik) AS ciks FROM c GROUP BY ALL HAVING count(DISTINCT cik) > 1""")
def identity_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Tickers that several issuers bear in one session."""
    s = _scheduled(spark, d).filter("ticker is not null and session_idx is not null and cik is not null").select("ticker", "session_idx", "cik").distinct()
    return s.groupBy("ticker", "session_idx").agg(F.count("*").alias("ciks")).filter("ciks > 1")


@query(_SCHED + """ SELECT signal_type, sector, count(*) AS n, count(*) FILTER (score >= 70) AS strong, median(score) AS median_score,
  min(score) AS lowest, max(score) AS highest FROM sch GROUP BY ALL""")
def score_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return signals(spark, d).groupBy("signal_type", "sector").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 70).alias("strong"),
        F.percentile("score", 0.5).alias("median_score"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


@query(_SCHED + """ SELECT run_id, count(DISTINCT coalesce(score_v, '')) AS versions FROM (SELECT DISTINCT run_id, score_version AS score_v
  FROM insider_signals) GROUP BY run_id HAVING run_id IS NOT NULL""")
def provenance_equal(spark: SparkSession, d: str) -> DataFrame:
    """Versions within each run; one is what a comparable run has."""
    from ..sources.tables import table

    s = table(spark, d, "insider_signals").filter("run_id is not null").select("run_id", F.coalesce("score_version", F.lit("")).alias("v")).distinct()
    return s.groupBy("run_id").agg(F.count("*").alias("versions"))
