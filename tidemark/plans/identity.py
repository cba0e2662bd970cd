"""Queries on identities, sets and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal as N
from ..operators import checks as C
from ..operators import resolve as R
from ..sources.tables import table
from .adapters import BARS_SQL, SIGNALS_SQL, TX_SQL, bars, sessions, signals, transactions
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
_TICK = r"regexp_replace(upper(trim(ticker)), '[\s./_-]+([A-Z0-9]{1,2})$', '-\1')"


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ticker_intervals").withColumns({"cik": N.cik(F.col("cik")), "ticker": N.ticker(F.col("ticker"))})


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "identity_snapshots").withColumns({"cik": N.cik(F.col("cik")), "ticker": N.ticker(F.col("ticker")), "exchange": N.symbol(F.col("exchange"))})


_SNAP = f"""s AS (SELECT lpad(cik, 10, '0') AS cik, {_TICK} AS ticker, upper(trim(exchange)) AS exchange, identity_status, valid_from, valid_to,
  knowledge_at, sic, country, security_type, quality_flags, name, run_id FROM identity_snapshots)"""
_IVL = f"i AS (SELECT interval_id, lpad(cik, 10, '0') AS cik, {_TICK} AS ticker, valid_from, valid_to, source, knowledge_at FROM ticker_intervals)"


@query(f"""WITH {_IVL} SELECT cik, ticker, interval_id FROM i WHERE (valid_from IS NULL OR valid_from <= DATE '2022-06-30') AND (valid_to IS NULL
  OR valid_to > DATE '2022-06-30') AND (knowledge_at IS NULL OR knowledge_at <= TIMESTAMP '2022-07-01')
QUALIFY row_number() OVER (PARTITION BY cik ORDER BY valid_from DESC NULLS LAST, valid_to IS NOT NULL, source NULLS LAST, ticker NULLS LAST, interval_id) = 1""")
def interval_ticker(spark: SparkSession, d: str) -> DataFrame:
    """The ticker of each issuer on a day, by what was known then."""
    return R.valid_on(_intervals(spark, d), "cik", F.lit("2022-06-30").cast("date"), F.lit("2022-07-01").cast("timestamp_ntz")).select("cik", "ticker", "interval_id")


@query(f"""WITH {_SNAP}, m AS (SELECT cik, max(knowledge_at) AS knowledge_at FROM s WHERE identity_status = 'RESOLVED' GROUP BY cik),
  c AS (SELECT s.cik, s.knowledge_at, count(DISTINCT (coalesce(ticker, '~'), coalesce(exchange, '~'))) AS n, any_value(ticker) AS t,
  any_value(exchange) AS e FROM s JOIN m USING (cik, knowledge_at) WHERE identity_status = 'RESOLVED' GROUP BY ALL)
SELECT cik, knowledge_at, CASE WHEN n = 1 THEN t END AS ticker, CASE WHEN n = 1 THEN e END AS exchange, n > 1 AS conflict FROM c""")
def latest_identity(spark: SparkSession, d: str) -> DataFrame:
    """The latest observation of each issuer; several of one time that differ cancel each other."""
    return R.latest_without_conflict(_snapshots(spark, d).filter("identity_status = 'RESOLVED'"), "cik", "knowledge_at", ["ticker", "exchange"])


@query(f"""WITH {_SNAP}, d AS (SELECT DISTINCT cik, ticker FROM s WHERE ticker IS NOT NULL), u AS (SELECT ticker FROM d GROUP BY ticker
  HAVING count(DISTINCT cik) = 1) SELECT cik, ticker FROM d JOIN u USING (ticker)""")
def unique_ticker_claims(spark: SparkSession, d: str) -> DataFrame:
    return R.unique_claims(_snapshots(spark, d).select("cik", "ticker").distinct(), "cik", "ticker").select("cik", "ticker")


@query(f"""WITH {SIGNALS_SQL}, {_SNAP}, e AS (SELECT DISTINCT signal_id, cik, CAST(known_at AS DATE) AS day FROM sig WHERE ticker IS NULL),
  o AS (SELECT DISTINCT cik, CAST(knowledge_at AS DATE) AS day, ticker FROM s WHERE ticker IS NOT NULL)
SELECT signal_id, CASE WHEN count(DISTINCT o.ticker) = 1 THEN min(o.ticker) END AS ticker FROM e LEFT JOIN o ON o.cik = e.cik AND o.day BETWEEN e.day - 365 AND e.day GROUP BY signal_id""")
def recovered_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Missing tickers from the only one observed in the year before."""
    e = signals(spark, d).filter("ticker is null").select(F.col("signal_id").alias("event_id"), F.col("cik").alias("key"), F.to_date("known_at").alias("day"))
    o = _snapshots(spark, d).select(F.col("cik").alias("key"), F.to_date("knowledge_at").alias("day"), F.col("ticker").alias("value"))
    return R.prior_unique_value(e, o, 365).select(F.col("event_id").alias("signal_id"), F.col("value").alias("ticker"))


@query(f"""WITH {_SNAP}, r AS (SELECT DISTINCT cik, ticker, CASE WHEN identity_status <> 'RESOLVED' OR identity_status IS NULL THEN 'UNRESOLVED'
  END AS a, CASE WHEN exchange IS NULL OR exchange NOT IN ('NYSE', 'NASDAQ', 'NYSE AMERICAN') THEN 'EXCHANGE' END AS b, CASE WHEN country IS NULL
  OR country <> 'US' THEN 'DOMICILE' END AS c, CASE WHEN security_type IS NULL OR security_type <> 'COMMON_STOCK' THEN 'TYPE' END AS e, run_id FROM s)
SELECT array_to_string(list_filter([a, b, c, e], lambda x: x IS NOT NULL), ',') AS reasons, count(*) AS rows FROM r GROUP BY ALL""")
def universe_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rule results as arrays of reasons, and how often each combination occurs."""
    s = _snapshots(spark, d)
    bad = lambda cond, name: F.when(~F.coalesce(cond, F.lit(False)), F.lit(name))
    reasons = F.array_compact(F.array(bad(F.col("identity_status") == "RESOLVED", "UNRESOLVED"),
        bad(F.col("exchange").isin("NYSE", "NASDAQ", "NYSE AMERICAN"), "EXCHANGE"), bad(F.col("country") == "US", "DOMICILE"),
        bad(F.col("security_type") == "COMMON_STOCK", "TYPE")))
    return s.select("cik", "ticker", "run_id", F.array_join(reasons, ",").alias("reasons")).distinct().groupBy("reasons").agg(F.count("*").alias("rows"))


@query(f"""WITH {_SNAP}, {_IVL}, a AS (SELECT cik, list_sort(list_distinct(list(ticker))) AS t FROM s WHERE ticker IS NOT NULL GROUP BY cik),
  b AS (SELECT cik, list_sort(list_distinct(list(ticker))) AS t FROM i WHERE ticker IS NOT NULL GROUP BY cik) SELECT cik, CASE
  WHEN a.t IS NULL THEN 'ONLY_INTERVALS' WHEN b.t IS NULL THEN 'ONLY_SNAPSHOTS' WHEN a.t = b.t THEN 'EQUAL' WHEN list_has_all(b.t, a.t) THEN 'SUBSET'
  ELSE 'DIFFERENT' END AS status FROM a FULL JOIN b USING (cik)""")
def identity_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Two sources' sets of tickers per issuer."""
    sets = lambda df, n: df.filter("ticker is not null and cik is not null").groupBy("cik").agg(F.array_sort(F.collect_set("ticker")).alias(n))
    j = sets(_snapshots(spark, d), "a").join(sets(_intervals(spark, d), "b"), "cik", "full")
    return j.select("cik", F.when(F.col("a").isNull(), "ONLY_INTERVALS").when(F.col("b").isNull(), "ONLY_SNAPSHOTS").when(F.col("a") == F.col("b"),
        "EQUAL").when(F.size(F.array_except("a", "b")) == 0, "SUBSET").otherwise("DIFFERENT").alias("status"))


@query(f"""WITH {_SNAP}, m AS (SELECT max(knowledge_at) AS newest FROM s), c AS (SELECT ticker, arg_max(cik, (knowledge_at, cik)) AS cik,
  max(knowledge_at) AS last_seen FROM s WHERE ticker IS NOT NULL AND knowledge_at IS NOT NULL GROUP BY ticker) SELECT ticker, cik,
  last_seen >= newest - INTERVAL 365 DAY AS recent FROM c, m""")
def listing_proof(spark: SparkSession, d: str) -> DataFrame:
    """The latest evidence of each ticker, and whether it is less than a year older than the newest of all."""
    s = _snapshots(spark, d).filter("ticker is not null and knowledge_at is not null")
    newest = s.agg(F.max("knowledge_at")).first()[0]  # one value
    g = s.groupBy("ticker").agg(F.max_by("cik", F.struct("knowledge_at", "cik")).alias("cik"), F.max("knowledge_at").alias("last_seen"))
    limit = (F.lit(str(newest)).cast("timestamp_ntz") - F.expr("INTERVAL 365 DAYS")) if newest else F.lit(None).cast("timestamp_ntz")
    return g.select("ticker", "cik", (F.col("last_seen") >= limit).alias("recent"))


@query(f"""WITH {BARS_SQL}, w AS (SELECT symbol, min(session_idx) AS a, max(session_idx) AS b FROM bars JOIN market_sessions ON date = session_date
  GROUP BY symbol) SELECT w.symbol, m.session_date FROM w JOIN market_sessions m ON m.session_idx BETWEEN a AND b LEFT
  JOIN bars ON bars.symbol = w.symbol AND bars.date = m.session_date WHERE bars.symbol IS NULL""")
def missing_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions without a bar between a symbol's first and last, out of the gaps themselves rather than a full grid."""
    s = sessions(spark, d).select("session_date", F.col("session_idx").cast("long").alias("idx"))
    b = bars(spark, d).join(s, F.col("date") == F.col("session_date")).select("symbol", "idx")
    gap = b.withColumn("next", F.lead("idx").over(Window.partitionBy("symbol").orderBy("idx"))).filter("next > idx + 1").select("symbol",
        F.explode(F.sequence(F.col("idx") + 1, F.col("next") - 1)).alias("idx"))
    return gap.join(s, "idx").select("symbol", "session_date")


@query(f"WITH {BARS_SQL} SELECT symbol, date FROM bars WHERE date NOT IN (SELECT session_date FROM market_sessions)")
def extra_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Bars on days without a session."""
    return C.orphans(bars(spark, d), sessions(spark, d), "date", "session_date").select("symbol", "date")


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return C.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def anti_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose customer isn't in the kept segment: a left anti join."""
    return C.orphans(table(spark, d, "orders"), table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query(f"WITH {TX_SQL} SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT issuer FROM tx WHERE code = 'P' AND tx_date > DATE '2000-01-01')")
def semi_active(spark: SparkSession, d: str) -> DataFrame:
    active = transactions(spark, d).filter((F.col("code") == "P") & (F.col("tx_date") > F.lit("2000-01-01").cast("date"))).select("issuer")
    return table(spark, d, "supplier").join(active, F.col("s_suppkey") == F.col("issuer"), "left_semi").select("s_suppkey", "s_name")


@query("""SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def equi_joins(spark: SparkSession, d: str) -> DataFrame:
    """Facts with their headers and parties; small sides are broadcast by their size, not by a hint."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(f"""WITH {TX_SQL}, a AS (SELECT DISTINCT issuer, part FROM tx WHERE code = 'P'), b AS (SELECT DISTINCT issuer, part FROM tx WHERE code = 'S')
  SELECT issuer, part FROM a INTERSECT SELECT issuer, part FROM b""")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    return t.filter("code = 'P'").select("issuer", "part").intersect(t.filter("code = 'S'").select("issuer", "part"))


@query(f"""WITH {TX_SQL}, a AS (SELECT DISTINCT issuer, owner FROM tx WHERE code = 'P'), b AS (SELECT DISTINCT issuer, owner FROM tx WHERE code = 'S')
  SELECT issuer, owner, CASE WHEN b.issuer IS NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b USING (issuer, owner) WHERE a.issuer IS NULL
  OR b.issuer IS NULL""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    return C.set_difference(t.filter("code = 'P'"), t.filter("code = 'S'"), ["issuer", "owner"])


@query(f"""WITH {TX_SQL}, u AS (SELECT issuer, owner FROM tx WHERE code = 'P' UNION ALL SELECT issuer, owner FROM tx WHERE code = 'S') SELECT issuer,
  count(*) AS rows, count(DISTINCT owner) AS owners FROM u GROUP BY issuer""")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d)
    u = t.filter("code = 'P'").select("issuer", "owner").unionByName(t.filter("code = 'S'").select("issuer", "owner"))
    return u.groupBy("issuer").agg(F.count("*").alias("rows"), F.count_distinct("owner").alias("owners"))


@query("""WITH a AS (SELECT user_id, max(event_id) AS id FROM events WHERE user_id IS NOT NULL AND ts < TIMESTAMP '2024-01-16' GROUP BY ALL),
  b AS (SELECT user_id, max(event_id) AS id FROM events WHERE user_id IS NOT NULL AND event_type <> 'click' GROUP BY ALL) SELECT user_id, CASE
  WHEN a.id IS NULL THEN 'ADDED' WHEN b.id IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM a FULL JOIN b USING (user_id)
  WHERE a.id IS DISTINCT FROM b.id""")
def user_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changed between two snapshots of every user's last event."""
    e = table(spark, d, "events").filter("user_id is not null")
    a = e.filter("ts < timestamp_ntz'2024-01-16'").groupBy("user_id").agg(F.max("event_id").alias("id"))
    b = e.filter("event_type <> 'click'").groupBy("user_id").agg(F.max("event_id").alias("id"))
    return C.changes(a, b, ["user_id"], ["id"])


@query("""WITH r AS (SELECT count(*) FILTER (NOT coalesce(high >= low, false)) AS a, count(*) FILTER (NOT coalesce(close > 0, false)) AS b,
  count(*) FILTER (NOT coalesce(volume >= 0, false)) AS c, count(*) FILTER (NOT coalesce(close BETWEEN low AND high, false)) AS d FROM daily_bars)
SELECT unnest(['high_low', 'close_positive', 'volume_not_negative', 'close_in_range']) AS rule, unnest([a, b, c, d]) AS rows FROM r""")
def bar_constraints(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "daily_bars")
    return C.violations(b, {"high_low": F.col("high") >= F.col("low"), "close_positive": F.col("close") > 0,
        "volume_not_negative": F.col("volume") >= 0, "close_in_range": F.col("close").between(F.col("low"), F.col("high"))})


@query("""WITH q AS (SELECT provider, list_filter([CASE WHEN coalesce(close > 0, false) THEN NULL ELSE 'close' END, CASE WHEN coalesce(volume >= 0,
  false) THEN NULL ELSE 'volume' END, CASE WHEN coalesce(close BETWEEN low AND high, false) THEN NULL ELSE 'range' END],
  lambda x: x IS NOT NULL) AS reasons FROM daily_bars), u AS (SELECT provider, unnest(reasons) AS reason FROM q)
SELECT provider, reason, count(*) AS n FROM u GROUP BY ALL""")
def quarantine_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of why rows are set aside."""
    _, bad = C.split_valid(table(spark, d, "daily_bars"), {"close": F.col("close") > 0, "volume": F.col("volume") >= 0, "range": F.col("close").between(F.col("low"), F.col("high"))})
    return bad.select("provider", F.explode("reasons").alias("reason")).groupBy("provider", "reason").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT provider_record_id, count(*) AS copies, count(DISTINCT (close, volume, date)) AS contents FROM daily_bars GROUP BY ALL)
  SELECT copies, contents > 1 AS conflicting, count(*) AS ids FROM c GROUP BY ALL""")
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Repeated records that are equal collapse, others are conflicts: one hash per content tells them apart."""
    b = table(spark, d, "daily_bars").select("provider_record_id", C.content_hash(["close", "volume", "date"]).alias("h"), F.coalesce("close", "volume").isNull().alias("nothing"))
    c = b.groupBy("provider_record_id").agg(F.count("*").alias("copies"), (F.min("h") != F.max("h")).alias("conflicting"))
    return c.groupBy("copies", "conflicting").agg(F.count("*").alias("ids"))


@query("""SELECT provider, count(*) AS rows, count(*) FILTER (payload IS NULL) AS listing_only, round(count(payload) / count(*), 8) AS rate, CASE
  WHEN count(payload) / count(*) >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS result FROM sec_raw_records GROUP BY provider""")
def completeness_measurement(spark: SparkSession, d: str) -> DataFrame:
    """A measured rate against its threshold, per provider."""
    g = table(spark, d, "sec_raw_records").groupBy("provider").agg(F.count("*").alias("rows"),
        F.count_if(F.col("payload").isNull()).alias("listing_only"), (F.count("payload") / F.count("*")).alias("r"))
    return g.select("provider", "rows", "listing_only", F.round("r", 8).alias("rate"), F.when(F.col("r") >= 0.85, "PASS").otherwise("FAIL").alias("result"))


@query("""WITH k AS (SELECT accepted_at, provider_record_id, delivery_id FROM sec_raw_records WHERE (accepted_at, provider_record_id,
  delivery_id) > (TIMESTAMP '2022-01-01', '', 0)) SELECT strftime(accepted_at, '%Y-%m-%d') AS day, count(*) AS rows, max(accepted_at) AS watermark
  FROM k GROUP BY ALL""")
def cursor_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows beyond a cursor of several fields, compared as a struct, page by day, with each page's watermark."""
    at = F.struct("accepted_at", "provider_record_id", "delivery_id") > F.struct(F.lit("2022-01-01").cast("timestamp_ntz").alias("accepted_at"),
        F.lit("").alias("provider_record_id"), F.lit(0).cast("long").alias("delivery_id"))
    r = table(spark, d, "sec_raw_records").filter((F.col("accepted_at") >= F.lit("2022-01-01").cast("timestamp_ntz")) & at)
    return r.groupBy(N.day_text(F.col("accepted_at")).alias("day")).agg(F.count("*").alias("rows"), F.max("accepted_at").alias("watermark"))


@query("""WITH e AS (SELECT CAST(unnest(generate_series(DATE '2019-01-01', DATE '2025-12-31', INTERVAL 32 DAY)) AS DATE) AS starts) SELECT starts,
  least(starts + 31, DATE '2025-12-31') AS ends FROM e""")
def request_windows(spark: SparkSession, d: str) -> DataFrame:
    """A period in requests of 32 days."""
    end = F.lit("2025-12-31").cast("date")
    return spark.range(1).select(F.explode(F.sequence(F.lit("2019-01-01").cast("date"), end,
        F.expr("interval 32 days"))).alias("starts")).select("starts", F.least(F.date_add("starts", 31), end).alias("ends"))


@query(f"""WITH {SIGNALS_SQL}, p AS (SELECT DISTINCT CAST(known_at AS DATE) AS day FROM sig), e AS (SELECT CAST(unnest(generate_series((SELECT min(day)
  FROM p), (SELECT max(day) FROM p), INTERVAL 1 DAY)) AS DATE) AS day) SELECT day FROM e WHERE day NOT IN (SELECT day FROM p WHERE day IS NOT NULL)""")
def missing_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of the period on which nothing arrived, from the gaps between days that have something."""
    p = signals(spark, d).select(F.to_date("known_at").alias("day")).filter("day is not null").distinct()
    gap = p.withColumn("next", F.lead("day").over(Window.orderBy("day"))).filter(F.datediff("next", "day") > 1)
    return gap.select(F.explode(F.sequence(F.date_add("day", 1), F.date_sub("next", 1))).alias("day"))


@query("SELECT issuer_cik AS raw, lpad(regexp_replace(issuer_cik, '[^0-9]', '', 'g'), 10, '0') AS cik, sha256(issuer_cik) AS hash, count(*) AS n FROM sec_raw_records GROUP BY ALL")
def scalar_forms(spark: SparkSession, d: str) -> DataFrame:
    """Normal forms and content ids of identifiers."""
    return table(spark, d, "sec_raw_records").groupBy(F.col("issuer_cik").alias("raw")).agg(F.count("*").alias("n")).select("raw",
        N.cik(F.col("raw")).alias("cik"), F.sha2("raw", 256).alias("hash"), "n")


@query("""SELECT session_date, date_trunc('week', session_date)::DATE AS week_start, date_trunc('quarter', session_date)::DATE AS quarter_start,
  last_day(session_date) AS month_end, close_utc, early_close,
  CAST(hour(close_utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS BIGINT) AS close_hour_local FROM market_sessions""")
def calendar_functions(spark: SparkSession, d: str) -> DataFrame:
    """Calendar fields of each session; the local hour follows the zone's rules, not an offset."""
    s = sessions(spark, d)
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("close_utc"))
    return s.select("session_date", F.to_date(F.date_trunc("week", "session_date")).alias("week_start"),
        F.to_date(F.date_trunc("quarter", "session_date")).alias("quarter_start"), F.last_day("session_date").alias("month_end"), "close_utc",
        "early_close", F.hour(local).cast("long").alias("close_hour_local"))
