"""Further joins and reports: overlaps, triggers, reordering, intervals of confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal as N
from ..functions import scores
from ..operators import bootstrap, overlap, quantiles, resolve
from ..sources import ownership
from ..sources.tables import spread_table, table
from .adapters import BARS_SQL, JOINT_SQL, SIGNALS_SQL, TX_SQL, bars, joint_transactions, signals, transactions
from .registry import Registry
from .study import _grouped

query = Registry()
QUERIES, SQL = query.queries, query.sql
_X = f"WITH {TX_SQL}"
_JOINT = f"WITH {JOINT_SQL}"


@query(f"""WITH {SIGNALS_SQL}, h AS (SELECT signal_id, ticker, transaction_date AS starts, transaction_date + 365 AS ends FROM sig),
  a AS (SELECT interval_id, regexp_replace(upper(trim(ticker)), '[\\s./_-]+([A-Z0-9]{{1,2}})$', '-\\1') AS ticker, valid_to AS day
  FROM ticker_intervals WHERE valid_to IS NOT NULL)
SELECT signal_id, interval_id FROM h JOIN a ON h.ticker = a.ticker AND a.day > h.starts AND a.day <= h.ends""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Actions (ends of tickers) that fall into the year after a signal."""
    h = signals(spark, d).select("signal_id", "ticker", F.col("transaction_date").alias("starts"), F.date_add("transaction_date", 365).alias("ends"))
    a = table(spark, d, "ticker_intervals").select("interval_id", N.ticker(F.col("ticker")).alias("ticker"), F.col("valid_to").alias("day"))
    return overlap.points_in_intervals(a, h, "ticker", "day", "starts", "ends").select("signal_id", "interval_id")


@query(_JOINT + """, o AS (SELECT issuer, accession, list(DISTINCT owner) AS s, min(tx_date) AS day FROM tx GROUP BY ALL), m AS (SELECT issuer,
  accession, day, s, date_trunc('month', day) AS m FROM o)
SELECT a.issuer, a.accession, count(b.accession) AS candidates FROM m a LEFT JOIN m b ON a.issuer = b.issuer AND a.m = b.m
  AND b.accession < a.accession AND list_has_all(b.s, a.s) GROUP BY ALL""")
def owner_subset_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Earlier filings of an issuer's month whose owners include all of this one's."""
    return overlap.including_filings(joint_transactions(spark, d))


#: Calendar days that a cluster's window reaches back from its anchor, and the owners that make a cluster and a strong one.
CLUSTER_DAYS, CLUSTER_OWNERS, STRONG_OWNERS = 30, 2, 3


@query(_X + f""", b AS (SELECT issuer, owner, tx_date, known_date, accession, line FROM tx WHERE code = 'P'), s AS (SELECT DISTINCT issuer, known_date AS session, tx_date AS fresh FROM b),
a AS (SELECT DISTINCT s.issuer, s.session, b.tx_date AS anchor FROM s JOIN b ON b.issuer = s.issuer AND b.known_date <= s.session AND b.tx_date BETWEEN s.fresh AND s.fresh + {CLUSTER_DAYS}),
w AS (SELECT a.issuer, a.session, a.anchor, count(DISTINCT b.owner) AS owners FROM a JOIN b ON b.issuer = a.issuer AND b.known_date <= a.session
  AND b.tx_date BETWEEN a.anchor - {CLUSTER_DAYS} AND a.anchor GROUP BY ALL),
f AS (SELECT issuer, tx_date AS anchor, min((known_date, accession, line)) AS first FROM b GROUP BY ALL),
r AS (SELECT w.*, row_number() OVER (PARTITION BY w.issuer, w.session ORDER BY owners DESC, first, w.anchor) AS rn FROM w JOIN f ON f.issuer = w.issuer AND f.anchor = w.anchor)
SELECT issuer, session, owners, anchor, owners >= {STRONG_OWNERS} AS strong FROM r WHERE rn = 1 AND owners >= {CLUSTER_OWNERS}""")
def cluster_triggers_pit(spark: SparkSession, d: str) -> DataFrame:
    """Per day of disclosure, the window of trading days with most owners among all purchases known by then, of those
    windows that hold a newly disclosed one; of equal windows the one whose anchor was disclosed first."""
    return overlap.cluster_triggers(transactions(spark, d).filter("code = 'P'"), CLUSTER_DAYS, CLUSTER_OWNERS, STRONG_OWNERS)


@query("""WITH q AS (SELECT DISTINCT lpad(cik, 10, '0') AS cik, interval_id FROM ticker_intervals), r AS (SELECT *, row_number() OVER (PARTITION BY cik
  ORDER BY interval_id) AS turn FROM q) SELECT cik, interval_id, turn FROM r""")
def round_robin_order(spark: SparkSession, d: str) -> DataFrame:
    """Turns by which requests go once around all issuers before any gets its second."""
    q = table(spark, d, "ticker_intervals").select(N.cik(F.col("cik")).alias("cik"), "interval_id").distinct()
    return q.select("cik", "interval_id", F.row_number().over(Window.partitionBy("cik").orderBy("interval_id")).cast("long").alias("turn"))


@query(_X + """, c AS (SELECT issuer, quantile_cont(value, 0.99) AS cap FROM tx WHERE code IN ('P', 'S') GROUP BY issuer), w AS (SELECT tx.issuer, CASE
  WHEN code = 'P' THEN 100.0 ELSE 0.0 END AS score, least(value, cap) AS weight FROM tx JOIN c ON c.issuer = tx.issuer WHERE code IN ('P', 'S'))
SELECT issuer, round(sum(score * weight) / sum(weight), 6) AS component, count(*) AS n FROM w GROUP BY issuer""")
def weighted_components(spark: SparkSession, d: str) -> DataFrame:
    """Dollar-weighted mean of a score, weights capped at the issuer's 99 % quantile."""
    t = transactions(spark, d).filter("code in ('P', 'S')").select("issuer", F.when(F.col("code") == "P", 100.0).otherwise(0.0).alias("score"), "value")
    cap = quantiles.quantiles(t, ["issuer"], "value", {"cap": 0.99})
    w = t.join(cap, "issuer").withColumn("weight", F.least("value", "cap"))
    return w.groupBy("issuer").agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 6).alias("component"), F.count("*").alias("n"))


@query(f"""WITH {BARS_SQL}, l AS (SELECT symbol, arg_max(close, date) AS close, max(close) AS high, arg_max(date, (close, date)) AS high_on,
  count(*) FILTER (date > DATE '2024-01-01') AS recent, sum(volume) FILTER (date > DATE '2024-01-01') AS recent_volume FROM bars GROUP BY symbol)
SELECT symbol, close, high, high_on, round(close / nullif(high, 0) - 1, 9) + 0.0 AS drawdown, recent, recent_volume FROM l""")
def candidate_insights(spark: SparkSession, d: str) -> DataFrame:
    """Per symbol: last close, highest close and its day, draw-down, recent activity; one aggregate."""
    recent = F.col("date") > F.lit("2024-01-01").cast("date")
    g = bars(spark, d).groupBy("symbol").agg(F.max_by("close", "date").alias("close"), F.max("close").alias("high"),
        F.max_by("date", F.struct("close", "date")).alias("high_on"), F.count_if(recent).alias("recent"),
        F.sum(F.when(recent, F.col("volume"))).alias("recent_volume"))
    return g.select("symbol", "close", "high", "high_on", (F.round(F.col("close") / F.nullif(F.col("high"), F.lit(0.0)) - 1, 9) + 0.0).alias("drawdown"), "recent", "recent_volume")


@query("""WITH l AS (SELECT 'orders' AS channel, o_orderdate AS happened, o_orderstatus = 'F' AS ok FROM orders UNION ALL SELECT 'lines', l_shipdate,
  l_linestatus = 'F' FROM lineitem UNION ALL SELECT 'events', ts, event_type <> 'error' FROM events)
SELECT channel, max(happened) AS last_at, max(happened) FILTER (ok) AS last_success, count(*) FILTER (NOT ok) AS failures FROM l GROUP BY channel""")
def channel_status(spark: SparkSession, d: str) -> DataFrame:
    """Last attempt, last success and failures over three ledgers."""
    o = table(spark, d, "orders").select(F.lit("orders").alias("channel"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "F").alias("ok"))
    li = table(spark, d, "lineitem").select(F.lit("lines").alias("channel"), F.col("l_shipdate").alias("at"), (F.col("l_linestatus") == "F").alias("ok"))
    e = table(spark, d, "events").select(F.lit("events").alias("channel"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return o.unionByName(li).unionByName(e).groupBy("channel").agg(F.max("at").alias("last_at"),
        F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success"), F.count_if(~F.col("ok")).alias("failures"))


@query(_X + """, a AS (SELECT issuer, CASE WHEN count(*) FILTER (code = 'P') > 200 THEN 100.0 * count(*) FILTER (code = 'P') / count(*) END AS buys,
  CASE WHEN count(*) FILTER (code = 'S') > 200 THEN 100.0 * count(*) FILTER (code = 'S') / count(*) END AS sales,
  100.0 * count(DISTINCT owner) / 25 AS breadth FROM tx GROUP BY issuer)
SELECT issuer, round((coalesce(buys * 0.5, 0) + coalesce(sales * 0.3, 0) + breadth * 0.2) / (CASE WHEN buys IS NULL THEN 0 ELSE 0.5 END + CASE
  WHEN sales IS NULL THEN 0 ELSE 0.3 END + 0.2), 6) AS score FROM a""")
def weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Parts by weight, the weights of missing parts going to the others."""
    t = transactions(spark, d).groupBy("issuer").agg(F.count_if(F.col("code") == "P").alias("p"), F.count_if(F.col("code") == "S").alias("s"),
        F.count("*").alias("n"), F.count_distinct("owner").alias("o"))
    parts = t.select("issuer", F.when(F.col("p") > 200, F.col("p") * 100.0 / F.col("n")).alias("buys"),
        F.when(F.col("s") > 200, F.col("s") * 100.0 / F.col("n")).alias("sales"), (F.col("o") * 100.0 / 25).alias("breadth"))
    return parts.select("issuer", F.round(scores.weighted_score({"buys": 0.5, "sales": 0.3, "breadth": 0.2}), 6).alias("score"))


@query(_X + ", p AS (SELECT issuer, owner, min(accession) AS first_accession FROM tx GROUP BY ALL) SELECT issuer, owner, first_accession FROM p")
def first_record_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first record of each key, by an aggregate."""
    return transactions(spark, d).groupBy("issuer", "owner").agg(F.min("accession").alias("first_accession"))


@query("""WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Z]{5}') AS t FROM documents) SELECT doc_id,
  CAST(len(list_distinct(t)) AS BIGINT) AS symbols, CAST(len(t) AS BIGINT) AS mentions FROM c""")
def symbol_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Symbols named in texts: all matches of a pattern, as arrays."""
    t = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Z]{5})"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.size(F.array_distinct(t)).cast("long").alias("symbols"), F.size(t).cast("long").alias("mentions"))


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap intervals of the median outcome per horizon and year, and of its difference from the year before."""
    g = _grouped(spark, d).withColumn("year", F.year("date").cast("long"))
    m = bootstrap.medians(g, ["horizon", "year"], "forward_return")
    before = m.select("horizon", (F.col("year") + 1).alias("year"), F.col("median").alias("before"), F.col("draws").alias("before_draws"))
    both = m.join(before, ["horizon", "year"], "left")
    change, low, high = bootstrap.median_difference(F.col("median"), F.col("draws"), F.col("before"), F.col("before_draws"))
    return bootstrap.median_intervals(both.withColumns({"change": change, "change_low": low, "change_high": high})).select("horizon", "year", "n",
        "median", "low", "high", "change", "change_low", "change_high")


@query(_X + """, r AS (SELECT DISTINCT issuer, owner, part, known_date, code, accession * 10 + line AS id FROM tx WHERE code IN ('P', 'S')),
m AS (SELECT *, code = 'S' AS amends, CASE WHEN code = 'S' AND count(*) OVER (PARTITION BY issuer, owner, part, known_date) > 1 THEN 'AMBIGUOUS'
  WHEN code = 'S' AND known_date = min(known_date) OVER (PARTITION BY issuer, owner, part) THEN 'NO_PREDECESSOR' END AS problem FROM r),
n AS (SELECT *, row_number() OVER w AS n, lag(id) OVER w AS prior, lead(amends) OVER w AS next_amends, lead(known_date) OVER w AS next_at FROM m
  WINDOW w AS (PARTITION BY issuer, owner, part, problem IS NULL ORDER BY known_date, id)),
s AS (SELECT *, max(CASE WHEN NOT amends THEN n END) OVER (PARTITION BY issuer, owner, part, problem IS NULL ORDER BY known_date, id ROWS UNBOUNDED PRECEDING) AS start FROM n)
SELECT issuer, owner, part, id, known_date, problem, CASE WHEN problem IS NULL THEN CAST(n - coalesce(start, 1) AS BIGINT) END AS revision, CASE
  WHEN problem IS NULL AND amends THEN prior END AS replaces, CASE WHEN problem IS NULL AND next_amends THEN next_at END AS valid_to FROM s""")
def amendment_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of statements and their amendments, with those that can't be placed set aside."""
    r = transactions(spark, d).filter("code in ('P', 'S')").select("issuer", "owner", "part", "known_date", "code", (F.col("accession") * 10 + F.col("line")).alias("id"))
    return resolve.amendments(r, ["issuer", "owner", "part"], "known_date", "id", F.col("code") == "S").drop("code")


@query()
def republished_accessions(spark: SparkSession, d: str) -> DataFrame:
    """Filings, by their number in any column and spelling: first day, days and deliveries, and whether deliveries differ in
    form or in the content of their documents."""
    return _republished(spread_table(spark, d, "sec_raw_records"))


def _republished(raw: DataFrame) -> DataFrame:
    f = raw.select("delivery_id", N.accession(F.col("accession_number"), F.col("provider_record_id")).alias("accession"),
        F.to_date("retrieved_at").alias("day"), F.upper(F.trim("form_type")).alias("form")).filter("accession is not null")
    both = f.join(ownership.fingerprints(raw, "delivery_id", "payload"), F.col("delivery_id") == F.col("record"), "left")
    g = both.groupBy("accession").agg(F.min("day").alias("first_day"), F.count_distinct("day").alias("days"), F.count("*").alias("deliveries"),
        (F.count_distinct("form") > 1).alias("form_conflict"), (F.count_distinct("fingerprint") > 1).alias("content_conflict"))
    return g.withColumn("conflicting", F.col("form_conflict") | F.col("content_conflict"))


@query(_JOINT + """, c AS (SELECT DISTINCT accession FROM tx WHERE code = 'P'), o AS (SELECT accession, list_sort(list_distinct(list(owner))) AS owners
  FROM tx WHERE role <> '1-URGENT' GROUP BY accession) SELECT c.accession, owners, owners IS NULL AS missing FROM c LEFT JOIN o USING (accession)""")
def owner_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with the set of their owners; candidates without any are shown as missing."""
    t = joint_transactions(spark, d)
    c = t.filter("code = 'P'").select("accession").distinct()
    o = t.filter("role <> '1-URGENT'").join(c, "accession", "left_semi").groupBy("accession").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    return c.join(o, "accession", "left").withColumn("missing", F.col("owners").isNull())


@query(f"""WITH {BARS_SQL}, m AS (SELECT provider, count(*) AS rows, count(volume) / count(*) AS filled, count(DISTINCT date) AS days FROM bars
  GROUP BY provider) SELECT provider, rows, days, CASE WHEN filled >= 0.999 AND days >= 1000 THEN 'A' WHEN filled >= 0.99 THEN 'B' ELSE 'C' END AS tier
  FROM m""")
def quality_tiers(spark: SparkSession, d: str) -> DataFrame:
    """A tier out of several measured rates."""
    m = bars(spark, d).groupBy("provider").agg(F.count("*").alias("rows"), (F.count("volume") / F.count("*")).alias("filled"), F.count_distinct("date").alias("days"))
    return m.select("provider", "rows", "days", F.when((F.col("filled") >= 0.999) & (F.col("days") >= 1000), "A").when(F.col("filled") >= 0.99, "B").otherwise("C").alias("tier"))


@query("""WITH b AS (SELECT provider, upper(trim(symbol)) AS symbol, date, max(close) AS close FROM daily_bars WHERE symbol IS NOT NULL
  AND date IS NOT NULL AND provider IS NOT NULL GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY provider, symbol ORDER BY date) AS pos FROM b), s AS (SELECT symbol, min(provider) AS one, max(provider) AS two FROM b GROUP BY symbol),
l AS (SELECT n.* FROM n JOIN s ON s.symbol = n.symbol AND s.one = n.provider AND s.one < s.two), r AS (SELECT n.* FROM n
  JOIN s ON s.symbol = n.symbol AND s.two = n.provider AND s.one < s.two)
SELECT coalesce(l.symbol, r.symbol) AS symbol, count(*) AS rows, count(*) FILTER (l.date <> r.date) AS other_day, count(*) FILTER (l.date = r.date
  AND l.close IS DISTINCT FROM r.close) AS other_close, count(*) FILTER (r.pos IS NULL OR l.pos IS NULL) AS alone FROM l FULL
  JOIN r ON l.symbol = r.symbol AND l.pos = r.pos GROUP BY ALL""")
def positional_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of a symbol's first and last provider matched by position, and how many then differ in day or close, or have no
    partner: what holds the identity of the two sides has none of these."""
    named = table(spark, d, "daily_bars").select("provider", N.symbol(F.col("symbol")).alias("symbol"), "date",
        "close").filter("symbol is not null and date is not null and provider is not null")
    b = named.groupBy("provider", "symbol", "date").agg(F.max("close").alias("close")).withColumn("pos", F.row_number().over(Window.partitionBy("provider", "symbol").orderBy("date")))
    two = named.groupBy("symbol").agg(F.min("provider").alias("one"), F.max("provider").alias("two")).filter("one < two")
    side = lambda p, c: b.join(two.select("symbol", F.col(p).alias("provider")), ["symbol", "provider"]).select("symbol", "pos", F.struct("date", "close").alias(c))
    return overlap.positional(side("one", "l"), side("two", "r"))
