"""Audits, overlays, catalogues and the scalar families that no other query shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal as N
from ..functions import scores
from ..functions import windows as Wf
from ..operators import checks, study
from ..operators import quantiles as Q
from ..sources.tables import table
from .adapters import BARS_SQL, SIGNALS_SQL, TX_SQL, bars, sessions, signals, transactions
from .ledger import _SCHED
from .registry import Registry
from .study import _OUT, _outcomes

query = Registry()
QUERIES, SQL = query.queries, query.sql
_X = f"WITH {TX_SQL}"

# ---------------------------------------------------------------- overlays and joins


@query("""WITH base AS (SELECT l_orderkey AS accession, l_linenumber AS line, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL),
o AS (SELECT accession, line, CASE WHEN line % 2 = 0 THEN value * 2 END AS corrected FROM base WHERE accession % 5 = 0)
SELECT b.accession, b.line, coalesce(o.corrected, b.value) AS value, CASE WHEN o.accession IS NULL THEN 'BASE' WHEN o.corrected IS NULL THEN 'WITHDRAWN' ELSE 'OVERLAY' END AS origin
FROM base b LEFT JOIN o USING (accession, line)""")
def frozen_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Corrections laid over statements by their whole key; what an overlay leaves open stays as it was."""
    base = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("line")).agg(F.max("l_extendedprice").alias("value"))
    o = base.filter("accession % 5 = 0").select("accession", "line", F.when(F.col("line") % 2 == 0, F.col("value") * 2).alias("corrected"))
    return checks.overlay(base, o, ["accession", "line"], "value", "corrected")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC,
  o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus = 'F')
SELECT c_custkey, o_orderkey AS last_order, o_orderdate AS last_at FROM customer LEFT JOIN o ON o_custkey = c_custkey AND rn = 1""")
def latest_delivery(spark: SparkSession, d: str) -> DataFrame:
    """The last successful delivery to each candidate, by an aggregate before the join."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("r"))
    c = table(spark, d, "customer").select("c_custkey").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return c.select("c_custkey", F.col("r.o_orderkey").alias("last_order"), F.col("r.o_orderdate").alias("last_at"))


@query(f"""WITH {SIGNALS_SQL}, c AS (SELECT DISTINCT ticker, cik FROM sig WHERE ticker IS NOT NULL AND cik IS NOT NULL)
SELECT ticker, CASE WHEN count(*) = 1 THEN min(cik) END AS cik, count(*) AS claimants FROM c GROUP BY ticker""")
def ticker_inverse(spark: SparkSession, d: str) -> DataFrame:
    """The issuer of each ticker, none where several claim it."""
    c = signals(spark, d).select("ticker", "cik").dropna().groupBy("ticker").agg(F.min("cik").alias("low"), F.count_distinct("cik").alias("claimants"))
    return c.select("ticker", F.when(F.col("claimants") == 1, F.col("low")).alias("cik"), "claimants")


@query(f"""WITH {BARS_SQL}, s AS (SELECT provider, symbol, count(*) AS rows, min(date) AS a, max(date) AS b FROM bars GROUP BY ALL),
  p AS (SELECT symbol, provider, CASE WHEN rows = 1 THEN 'SINGLE' WHEN b - a + 1 = rows THEN 'GAPLESS' ELSE 'CONTINUOUS' END AS state FROM s)
SELECT symbol, coalesce(CASE WHEN length(symbol) % 5 = 0 THEN 'FIXED' END, state) AS state, length(symbol) % 5 = 0 AS overridden FROM p""")
def continuity_state(spark: SparkSession, d: str) -> DataFrame:
    """What a series' own rows say of its continuity, unless a fixture states otherwise."""
    s = bars(spark, d).groupBy("symbol").agg(F.count("*").alias("rows"), F.min("date").alias("a"), F.max("date").alias("b"))
    own = F.when(F.col("rows") == 1, "SINGLE").when(F.datediff("b", "a") + 1 == F.col("rows"), "GAPLESS").otherwise("CONTINUOUS")
    fixed = F.length("symbol") % 5 == 0
    return s.select("symbol", F.coalesce(F.when(fixed, "FIXED"), own).alias("state"), fixed.alias("overridden"))


# ---------------------------------------------------------------- audits


@query(_OUT + """, r AS (SELECT year(date) AS year, horizon, CASE WHEN forward_return IS NULL THEN 'NO_EXIT' WHEN NOT complete THEN 'GAP' ELSE 'MATCHED' END AS status FROM o)
SELECT year, horizon, status, count(*) AS events FROM r GROUP BY GROUPING SETS ((year, horizon, status), (horizon, status))""")
def terminal_audit(spark: SparkSession, d: str) -> DataFrame:
    """Events by what became of them, per year and horizon and over all years, from one classified column."""
    b = bars(spark, d).filter("close > 0").join(sessions(spark, d), F.col("date") == F.col("session_date")).select("symbol", F.col("session_idx").cast("long").alias("session_idx"), "date")
    status = F.when(F.col("forward_return").isNull(), "NO_EXIT").when(~F.col("complete"), "GAP").otherwise("MATCHED")
    r = _outcomes(spark, d).join(b, ["symbol", "session_idx"]).select(F.year("date").cast("long").alias("year"), "horizon", status.alias("status"))
    sets = [[F.col("year"), F.col("horizon"), F.col("status")], [F.col("horizon"), F.col("status")]]
    return r.groupingSets(sets, "year", "horizon", "status").agg(F.count("*").alias("events"))


@query(_OUT + """, q AS (SELECT horizon, forward_return AS x, row_number() OVER (PARTITION BY horizon ORDER BY forward_return DESC, symbol,
  session_idx) AS k FROM o WHERE forward_return IS NOT NULL)
SELECT horizon, round(avg(x) FILTER (k > 10), 8) + 0.0 AS without_top, round(sum(x) FILTER (k <= 10) / nullif(sum(x) FILTER (x > 0), 0), 8) + 0.0 AS top_share FROM q GROUP BY horizon""")
def tail_removed(spark: SparkSession, d: str) -> DataFrame:
    """Means without the ten best outcomes, and the share of all gains that these hold: sums, less those of ten rows."""
    o = _outcomes(spark, d).filter("forward_return is not null")
    x = F.col("forward_return")
    all_ = o.groupBy("horizon").agg(F.sum(x).alias("s"), F.count(x).alias("n"), F.sum(F.when(x > 0, x)).alias("gains"))
    top = Q.top_rows(o, ["horizon"], "forward_return", F.least(F.col("n"), F.lit(10)), ["symbol", "session_idx"]).groupBy("horizon").agg(F.sum(x).alias("t"), F.count(x).alias("k"))
    j = all_.join(top, "horizon")
    rest = (F.col("s") - F.col("t")) / F.nullif(F.col("n") - F.col("k"), F.lit(0))
    return j.select("horizon", (F.round(rest, 8) + 0.0).alias("without_top"), (F.round(F.col("t") / F.nullif("gains", F.lit(0.0)), 8) + 0.0).alias("top_share"))


@query(_X + """, s AS (SELECT issuer % 8 AS shard, code, count(*) AS rows, count(DISTINCT issuer) AS issuers, round(sum(value), 2) AS dollars FROM tx GROUP BY ALL)
SELECT code, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(issuers) AS BIGINT) AS issuers, round(sum(dollars), 1) AS dollars, count(*) AS shards FROM s GROUP BY code""")
def shard_merge(spark: SparkSession, d: str) -> DataFrame:
    """Counters of eight shards by issuer, merged by sums: an issuer is in one shard, so its distinct count sums, too."""
    s = transactions(spark, d).groupBy((F.col("issuer") % 8).alias("shard"), "code").agg(F.count("*").alias("rows"),
        F.count_distinct("issuer").alias("issuers"), F.round(F.sum("value"), 2).alias("dollars"))
    return s.groupBy("code").agg(F.sum("rows").alias("rows"), F.sum("issuers").alias("issuers"), F.round(F.sum("dollars"), 1).alias("dollars"), F.count("*").alias("shards"))


@query("""WITH b AS (SELECT CAST(close AS DOUBLE) AS close, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, CAST(volume AS BIGINT) AS volume FROM daily_bars),
q AS (SELECT *, coalesce(close > 0 AND volume >= 0 AND close BETWEEN low AND high, false) AS first FROM b), r AS (SELECT first, coalesce(close > 0
  AND abs(volume) >= 0 AND close BETWEEN least(low, high) AND greatest(low, high), false) AS second FROM q)
SELECT CASE WHEN first THEN 'VALID' WHEN second THEN 'REPAIRED' ELSE 'STILL_ASIDE' END AS outcome, count(*) AS rows FROM r GROUP BY ALL""")
def quarantine_replay(spark: SparkSession, d: str) -> DataFrame:
    """Rows set aside, repaired and put through the same rules again, without touching anything."""
    b = table(spark, d, "daily_bars").select(*[F.col(c).cast("double").alias(c) for c in ("close", "low", "high")], F.col("volume").cast("long").alias("volume"))
    rules = {"PRICE": F.col("close") > 0, "VOLUME": F.col("volume") >= 0, "RANGE": F.col("close").between(F.col("low"), F.col("high"))}
    good, bad = checks.split_valid(b, rules)
    repaired = bad.drop("reasons").select("close", F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high"), F.abs("volume").alias("volume"))
    mended, rest = checks.split_valid(repaired, rules)
    named = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("outcome"), "rows")
    return named(good, "VALID").unionByName(named(mended, "REPAIRED")).unionByName(named(rest, "STILL_ASIDE")).filter("rows > 0")


@query("""WITH a AS (SELECT c_custkey AS k, list_sort(list_distinct(list(o_orderpriority))) AS p, count(*) AS n FROM orders
  JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL),
b AS (SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderpriority))) AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT CASE WHEN a.k IS NULL THEN 'ONLY_SECOND' WHEN b.k IS NULL THEN 'ONLY_FIRST' WHEN a.p = b.p AND a.n = b.n THEN 'EQUAL'
  WHEN a.p = b.p THEN 'SET_EQUAL' WHEN list_has_all(a.p, b.p) THEN 'SECOND_WITHIN_FIRST'
  WHEN list_has_all(b.p, a.p) THEN 'FIRST_WITHIN_SECOND' WHEN list_has_any(a.p, b.p) THEN 'OVERLAP' ELSE 'DISJOINT' END AS code, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY ALL""")
def reconciliation_codes(spark: SparkSession, d: str) -> DataFrame:
    """Two sources' sets per key in eight codes."""
    o = table(spark, d, "orders")
    side = lambda status, p, n: o.filter(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias(p),
        F.count("*").alias(n))
    j = side("F", "a", "an").join(side("O", "b", "bn"), "o_custkey", "full")
    within = lambda x, y: F.size(F.array_except(x, y)) == 0
    code = F.when(F.col("a").isNull(), "ONLY_SECOND").when(F.col("b").isNull(),
        "ONLY_FIRST").when((F.col("a") == F.col("b")) & (F.col("an") == F.col("bn")), "EQUAL").when(F.col("a") == F.col("b"), "SET_EQUAL")
    code = code.when(within("b", "a"), "SECOND_WITHIN_FIRST").when(within("a", "b"), "FIRST_WITHIN_SECOND").when(F.arrays_overlap("a", "b"), "OVERLAP").otherwise("DISJOINT")
    return j.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@query(_X + """, e AS (SELECT max(known_date) AS until FROM tx), a AS (SELECT issuer, code, owner, accession, tx_date FROM tx, e WHERE tx_date > until - 730 AND code IN ('P', 'S'))
SELECT issuer, count(DISTINCT accession) AS filings, count(DISTINCT owner) AS owners, count(*) FILTER (code = 'P') AS purchases, max(tx_date) AS last_day FROM a GROUP BY issuer""")
def activity_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Issuers with anything bought or sold in the two years up to the last day known."""
    t = transactions(spark, d)
    until = t.agg(F.max("known_date")).first()[0]  # one value
    a = t.filter((F.col("tx_date") > F.date_sub(F.lit(until).cast("date"), 730)) & F.col("code").isin("P", "S"))
    return a.groupBy("issuer").agg(F.count_distinct("accession").alias("filings"), F.count_distinct("owner").alias("owners"),
        F.count_if(F.col("code") == "P").alias("purchases"), F.max("tx_date").alias("last_day"))


@query(f"""WITH {SIGNALS_SQL} SELECT lpad(cik, 10, '0') || ':' || signal_type || ':' || coalesce(run_id, '') AS key, count(*) AS candidates,
  max(score) AS score, count(*) FILTER (score NOT BETWEEN 0 AND 100) AS out_of_range
FROM sig WHERE cik IS NOT NULL AND signal_type IS NOT NULL GROUP BY ALL""")
def alert_keys(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by the key that makes sending them idempotent, and those that break an invariant."""
    s = signals(spark, d).filter("cik is not null and signal_type is not null")
    key = F.concat_ws(":", "cik", "signal_type", F.coalesce("run_id", F.lit("")))
    return s.groupBy(key.alias("key")).agg(F.count("*").alias("candidates"), F.max("score").alias("score"), F.count_if(~F.col("score").between(0, 100)).alias("out_of_range"))


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderdate AS at FROM orders), before AS (SELECT k FROM b WHERE s <> 'O'),
  fixed AS (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN b ON b.k = l_orderkey WHERE s = 'O' AND l_linestatus = 'F')
SELECT (SELECT count(*) FROM before) AS previous, (SELECT count(*) FROM fixed) AS resolved, count(*) AS rows, (SELECT count(*)
  FROM before) + (SELECT count(*) FROM fixed) = count(*) AS adds_up FROM (SELECT k FROM before UNION SELECT k FROM fixed)""")
def repair_receipt(spark: SparkSession, d: str) -> DataFrame:
    """What a repair left: previous rows and keys it resolved must add up to the rows there are now, each key once."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    before = o.filter("o_orderstatus <> 'O'").select("k").withColumn("was", F.lit(1))
    lines = table(spark, d, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("k"))
    fixed = o.filter("o_orderstatus = 'O'").join(lines, "k", "left_semi").select("k").distinct().withColumn("resolved", F.lit(1))
    now = before.unionByName(fixed, allowMissingColumns=True).groupBy("k").agg(F.sum("was").alias("was"), F.sum("resolved").alias("resolved"))
    n = now.agg(F.coalesce(F.sum("was"), F.lit(0)).alias("previous"), F.coalesce(F.sum("resolved"), F.lit(0)).alias("resolved"), F.count("*").alias("rows"))
    return n.withColumn("adds_up", F.col("previous") + F.col("resolved") == F.col("rows"))


# ---------------------------------------------------------------- orders and limits


@query(_SCHED + """ SELECT signal_id, cik, row_number() OVER (PARTITION BY cik ORDER BY score DESC NULLS LAST, known_at NULLS LAST,
  signal_id NULLS LAST, signal_type NULLS LAST, ticker NULLS LAST) AS place FROM sch WHERE cik IS NOT NULL""")
def total_order(spark: SparkSession, d: str) -> DataFrame:
    """Each issuer's signals by score, unknown ones last, then by what tells them apart."""
    order = [F.desc_nulls_last("score"), *[F.asc_nulls_last(c) for c in ("known_at", "signal_id", "signal_type", "ticker")]]
    s = study.session_at_or_after(signals(spark, d), sessions(spark, d), "known_at").filter("cik is not null")
    return s.select("signal_id", "cik", F.row_number().over(Window.partitionBy("cik").orderBy(*order)).cast("long").alias("place"))


@query(f"""WITH {BARS_SQL}, v AS (SELECT symbol, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY symbol) SELECT symbol, volume FROM v
  ORDER BY volume DESC NULLS LAST, symbol LIMIT 50""")
def probe_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The fifty symbols a probe may ask for: a top-k report."""
    v = bars(spark, d).groupBy("symbol").agg(F.sum("volume").cast("long").alias("volume"))
    return v.orderBy(F.desc_nulls_last("volume"), "symbol").limit(50)


@query(f"""WITH {BARS_SQL}, v AS (SELECT symbol, date, close FROM bars WHERE close > 0), m AS (SELECT symbol, date, close, count(*) OVER w AS n,
  avg(close) OVER w AS mean FROM v WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING))
SELECT symbol, arg_max(date, date) AS date, round(arg_max(CASE WHEN n >= 50 THEN mean END, date) FILTER (n >= 50), 8) AS observed_50 FROM m GROUP BY symbol""")
def observed_mean_50(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the last fifty closes that were observed at all, null while there are fewer."""
    w = Window.partitionBy("symbol").orderBy("date")
    m = bars(spark, d).filter("close > 0").select("symbol", "date", Wf.rolling_mean(F.col("close"), w, 50).alias("mean"))
    return m.groupBy("symbol").agg(F.max("date").alias("date"), F.round(F.max_by("mean", "date"), 8).alias("observed_50"))


# ---------------------------------------------------------------- scalar families


@query(f"""WITH {SIGNALS_SQL}, k AS (SELECT DISTINCT known_at FROM sig WHERE known_at IS NOT NULL)
SELECT known_at, CAST(s.session_idx AS BIGINT) AS closed_idx, CAST(date_trunc('month', known_at) AS DATE) - 1 AS last_month_end, known_at - INTERVAL 7 DAY AS week_before,
  CAST(known_at AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS local_day FROM k ASOF LEFT JOIN market_sessions s ON k.known_at >= s.close_utc""")
def closed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Of each time the last session closed by then, the end of the last complete month, and the day in New York."""
    k = signals(spark, d).select("known_at").filter("known_at is not null").distinct()
    own = sessions(spark, d).select(F.col("session_idx").cast("long").alias("own"), F.col("close_utc").cast("timestamp_ntz").alias("own_close"))
    last = own.agg(F.max("own").alias("last"))
    # the first session not closed before the time, unless it closes at that very time, has the one before it closed
    at = study.session_at_or_after(k, sessions(spark, d), "known_at").join(own, F.col("session_idx") == F.col("own"), "left")
    before = F.when(F.col("own").isNotNull(), F.when(F.col("own_close") == F.col("known_at"), F.col("own")).otherwise(F.col("own") - 1))
    first = own.agg(F.min("own").alias("first"))
    idx = F.coalesce(before, F.lit(last.first()[0]))  # one value each
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("known_at")))
    closed = F.when(idx >= F.lit(first.first()[0]), idx).alias("closed_idx")
    return at.select("known_at", closed, F.date_sub(F.to_date(F.date_trunc("month", "known_at")), 1).alias("last_month_end"),
        (F.col("known_at") - F.expr("INTERVAL 7 DAYS")).alias("week_before"), local.alias("local_day"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, count(*) AS parts, count(*) FILTER (q > 25) AS large, round(sum(q * 2), 4) AS doubled, min(l_linenumber) AS first_key,
  max(q) FILTER (l_linenumber = 1) AS of_first FROM m GROUP BY l_orderkey""")
def map_functions(spark: SparkSession, d: str) -> DataFrame:
    """Parts of an order as a map: its size, a filter, a transformation, keys and a lookup."""
    m = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    g = m.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("k"), "q"))).alias("m"))
    doubled = F.map_values(F.transform_values("m", lambda k, v: v * 2))
    return g.select("l_orderkey", F.size("m").cast("long").alias("parts"), F.size(F.map_filter("m", lambda k, v: v > 25)).cast("long").alias("large"),
        F.round(F.aggregate(doubled, F.lit(0.0), lambda a, x: a + x), 4).alias("doubled"), F.array_min(F.map_keys("m")).alias("first_key"),
            F.try_element_at("m", F.lit(1).cast("long")).alias("of_first"))


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value - 200 END AS x FROM events)
SELECT event_id, CASE WHEN x IS NOT NULL AND NOT isnan(x) THEN least(greatest(x, 0), 100) END AS clamped, CASE WHEN x IS NOT NULL
  AND NOT isnan(x) THEN round(log10(1 + greatest(x, 0)), 8) + 0.0 END AS logged,
  round((CASE WHEN isnan(x) THEN NULL ELSE x END) / nullif(event_id % 3, 0), 6) + 0.0 AS guarded FROM v""")
def math_functions(spark: SparkSession, d: str) -> DataFrame:
    """Clamps, logs and ratios that give null where they have no value."""
    x = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 200)
    e = table(spark, d, "events").select("event_id", x.alias("x"))
    known = F.when(~F.isnan("x"), F.col("x"))
    logged = F.round(F.log10(F.when(known.isNotNull(), F.greatest(known, F.lit(0.0))) + 1), 8) + 0.0
    return e.select("event_id", scores.clamp(F.col("x"), 0.0, 100.0).alias("clamped"), logged.alias("logged"),
        (F.round(F.try_divide(known, F.col("event_id") % 3), 6) + 0.0).alias("guarded"))


@query(r"""WITH s AS (SELECT DISTINCT strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') || ['', 'Z', '-05:00', '+09:30', ' UTC', 'T'][1 + l_orderkey % 6] AS raw FROM lineitem)
SELECT raw, CASE WHEN regexp_full_match(raw, '\d{4}-\d{2}-\d{2}(Z|[+-]\d{2}:\d{2})?') THEN CAST(substr(raw, 1, 10) AS DATE) END AS day FROM s""")
def zoned_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates with a zone behind them, read only where nothing else is there."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", "Z", "-05:00", "+09:30", " UTC", "T")]), (F.col("l_orderkey") % 6 + 1).cast("int"))
    s = table(spark, d, "lineitem").select(F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), suffix).alias("raw")).distinct()
    return s.select("raw", N.zoned_date(F.col("raw")).alias("day"))
