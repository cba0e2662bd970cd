"""Queries over ownership statements: what they are, whether they count and are in force, how they are checked and shared out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal as N
from ..functions import predicates as P
from ..operators import checks, fold, quantiles, resolve, rolling
from ..sources import ownership, records
from ..sources.tables import table
from .adapters import BARS_SQL, SIGNALS_SQL, TX_SQL, bars, sessions, signals, transactions
from .problems import _FILINGS_SQL, _accession
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

_CODES = ["P", "S", "A", "M", "G", "F", "T", "X", "Z", "P", "S"]
_TITLES = ["Common Stock", "Class A Common Shares", "Preferred Stock", "Stock Option (right to buy)", "ordinary shares", "Restricted Stock Units"]
_ROLES = ["Chief Executive Officer", "CFO & Treasurer", "Chairman of the Board", "VP, Sales", "CEO and Chairman"]
AS_OF = "1997-06-30"


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as ownership statements with all that may be missing, void or replaced."""
    li = table(spark, d, "lineitem")
    k = F.col("l_partkey") + F.col("l_orderkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    day = F.to_date("l_shipdate")
    code = pick(_CODES, k)
    acquired = F.when(F.col("l_orderkey") % 4 == 1, "A").when(F.col("l_orderkey") % 4 == 2, "D").when(F.col("l_orderkey") % 4 == 3, "")
    status = F.when(F.col("l_suppkey") % 7 == 0, "VOID").when(F.col("l_suppkey") % 7 < 3, "SUPERSEDED").when(F.col("l_suppkey") % 7 > 3, "ACTIVE")
    rows = li.select(
        F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("issuer"), (F.col("l_partkey") % 25).alias("owner"),
        F.when(F.col("l_orderkey") % 9 != 0, code).alias("code"), ownership.classification(code).alias("classification"),
            acquired.alias("acquired_disposed"), pick(_TITLES, F.col("l_partkey")).alias("title"),
        F.when(F.col("l_linenumber") % 5 == 0, "DERIVATIVE").otherwise("NON_DERIVATIVE").alias("table_type"), F.when(F.col("l_partkey") % 19 != 0, F.col("l_quantity")).alias("shares"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.when(F.col("l_partkey") % 17 != 0, F.col("l_extendedprice")).alias("value"), status.alias("status"), day.alias("tx_date"),
        F.date_add(day, (F.col("l_partkey") % 40).cast("int")).alias("filed"), F.when(F.col("l_partkey") % 13 != 0, day).alias("valid_from"),
            F.when(F.col("l_linestatus") == "F", F.date_add(day, 400)).alias("valid_to"),
    )
    return rows.withColumn("economic", ownership.economic_classification(F.col("classification"), F.col("acquired_disposed")))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


LEDGER_SQL = f"""plain AS (SELECT l_orderkey AS accession, l_linenumber AS line, l_partkey AS part, l_suppkey AS issuer, l_partkey % 25 AS owner,
  {_list(_CODES)}[1 + (l_partkey + l_orderkey) % {len(_CODES)}] AS c, CASE l_orderkey % 4 WHEN 1 THEN 'A' WHEN 2 THEN 'D' WHEN 3 THEN '' END AS acquired_disposed,
  {_list(_TITLES)}[1 + l_partkey % {len(_TITLES)}] AS title, CASE WHEN l_linenumber % 5 = 0 THEN 'DERIVATIVE' ELSE 'NON_DERIVATIVE' END AS table_type,
  CASE WHEN l_partkey % 19 <> 0 THEN l_quantity END AS shares, l_extendedprice / l_quantity AS price, CASE WHEN l_partkey % 17 <> 0 THEN l_extendedprice END AS value,
  CASE WHEN l_suppkey % 7 = 0 THEN 'VOID' WHEN l_suppkey % 7 < 3 THEN 'SUPERSEDED' WHEN l_suppkey % 7 > 3 THEN 'ACTIVE' END AS status, CAST(l_shipdate AS DATE) AS tx_date,
  CAST(l_shipdate AS DATE) + CAST(l_partkey % 40 AS INT) AS filed, CASE WHEN l_partkey % 13 <> 0 THEN CAST(l_shipdate AS DATE) END AS valid_from,
  CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + 400 END AS valid_to FROM lineitem),
classed AS (SELECT *, CASE WHEN accession % 9 <> 0 THEN c END AS code, CASE c WHEN 'P' THEN 'OPEN_MARKET_PURCHASE' WHEN 'S' THEN 'OPEN_MARKET_SALE' WHEN 'A' THEN 'AWARD'
  WHEN 'M' THEN 'OPTION_EXERCISE' WHEN 'G' THEN 'GIFT' WHEN 'F' THEN 'TAX_WITHHOLDING' WHEN 'T' THEN 'TRANSFER' WHEN 'X' THEN 'TRANSFER' ELSE 'OTHER' END AS classification FROM plain),
led AS (SELECT *, CASE WHEN classification = 'AWARD' THEN 'GRANT_AWARD' WHEN classification NOT IN ('TRANSFER', 'OTHER') THEN classification
  WHEN acquired_disposed = 'A' THEN 'OTHER_ACQUISITION' ELSE 'OTHER_DISPOSITION' END AS economic FROM classed)"""
_L = f"WITH {LEDGER_SQL}"
_BUY = "(coalesce(acquired_disposed, '') IN ('', 'A') AND (coalesce(code = 'P', false) OR classification = 'OPEN_MARKET_PURCHASE' OR economic = 'OPEN_MARKET_PURCHASE'))"
_SELL = "(coalesce(acquired_disposed, '') IN ('', 'D') AND (coalesce(code = 'S', false) OR classification = 'OPEN_MARKET_SALE' OR economic = 'OPEN_MARKET_SALE'))"
_FORCE = f"""(coalesce(valid_from <= DATE '{AS_OF}', true) AND coalesce(DATE '{AS_OF}' < valid_to, true)
  AND (coalesce(status, 'ACTIVE') = 'ACTIVE' OR (status = 'SUPERSEDED' AND valid_to IS NOT NULL)))"""
_PRICED = "(table_type = 'NON_DERIVATIVE' AND coalesce(shares > 0, false) AND coalesce(price > 0, false) AND value IS NOT NULL)"


def _sides() -> tuple:
    c = [F.col(x) for x in ("code", "acquired_disposed", "classification", "economic")]
    return P.purchase(*c), P.sale(*c)


def _priced():  # noqa: ANN202
    return P.priced(F.col("table_type"), F.col("shares"), F.col("price"), F.col("value"))


# ---------------------------------------------------------------- what statements are


@query(_L + f""" SELECT issuer, count(*) FILTER ({_BUY}) AS purchases, count(*) FILTER ({_SELL}) AS sales,
  round(coalesce(sum(coalesce(value, shares * price)) FILTER ({_BUY}), 0), 4) AS bought FROM led WHERE {_FORCE} GROUP BY issuer""")
def in_force_activity(spark: SparkSession, d: str) -> DataFrame:
    """Purchases and sales, by code or either classification, of the statements in force on a day."""
    buy, sell = _sides()
    held = ledger(spark, d).filter(P.in_force(F.col("status"), F.col("valid_from"), F.col("valid_to"), F.lit(AS_OF).cast("date")))
    paid = F.coalesce("value", F.col("shares") * F.col("price"))
    return held.groupBy("issuer").agg(F.count_if(buy).alias("purchases"), F.count_if(sell).alias("sales"), F.round(F.coalesce(F.sum(F.when(buy, paid)), F.lit(0.0)), 4).alias("bought"))


@query(_L + " SELECT classification, economic, acquired_disposed, count(*) AS n FROM led GROUP BY ALL")
def classified_codes(spark: SparkSession, d: str) -> DataFrame:
    """What codes and flags stand for."""
    return ledger(spark, d).groupBy("classification", "economic", "acquired_disposed").agg(F.count("*").alias("n"))


@query(f"""WITH r AS (SELECT {_list(_ROLES)}[1 + c_custkey % {len(_ROLES)}] AS title, ['1', 'true', 'Y', '0', NULL][1 + c_nationkey % 5] AS flag, c_nationkey % 3 = 0 AS ten FROM customer)
SELECT concat_ws(',', CASE WHEN title LIKE '%CEO%' OR title LIKE '%Chief Executive%' THEN 'CEO' END, CASE WHEN title LIKE '%CFO%' THEN 'CFO' END,
  CASE WHEN title LIKE '%Chair%' THEN 'CHAIR' END,
  CASE WHEN lower(flag) IN ('1', 'true', 'y') THEN 'DIRECTOR' END, CASE WHEN title LIKE 'VP%' THEN 'OFFICER' END, CASE WHEN ten THEN 'TEN_PERCENT' END,
  CASE WHEN flag = '0' THEN 'OTHER' END) AS roles, count(*) AS n FROM r GROUP BY ALL""")
def role_sets(spark: SparkSession, d: str) -> DataFrame:
    """Roles out of titles and flags."""
    at = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(c) % len(values) + 1).cast("int"))
    r = table(spark, d, "customer").select(at(_ROLES, "c_custkey").alias("title"), at(["1", "true", "Y", "0", None], "c_nationkey").alias("flag"),
        (F.col("c_nationkey") % 3 == 0).cast("string").alias("ten"))
    found = ownership.roles(F.col("title"), F.col("flag"), F.col("title").startswith("VP").cast("string"), F.col("ten"), F.when(F.col("flag") == "0", "yes"))
    return r.groupBy(F.array_join(found, ",").alias("roles")).agg(F.count("*").alias("n"))


@query(_L + f""" SELECT issuer, count(*) FILTER ({_PRICED} AND code = 'P' AND acquired_disposed = 'A' AND filed <= DATE '{AS_OF}' AND tx_date BETWEEN DATE '{AS_OF}' - 365 AND DATE '{AS_OF}'
    AND regexp_matches(title, '\\b(common[ _-]?(stock|shares?)|ordinary[ _-]?shares?)\\b', 'i')) AS live,
  count(*) FILTER (table_type = 'NON_DERIVATIVE' AND code = 'P' AND acquired_disposed = 'A' AND economic = 'OPEN_MARKET_PURCHASE') AS research,
  count(*) FILTER ({_PRICED} AND ((code = 'P' AND acquired_disposed = 'A') OR (code = 'S' AND acquired_disposed = 'D'))) AS economic FROM led GROUP BY issuer""")
def qualified_purchases(spark: SparkSession, d: str) -> DataFrame:
    """How many statements of each issuer pass the three forms of qualification."""
    end = F.lit(AS_OF).cast("date")
    bought = (F.col("code") == "P") & (F.col("acquired_disposed") == "A")
    live = _priced() & bought & (F.col("filed") <= end) & F.col("tx_date").between(F.date_sub(end, 365), end) & P.common_stock(F.col("title"))
    research = (F.col("table_type") == "NON_DERIVATIVE") & bought & (F.col("economic") == "OPEN_MARKET_PURCHASE")
    economic = _priced() & (bought | (F.col("code") == "S") & (F.col("acquired_disposed") == "D"))
    return ledger(spark, d).groupBy("issuer").agg(F.count_if(live).alias("live"), F.count_if(research).alias("research"), F.count_if(economic).alias("economic"))


@query(_L + """, q AS (SELECT year(tx_date) AS y, month(tx_date) AS m, filed FROM led) SELECT CASE WHEN y NOT BETWEEN 1993 AND 1999 THEN 'OUTSIDE'
  WHEN (y, m) > (year(filed), month(filed)) THEN 'IMPOSSIBLE' ELSE 'KEEP' END AS decision,
  count(*) AS n FROM (SELECT y, CASE WHEN y % 2 = 0 THEN m ELSE m + 1 END AS m, filed FROM q) GROUP BY ALL""")
def bounded_history(spark: SparkSession, d: str) -> DataFrame:
    """Months of trading kept, outside the span, or later than the month they were filed in; pairs compare as structs."""
    y, m = F.year("tx_date"), F.month("tx_date")
    stated = F.struct(y.alias("y"), F.when(y % 2 == 0, m).otherwise(m + 1).alias("m"))
    later = stated > F.struct(F.year("filed").alias("y"), F.month("filed").alias("m"))
    decision = F.when(~y.between(1993, 1999), "OUTSIDE").when(later, "IMPOSSIBLE").otherwise("KEEP")
    return ledger(spark, d).groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@query(_L + """, r AS (SELECT part, median(price) AS usual FROM led GROUP BY part), j AS (SELECT CASE WHEN led.part % 23 = 0 THEN led.price * 5000
  ELSE led.price END AS p, CASE WHEN led.part % 29 = 0 THEN 0 ELSE usual END AS u FROM led JOIN r USING (part))
SELECT CASE WHEN p IS NULL OR u IS NULL OR p <= 0 OR u <= 0 THEN 'UNAVAILABLE' WHEN greatest(p / u, u / p) >= 1000 THEN 'REVIEW' ELSE 'NO_FLAG'
  END AS review, count(*) AS n FROM j GROUP BY ALL""")
def price_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Prices a thousand times off the usual one of their part, either way."""
    led = ledger(spark, d)
    usual = quantiles.quantiles(led, ["part"], "price", {"usual": 0.5})
    j = led.join(usual, "part").select(F.when(F.col("part") % 23 == 0, F.col("price") * 5000).otherwise(F.col("price")).alias("p"),
        F.when(F.col("part") % 29 == 0, F.lit(0.0)).otherwise(F.col("usual")).alias("u"))
    there = P.positive(F.col("p")) & P.positive(F.col("u"))
    far = F.greatest(F.try_divide("p", "u"), F.try_divide("u", "p")) >= 1000
    return j.groupBy(F.when(~there, "UNAVAILABLE").when(far, "REVIEW").otherwise("NO_FLAG").alias("review")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- flat rows


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Statements as nested records, every third flat and in other spellings instead."""
    led = ledger(spark, d).withColumn("flat", F.col("part") % 3 == 0)
    nested = lambda c: F.when(~F.col("flat"), c)
    flat = lambda c: F.when(F.col("flat"), F.col(c))
    return led.select(
        "accession", "line", "part", "issuer", "tx_date", "price",
        nested(F.struct(F.col("issuer").cast("string").alias("cik"))).alias("issuerRecord"), nested(F.struct(F.col("owner").cast("string").alias("cik"))).alias("reportingOwner"),
        nested(F.struct("code", F.col("acquired_disposed").alias("acquiredDisposed"), F.col("tx_date").alias("transactionDate"), "value", "shares",
            F.col("price").alias("pricePerShare"), "classification")).alias("transaction"),
        nested(F.struct("status", F.col("valid_from").alias("validFrom"), F.col("valid_to").alias("validTo"))).alias("lifecycle"),
        flat("owner").alias("owner_cik"), flat("code").alias("transaction_code"), flat("acquired_disposed").alias("acquired_disposed_code"),
            flat("tx_date").alias("event_at"), flat("value").alias("value_usd"),
        flat("shares").alias("shares"), flat("classification").alias("classification"), flat("status").alias("status"),
            flat("valid_from").alias("valid_from"), flat("valid_to").alias("valid_to"),
    )


_ORDER = ["accession", "line", "part", "issuer", "tx_date", "price"]
_ORDERED = ", ".join(_ORDER)


@query(_L + f""" SELECT row_number() OVER (ORDER BY {_ORDERED}) - 1 AS row_id, CAST(issuer AS VARCHAR) AS issuer_cik,
  CAST(owner AS VARCHAR) AS owner_cik, tx_date AS transaction_date, upper(coalesce(code, '')) AS code,
  coalesce(acquired_disposed, '') AS acquired_disposed, 'NON_DERIVATIVE' AS table_type, classification, round(coalesce(value, shares * price), 6) AS value_usd, shares, 'UNKNOWN' AS rule_10b5_1,
  coalesce(status, 'ACTIVE') AS lifecycle_status, CAST(valid_from AS TIMESTAMP) AS valid_from, CAST(valid_to AS TIMESTAMP) AS valid_to FROM led""")
def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nested and flat statements of several spellings as flat rows, numbered in a total order."""
    numbered = rolling.ordered_index(_nested(spark, d), _ORDER, "row_id")
    f = records.flat_transactions(numbered, ["row_id"]).withColumn("value_usd", F.round("value_usd", 6))
    return f.select("row_id", "issuer_cik", "owner_cik", "transaction_date", "code", "acquired_disposed", "table_type", "classification", "value_usd",
        "shares", "rule_10b5_1", "lifecycle_status", "valid_from", "valid_to")


@query(_L + f""", n AS (SELECT *, row_number() OVER (ORDER BY {_ORDERED}) - 1 AS row_id FROM led), a AS (SELECT row_id,
  value / sum(value) OVER (PARTITION BY issuer) AS weight FROM n WHERE value IS NOT NULL),
b AS (SELECT row_id, shares >= 25 AS large FROM n WHERE shares IS NOT NULL) SELECT n.row_id, n.issuer, round(weight, 9) AS weight, large,
  status = 'ACTIVE' AS active FROM n LEFT JOIN a USING (row_id) LEFT JOIN b USING (row_id)""")
def row_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores that some rows have, put onto all of them: columns of one plan instead of joins by row number."""
    n = rolling.ordered_index(ledger(spark, d), _ORDER, "row_id")
    total = n.groupBy("issuer").agg(F.sum("value").alias("total"))
    return n.join(total, "issuer").select("row_id", "issuer", F.round(F.col("value") / F.col("total"), 9).alias("weight"),
        (F.col("shares") >= 25).alias("large"), (F.col("status") == "ACTIVE").alias("active"))


# ---------------------------------------------------------------- windows of activity

_GRAINS = {"daily": 1, "weekly": 7, "4w": 28, "13w": 91}
PULSE_END = "1998-03-18"


@query(f"""WITH {TX_SQL}, e AS (SELECT DATE '{PULSE_END}' AS until, CAST(date_trunc('week', DATE '{PULSE_END}') AS DATE) AS monday), g(grain,
  days) AS (VALUES ('daily', 1), ('weekly', 7), ('4w', 28), ('13w', 91)),
k AS (SELECT grain, days, CASE WHEN days = 1 THEN until - tx_date ELSE floor((monday - CAST(date_trunc('week', tx_date) AS DATE)) / days)
  END AS back, tx.* FROM tx, e, g WHERE tx_date <= until AND known_date <= until AND code IN ('P', 'S')),
w AS (SELECT *, CASE WHEN days = 1 THEN tx_date ELSE monday - CAST(back * days AS INT) - (days - 7) END AS starts FROM k, e), u AS (SELECT *, CASE
  WHEN back = 0 THEN until ELSE starts + days - 1 END AS ends FROM w),
a AS (SELECT grain, s.sector, starts, back = 0 AS is_current, count(*) FILTER (code = 'P') AS purchases, count(*) FILTER (code = 'S') AS sales,
  count(DISTINCT owner) FILTER (code = 'P') AS buyers, count(DISTINCT issuer) FILTER (code = 'P') AS issuers_bought
  FROM u, LATERAL (SELECT NULL AS sector UNION ALL SELECT role) s WHERE known_date <= ends GROUP BY ALL),
r AS (SELECT *, round(purchases / nullif(sales, 0), 8) AS ratio FROM a),
c AS (SELECT * FROM r WHERE is_current), h AS (SELECT * FROM r WHERE NOT is_current)
SELECT c.grain, c.sector, c.starts AS period_start, c.purchases, c.sales, c.buyers, c.issuers_bought, c.ratio, count(h.ratio) AS windows,
  round(CASE WHEN c.ratio IS NOT NULL AND count(h.ratio) > 0 THEN least(100.0,
  100.0 * (count(*) FILTER (h.ratio < c.ratio) + (count(*) FILTER (h.ratio = c.ratio) + 1) / 2.0) / count(h.ratio)) END, 8) AS percentile
FROM c LEFT JOIN h ON h.grain = c.grain AND h.sector IS NOT DISTINCT FROM c.sector
GROUP BY c.grain, c.sector, c.starts, c.purchases, c.sales, c.buyers, c.issuers_bought, c.ratio""")
def pulse_windows(spark: SparkSession, d: str) -> DataFrame:
    """The day, week, four and thirteen weeks up to a day, over the market and by sector, each against the windows of its
    kind before it, which count what was known by their ends."""
    end = F.lit(PULSE_END).cast("date")
    monday = F.to_date(F.date_trunc("week", end.cast("timestamp")))
    t = transactions(spark, d).filter((F.col("tx_date") <= end) & (F.col("known_date") <= end) & F.col("code").isin("P", "S"))
    grains = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), F.lit(n).alias("days")) for g, n in _GRAINS.items()]))
    k = t.withColumn("g", grains).select("*", "g.grain", "g.days")
    weeks = F.floor(F.datediff(monday, F.to_date(F.date_trunc("week", "tx_date"))) / F.col("days"))
    k = k.withColumn("back", F.when(F.col("days") == 1, F.datediff(end, "tx_date")).otherwise(weeks).cast("int"))
    k = k.withColumn("starts", F.when(F.col("days") == 1, F.col("tx_date")).otherwise(F.date_sub(monday, F.col("back") * F.col("days") + F.col("days") - 7)))
    k = k.withColumn("ends", F.when(F.col("back") == 0, end).otherwise(F.date_add("starts", F.col("days") - 1))).filter("known_date <= ends")
    buy = F.col("code") == "P"
    a = k.groupingSets([[F.col("grain"), F.col("starts"), F.col("back")], [F.col("grain"), F.col("starts"), F.col("back"), F.col("role")]], "grain", "starts", "back", "role").agg(
        F.count_if(buy).alias("purchases"), F.count_if(~buy).alias("sales"), F.count_distinct(F.when(buy, F.col("owner"))).alias("buyers"),
            F.count_distinct(F.when(buy, F.col("issuer"))).alias("issuers_bought")
    )
    r = a.withColumn("ratio", F.round(F.col("purchases") / F.nullif("sales", F.lit(0)), 8)).withColumnRenamed("role", "sector")
    now = r.filter("back = 0").drop("back")
    before = r.filter("back > 0").select(F.col("grain").alias("g"), F.col("sector").alias("s"), F.col("ratio").alias("earlier"))
    j = now.join(before, (F.col("g") == F.col("grain")) & F.col("s").eqNullSafe(F.col("sector")), "left")
    keys = ["grain", "sector", "starts", "purchases", "sales", "buyers", "issuers_bought", "ratio"]
    c = j.groupBy(*keys).agg(F.count("earlier").alias("windows"), F.count_if(F.col("earlier") < F.col("ratio")).alias("less"), F.count_if(F.col("earlier") == F.col("ratio")).alias("equal"))
    p = F.least(F.lit(100.0), F.lit(100.0) * (F.col("less") + (F.col("equal") + 1) / 2) / F.col("windows"))
    return c.select("grain", "sector", F.col("starts").alias("period_start"), "purchases", "sales", "buyers", "issuers_bought", "ratio", "windows",
        F.round(F.when(F.col("ratio").isNotNull() & (F.col("windows") > 0), p), 8).alias("percentile"))


@query(_L + f""", days AS (SELECT filed AS day, bool_and(part % 211 <> 0) AS complete FROM led GROUP BY filed), e AS (SELECT w.days AS days,
  DATE '{AS_OF}' - w.days + 1 AS starts FROM (VALUES (30), (90)) w(days)),
c AS (SELECT e.days, e.starts, count(*) FILTER (complete) = e.days AS complete FROM e LEFT JOIN days ON day BETWEEN e.starts AND DATE '{AS_OF}' GROUP BY e.days, e.starts)
SELECT issuer, c.days, round(sum(value) / nullif(sum(shares), 0), 6) AS basis, count(*) AS purchases, CASE WHEN complete THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage
FROM led JOIN c ON tx_date BETWEEN c.starts AND DATE '{AS_OF}' WHERE {_PRICED} AND code = 'P' GROUP BY issuer, c.days, complete""")
def basis_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What purchases of 30 and 90 days cost a share, and whether every day of the window was taken in whole."""
    led, end = ledger(spark, d), F.lit(AS_OF).cast("date")
    days = led.groupBy(F.col("filed").alias("day")).agg(F.bool_and(F.col("part") % 211 != 0).alias("whole")).filter(F.col("day") <= end)
    whole = [F.count_if(F.col("whole") & (F.col("day") >= F.date_sub(end, n - 1))).alias(f"whole_{n}") for n in (30, 90)]
    spans = days.agg(*whole).select(F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("days"),
        (F.col(f"whole_{n}") == n).alias("complete")) for n in (30, 90)])).alias("c")).select("c.*")
    bought = led.filter(_priced() & (F.col("code") == "P") & (F.col("tx_date") <= end) & (F.col("tx_date") >= F.date_sub(end, 89)))
    windows = F.explode(F.array_compact(F.array(*[F.when(F.col("tx_date") >= F.date_sub(end, n - 1), F.lit(n).cast("long")) for n in (30, 90)])))
    g = bought.withColumn("days", windows).groupBy("issuer", "days").agg(F.round(F.sum("value") / F.nullif(F.sum("shares"), F.lit(0.0)), 6).alias("basis"), F.count("*").alias("purchases"))
    return g.join(spans, "days").select("issuer", "days", "basis", "purchases", F.when(F.col("complete"), "COMPLETE").otherwise("PARTIAL").alias("coverage"))


# ---------------------------------------------------------------- state from day to day

_SCHED = f"WITH {SIGNALS_SQL}, sch AS (SELECT sig.*, CAST(s.session_idx AS BIGINT) AS session_idx FROM sig ASOF LEFT JOIN market_sessions s ON sig.known_at <= s.close_utc)"


@query(_SCHED + """, q AS (SELECT *, row_number() OVER (PARTITION BY cik, session_idx ORDER BY known_at, signal_id, score NULLS FIRST,
  signal_type NULLS FIRST, ticker NULLS FIRST) AS turn FROM sch WHERE cik IS NOT NULL AND session_idx IS NOT NULL),
f AS (SELECT cik, session_idx, score AS first_score, last_value(CAST(floor(score / 20) AS BIGINT) IGNORE NULLS) OVER (PARTITION BY cik ORDER BY session_idx) AS level FROM q WHERE turn = 1)
SELECT cik, session_idx, level, CASE WHEN turn > 1 THEN 'SAME_SESSION_STATE_REUSED' WHEN first_score IS NULL
  AND level IS NOT NULL THEN 'STALE_DATA_HOLD' WHEN level IS NULL THEN 'UNKNOWN' ELSE 'EVALUATED' END AS reason, count(*) AS rows
FROM q JOIN f USING (cik, session_idx) GROUP BY ALL""")
def state_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Each issuer's level by session. The first evaluation of a session decides it, later ones of the session reuse it, and one
    without a score holds the level before."""
    from ..operators import study

    s = study.session_at_or_after(signals(spark, d), sessions(spark, d), "known_at").filter("cik is not null and session_idx is not null")
    first = s.groupBy("cik", "session_idx").agg(F.min(F.struct("known_at", "signal_id", "score", "signal_type", "ticker")).alias("f"), F.count("*").alias("rows"))
    level = F.last(F.floor(F.col("f.score") / 20), ignorenulls=True).over(Window.partitionBy("cik").orderBy("session_idx").rowsBetween(Window.unboundedPreceding, 0))
    states = first.withColumn("level", level)
    own = F.when(F.col("level").isNull(), "UNKNOWN").when(F.col("f.score").isNull(), "STALE_DATA_HOLD").otherwise("EVALUATED")
    parts = F.explode(F.array(F.struct(own.alias("reason"), F.lit(1).cast("long").alias("rows")),
        F.struct(F.lit("SAME_SESSION_STATE_REUSED").alias("reason"), (F.col("rows") - 1).alias("rows"))))
    return states.select("cik", "session_idx", "level", parts.alias("p")).select("cik", "session_idx", "level", "p.reason", "p.rows").filter("rows > 0")


@query(_SCHED.replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT cik, signal_type, CAST(known_at AS DATE) AS day, max(score) AS score FROM sch
  WHERE cik IS NOT NULL AND signal_type IS NOT NULL AND known_at IS NOT NULL AND score IS NOT NULL GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY cik, signal_type ORDER BY day) AS n FROM e),
k AS (SELECT cik, signal_type, n, day AS last_day, score AS last_score, 1 AS kept, 0 AS overridden FROM o WHERE n = 1
  UNION ALL SELECT o.cik, o.signal_type, o.n, CASE WHEN o.day - last_day >= 14 OR abs(o.score - last_score) >= 40 THEN o.day ELSE last_day END, CASE
  WHEN o.day - last_day >= 14 OR abs(o.score - last_score) >= 40 THEN o.score ELSE last_score END,
  kept + CASE WHEN o.day - last_day >= 14 OR abs(o.score - last_score) >= 40 THEN 1 ELSE 0 END, overridden + CASE WHEN o.day - last_day < 14
  AND abs(o.score - last_score) >= 40 THEN 1 ELSE 0 END
  FROM k JOIN o ON o.cik = k.cik AND o.signal_type = k.signal_type AND o.n = k.n + 1)
SELECT cik, signal_type, CAST(max(kept) AS BIGINT) AS kept, CAST(max(overridden) AS BIGINT) AS overridden FROM k GROUP BY ALL""")
def cooldown_override(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of an issuer and type two weeks apart, unless the score has moved far since the last one."""
    e = signals(spark, d).select("cik", "signal_type", F.to_date("known_at").alias("day"), "score").dropna().groupBy("cik", "signal_type", "day").agg(F.max("score").alias("score"))
    a = e.groupBy("cik", "signal_type").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("day").alias("day"), "score"))).alias("steps"))
    return a.select("cik", "signal_type", fold.cooldown(F.col("steps"), 14, 40.0).alias("k")).select("cik", "signal_type",
        F.col("k.kept").cast("long").alias("kept"), F.col("k.overridden").cast("long").alias("overridden"))


_SEEN = r"""s AS (SELECT lpad(cik, 10, '0') AS cik, knowledge_at, regexp_replace(upper(trim(ticker)), '[\s./_-]+([A-Z0-9]{1,2})$', '-\1') AS ticker,
  upper(trim(exchange)) AS exchange, identity_status FROM identity_snapshots)"""


@query(f"""WITH {_SEEN}, u AS (SELECT * FROM s WHERE knowledge_at < TIMESTAMP '2022-01-01' UNION ALL SELECT * FROM s), g AS (SELECT cik, knowledge_at,
  count(DISTINCT (coalesce(ticker, '~'), coalesce(exchange, '~'), coalesce(identity_status, '~'))) AS n,
  any_value(ticker) AS t, any_value(exchange) AS e FROM u WHERE cik IS NOT NULL AND knowledge_at IS NOT NULL GROUP BY ALL)
SELECT cik, knowledge_at, CASE WHEN n = 1 THEN t END AS ticker, CASE WHEN n = 1 THEN e END AS exchange, n > 1 AS conflict FROM g""")
def observation_append(spark: SparkSession, d: str) -> DataFrame:
    """A stored history of observations and a new delivery that repeats it: one row per issuer and instant, those of one
    instant that differ marked as conflicts."""
    s = table(spark, d, "identity_snapshots").select(N.cik(F.col("cik")).alias("cik"), "knowledge_at", N.ticker(F.col("ticker")).alias("ticker"),
        N.symbol(F.col("exchange")).alias("exchange"), "identity_status")
    both = s.filter("knowledge_at < timestamp_ntz'2022-01-01'").unionByName(s).filter("cik is not null and knowledge_at is not null")
    return resolve.merged_observations(both, ["cik", "knowledge_at"], ["ticker", "exchange", "identity_status"]).select("cik", "knowledge_at", "ticker", "exchange", "conflict")


@query()
def amendment_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Statements and amendments that name what they replace, resolved row by row."""
    led = ledger(spark, d)
    w = Window.partitionBy("issuer", "owner", F.col("line") % 3).orderBy("tx_date", "accession", "line", "part")
    text = lambda *c: F.concat_ws("-", *[F.col(x).cast("string") for x in c])
    amends = F.col("acquired_disposed") == "D"
    s = led.select(
        text("accession", "line", "part", "tx_date").alias("revision_id"),
            F.concat(F.lit("t"), text("accession", "line", "part", "tx_date")).alias("transaction_id"),
            F.col("issuer").cast("string").alias("issuer"), F.col("owner").cast("string").alias("owner"),
        F.lit("N").alias("table_type"), (F.col("line") % 3).cast("int").alias("row_sequence"), F.col("accession").cast("string").alias("accession"),
            checks.content_hash(["part", "value", "shares"]).alias("content_hash"), amends.alias("is_amendment"),
        F.when(amends & (F.col("part") % 2 == 0), F.lag(text("accession", "line", "part", "tx_date")).over(w)).alias("supersedes"),
            F.when(amends & (F.col("part") % 2 == 1), F.lag("accession").over(w).cast("string")).alias("amends_accession"),
        F.col("tx_date").cast("timestamp_ntz").alias("known_at"), F.col("tx_date").cast("timestamp_ntz").alias("recorded_at"), F.col("tx_date").cast("timestamp_ntz").alias("valid_from"),
    )
    return resolve.resolve_revisions(s)


# ---------------------------------------------------------------- days, shards and catalogues


@query(_FILINGS_SQL + r""", r AS (SELECT f.key, CAST(f.accepted_at AS DATE) AS filed, payload IS NOT NULL AS stored FROM f
  JOIN sec_raw_records USING (delivery_id) WHERE key <> '' AND f.accepted_at IS NOT NULL),
k AS (SELECT filed, key, bool_or(stored) AS stored FROM r GROUP BY ALL)
SELECT filed, count(*) AS discovered, count(*) FILTER (stored) AS stored, count(*) FILTER (NOT stored) AS failed,
  count(*) FILTER (NOT stored) = 0 AS complete, sha256(string_agg(key || CASE WHEN stored THEN '+' ELSE '-' END, ',' ORDER BY key)) AS name FROM k
  GROUP BY filed""")
def day_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """Per day the filings discovered, stored and failed, and a name for exactly that content."""
    r = table(spark, d, "sec_raw_records").select(_accession().alias("key"), F.to_date("accepted_at").alias("filed"),
        F.col("payload").isNotNull().alias("stored")).filter("key is not null and filed is not null")
    return checks.day_checkpoints(r.groupBy("filed", "key").agg(F.bool_or("stored").alias("stored")), "filed", "key", "stored")


@query(_FILINGS_SQL + """, k AS (SELECT DISTINCT key FROM f WHERE key <> ''), held AS (SELECT DISTINCT key FROM f
  JOIN sec_raw_records USING (delivery_id) WHERE key <> '' AND payload IS NOT NULL),
l AS (SELECT DISTINCT key FROM f JOIN sec_raw_records USING (delivery_id) WHERE key <> '' AND payload IS NULL)
SELECT problem, n FROM (SELECT 'FAILED_AND_STORED' AS problem, count(*) AS n FROM held JOIN l USING (key) UNION ALL SELECT 'UNACCOUNTED', count(*)
  FROM k WHERE key NOT IN (SELECT key FROM held UNION SELECT key FROM l)
UNION ALL SELECT 'UNDISCOVERED', count(*) FROM (SELECT key FROM held UNION SELECT key FROM l) WHERE key NOT IN (SELECT key FROM k))""")
def checkpoint_sets(spark: SparkSession, d: str) -> DataFrame:
    """Whether what was discovered is what was stored or failed, and nothing is both: one aggregate over marked keys."""
    r = table(spark, d, "sec_raw_records").select(_accession().alias("key"), "payload").filter("key is not null")
    marks = r.groupBy("key").agg(F.lit(True).alias("found"), F.bool_or(F.col("payload").isNotNull()).alias("stored"), F.bool_or(F.col("payload").isNull()).alias("failed"))
    n = {"FAILED_AND_STORED": F.col("stored") & F.col("failed"), "UNACCOUNTED": F.col("found") & ~F.col("stored") & ~F.col("failed"), "UNDISCOVERED": ~F.col("found")}
    one = marks.agg(*[F.count_if(c).alias(k) for k, c in n.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("problem"), F.col(k).alias("n")) for k in n])).alias("p")).select("p.*")


@query("""WITH s AS (SELECT DISTINCT lpad(issuer_cik, 10, '0') AS cik FROM insider_signals WHERE issuer_cik IS NOT NULL), h AS (SELECT cik,
  CAST('0x' || substr(sha256(cik), 1, 8) AS BIGINT) % 8 AS shard FROM s)
SELECT shard, count(*) AS issuers, min(cik) AS first_cik FROM h GROUP BY shard""")
def issuer_shards(spark: SparkSession, d: str) -> DataFrame:
    """Issuers dealt over eight shards by their hash, the same whatever else there is."""
    s = table(spark, d, "insider_signals").select(N.cik(F.col("issuer_cik")).alias("cik")).filter("cik is not null").distinct()
    shard = F.conv(F.substring(F.sha2("cik", 256), 1, 8), 16, 10).cast("long") % 8
    return s.groupBy(shard.alias("shard")).agg(F.count("*").alias("issuers"), F.min("cik").alias("first_cik"))


@query(_L + """, a AS (SELECT owner, year(tx_date) AS y, month(tx_date) AS m, min(filed) AS filed FROM led WHERE part % 2 = 0 GROUP BY ALL),
  b AS (SELECT owner, year(tx_date) AS y, month(tx_date) AS m, min(filed) AS filed FROM led WHERE part % 2 = 1 GROUP BY ALL),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT owner, CAST(y AS BIGINT) AS year, CAST(m AS BIGINT) AS month, min(filed) AS first_filed, count(*) AS artifacts FROM u GROUP BY ALL""")
def earliest_filed(spark: SparkSession, d: str) -> DataFrame:
    """Partial histories of two artifacts as one: the earliest filing of each owner's month."""
    led = ledger(spark, d)
    part = lambda k: led.filter(F.col("part") % 2 == k).groupBy("owner", F.year("tx_date").cast("long").alias("year"),
        F.month("tx_date").cast("long").alias("month")).agg(F.min("filed").alias("filed"))
    return part(0).unionByName(part(1)).groupBy("owner", "year", "month").agg(F.min("filed").alias("first_filed"), F.count("*").alias("artifacts"))


@query(_L + """, t AS (SELECT DISTINCT issuer, owner FROM led WHERE code = 'P'), x AS (SELECT issuer, owner,
  list_sort(list_distinct(list(title))) AS titles, list_sort(list_distinct(list(tx_date))) AS days FROM led WHERE table_type = 'DERIVATIVE'
  GROUP BY ALL)
SELECT t.issuer, t.owner, titles, CAST(len(days) AS BIGINT) AS days FROM t LEFT JOIN x USING (issuer, owner)""")
def security_titles(spark: SparkSession, d: str) -> DataFrame:
    """Buyers with the distinct titles and days of their derivative lines, if they have any."""
    led = ledger(spark, d)
    t = led.filter("code = 'P'").select("issuer", "owner").distinct()
    x = led.filter("table_type = 'DERIVATIVE'").join(t, ["issuer", "owner"], "left_semi").groupBy("issuer",
        "owner").agg(F.array_sort(F.collect_set("title")).alias("titles"), F.count_distinct("tx_date").alias("days"))
    return t.join(x, ["issuer", "owner"], "left")


@query(f"""WITH {SIGNALS_SQL}, {BARS_SQL}, e AS (SELECT signal_id, ticker, CAST(known_at AS DATE) AS day FROM sig WHERE known_at IS NOT NULL),
  l AS (SELECT symbol, min(date) AS first_day, max(date) AS last_day FROM bars GROUP BY symbol),
m AS (SELECT signal_id, e.ticker, CASE WHEN e.ticker IS NULL THEN 'NO_TICKER' WHEN l.symbol IS NULL THEN 'NO_SERIES'
  WHEN day >= last_day THEN 'NO_LATER_BAR' WHEN day < first_day THEN 'BEFORE_SERIES' END AS reason FROM e LEFT JOIN l ON l.symbol = e.ticker)
SELECT reason, ticker, count(*) AS events, dense_rank() OVER (ORDER BY count(*) DESC, ticker NULLS LAST, reason) AS place FROM m WHERE reason IS NOT NULL GROUP BY reason, ticker""")
def unresolved_misses(spark: SparkSession, d: str) -> DataFrame:
    """Why events find no later bar, the commonest tickers first. The order is over one row per ticker and reason."""
    ends = bars(spark, d).groupBy("symbol").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    e = signals(spark, d).select("ticker", F.to_date("known_at").alias("day")).filter("day is not null").groupBy("ticker", "day").agg(F.count("*").alias("n"))
    reason = F.when(F.col("ticker").isNull(), "NO_TICKER").when(F.col("symbol").isNull(), "NO_SERIES").when(F.col("day") >= F.col("last_day"),
        "NO_LATER_BAR").when(F.col("day") < F.col("first_day"), "BEFORE_SERIES")
    m = e.join(ends, F.col("ticker") == F.col("symbol"), "left").withColumn("reason", reason).filter("reason is not null").groupBy("reason", "ticker").agg(F.sum("n").alias("events"))
    return m.withColumn("place", F.dense_rank().over(Window.orderBy(F.desc("events"), F.asc_nulls_last("ticker"), "reason")).cast("long"))


@query(f"""WITH {BARS_SQL}, r AS (SELECT provider, symbol, adj_close / nullif(lag(adj_close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS step
  FROM bars WHERE adj_close > 0), m AS (SELECT provider, symbol, median(step) AS med FROM r GROUP BY ALL HAVING count(step) > 0)
SELECT provider, arg_max(symbol, (round(med, 12), symbol)) AS best, count(*) AS series FROM m GROUP BY provider""")
def best_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Of each provider the series with the greatest median step."""
    before = F.lag("adj_close").over(Window.partitionBy("symbol").orderBy("date"))
    r = bars(spark, d).filter("adj_close > 0").withColumn("step", F.col("adj_close") / before - 1)
    m = r.groupBy("provider", "symbol").agg(F.percentile("step", 0.5).alias("med")).filter("med is not null")
    return m.groupBy("provider").agg(F.max_by("symbol", F.struct(F.round("med", 12), "symbol")).alias("best"), F.count("*").alias("series"))


@query(f"""WITH {SIGNALS_SQL} SELECT count(*) AS rows, count(*) FILTER (ticker IS NULL) AS no_ticker, count(*) FILTER (score IS NULL) AS no_score,
  count(*) FILTER (transaction_date > CAST(known_at AS DATE)) AS future_dated,
  count(*) FILTER (ticker IS NULL AND score IS NULL) AS neither, round(count(ticker) / count(*), 9) AS covered, count(DISTINCT cik) AS issuers,
  count(DISTINCT CASE WHEN ticker IS NULL THEN cik END) AS issuers_touched FROM sig""")
def disclosure_counts(spark: SparkSession, d: str) -> DataFrame:
    """How much of the data lacks what, in one aggregate."""
    s = signals(spark, d)
    none = lambda c: F.col(c).isNull()
    return s.agg(
        F.count("*").alias("rows"), F.count_if(none("ticker")).alias("no_ticker"), F.count_if(none("score")).alias("no_score"),
            F.count_if(F.col("transaction_date") > F.to_date("known_at")).alias("future_dated"),
        F.count_if(none("ticker") & none("score")).alias("neither"), F.round(F.count("ticker") / F.count("*"), 9).alias("covered"),
            F.count_distinct("cik").alias("issuers"), F.count_distinct(F.when(none("ticker"), F.col("cik"))).alias("issuers_touched"),
    )


@query(_FILINGS_SQL + r""", c AS (SELECT key AS accession, upper(trim(form_type)) AS form, CAST(f.accepted_at AS DATE) AS filed FROM f
  JOIN sec_raw_records USING (delivery_id) WHERE key <> '' AND f.accepted_at IS NOT NULL)
SELECT DISTINCT accession, filed, CAST(year(filed) AS BIGINT) AS year, CAST(quarter(filed) AS BIGINT) AS quarter FROM c WHERE form NOT LIKE '%/A' AND year(filed) BETWEEN 2020 AND 2022""")
def hydration_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Filings of some years to be fetched in full, amendments left out."""
    c = table(spark, d, "sec_raw_records").select(_accession().alias("accession"), F.upper(F.trim("form_type")).alias("form"),
        F.to_date("accepted_at").alias("filed")).filter("accession is not null and filed is not null")
    year, quarter = F.year("filed").cast("long"), F.quarter("filed").cast("long")
    return c.filter(~F.col("form").endswith("/A") & year.between(2020, 2022)).select("accession", "filed", year.alias("year"), quarter.alias("quarter")).distinct()


@query("""SELECT CASE WHEN split_factor <> 1 THEN 'splits' ELSE 'others' END AS bucket, upper(trim(symbol)) AS symbol, coalesce(date,
  CAST(available_at AS DATE)) AS action_date, round(CAST(split_factor AS DOUBLE), 6) AS rate FROM daily_bars WHERE split_factor IS NOT NULL""")
def actions_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Actions in a map of buckets to arrays as flat rows, each with the best of its dates."""
    b = table(spark, d, "daily_bars").filter("split_factor is not null")
    action = F.struct("symbol", F.lit(None).cast("date").alias("process_date"), F.col("date").alias("ex_date"),
        F.to_date("available_at").alias("payable_date"), F.col("split_factor").cast("double").alias("rate"))
    pages = b.select(F.create_map(F.when(F.col("split_factor") != 1, "splits").otherwise("others"), F.array(action)).alias("corporate_actions"))
    flat = pages.select(F.explode("corporate_actions").alias("bucket", "actions")).select("bucket", F.explode("actions").alias("a"))
    return flat.select("bucket", N.symbol(F.col("a.symbol")).alias("symbol"),
        F.coalesce("a.process_date", "a.ex_date", "a.payable_date").alias("action_date"), F.round("a.rate", 6).alias("rate"))


@query(f"""WITH {SIGNALS_SQL}, {BARS_SQL}, c AS (SELECT ticker, max(score) AS total FROM sig WHERE ticker IS NOT NULL GROUP BY ticker),
  p AS (SELECT symbol, arg_max(close, date) AS last_close, arg_min(close, date) AS first_close FROM bars GROUP BY symbol),
u AS (SELECT ticker, total, 'CANDIDATE' AS origin FROM c UNION ALL SELECT symbol, NULL, 'UNSEEN' FROM p WHERE symbol NOT IN (SELECT ticker FROM c))
SELECT ticker, total, origin, round(100 * (last_close / nullif(first_close, 0) - 1), 6) + 0.0 AS return_pct,
  row_number() OVER (ORDER BY total DESC NULLS LAST, ticker) AS place FROM u LEFT JOIN p ON p.symbol = u.ticker""")
def company_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and the tickers that are none, with their return, in the order of the export. The window holds a row a ticker."""
    c = signals(spark, d).filter("ticker is not null").groupBy("ticker").agg(F.max("score").alias("total")).withColumn("origin", F.lit("CANDIDATE"))
    p = bars(spark, d).groupBy("symbol").agg(F.max_by("close", "date").alias("last_close"), F.min_by("close", "date").alias("first_close"))
    unseen = p.join(c, F.col("symbol") == F.col("ticker"), "left_anti").select(F.col("symbol").alias("ticker"), F.lit(None).cast("double").alias("total"), F.lit("UNSEEN").alias("origin"))
    j = c.unionByName(unseen).join(p, F.col("symbol") == F.col("ticker"), "left")
    pct = F.round(F.lit(100) * (F.col("last_close") / F.nullif("first_close", F.lit(0.0)) - 1), 6) + 0.0
    return j.select("ticker", "total", "origin", pct.alias("return_pct"), F.row_number().over(Window.orderBy(F.desc_nulls_last("total"), "ticker")).cast("long").alias("place"))
