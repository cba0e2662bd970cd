"""Queries over transactions: predicates, windows over calendar days, activity aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as Wf
from ..operators import overlap, quantiles, rolling
from ..sources.tables import table
from .adapters import JOINT_SQL, TX_SQL, joint_transactions, transactions
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
#: End of the observation period.
AS_OF = "2000-06-30"
_X = f"WITH {TX_SQL}"
_JOINT = f"WITH {JOINT_SQL}"


def _day(c: str) -> Column:
    return F.unix_date(c)


@query(_X + f" SELECT issuer, owner, accession, line, tx_date, value FROM tx WHERE known_date <= DATE '{AS_OF}' AND code = 'P' AND status = 'ACTIVE'")
def effective_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Purchases known and in force on a day. Code and status reach the scan; the day a row became known comes from both
    sides of the adapter's join and can't."""
    return transactions(spark, d).filter((F.col("known_date") <= F.lit(AS_OF).cast("date")) & (F.col("code") == "P") & (F.col("status") == "ACTIVE")).select("issuer",
        "owner", "accession", "line", "tx_date", "value")


@query(_X + """, k AS (SELECT *, max(known_date) OVER (PARTITION BY issuer) AS newest FROM tx) SELECT issuer, count(*) AS rows_known,
  bool_or(newest > DATE '2001-06-30') AS has_future FROM k WHERE known_date <= DATE '2001-06-30' GROUP BY issuer""")
def future_row_policy(spark: SparkSession, d: str) -> DataFrame:
    """Rows known by a day, and whether the issuer has later ones that a strict policy would refuse."""
    t = transactions(spark, d)
    cut = F.lit("2001-06-30").cast("date")
    g = t.groupBy("issuer").agg(F.count_if(F.col("known_date") <= cut).alias("rows_known"), (F.max("known_date") > cut).alias("has_future"))
    return g.filter("rows_known > 0")


@query(_X + " SELECT issuer, owner, count(*) AS n, round(sum(coalesce(value, shares * price)), 4) AS dollars FROM tx WHERE code IN ('P', 'S') AND price > 0 GROUP BY issuer, owner")
def value_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Stated value, else shares times price."""
    t = transactions(spark, d).filter("code in ('P', 'S') and price > 0")
    return t.groupBy("issuer", "owner").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.col("shares") * F.col("price"))), 4).alias("dollars"))


@query(_X + """, o AS (SELECT DISTINCT issuer, owner, tx_date FROM tx WHERE code = 'P') SELECT a.issuer, a.tx_date,
  CAST(count(DISTINCT b.owner) AS BIGINT) AS owners_30d FROM (SELECT DISTINCT issuer, tx_date FROM o) a JOIN o b ON a.issuer = b.issuer
  AND b.tx_date BETWEEN a.tx_date - 30 AND a.tx_date GROUP BY ALL""")
def cluster_30d(spark: SparkSession, d: str) -> DataFrame:
    """Distinct owners buying within 30 days up to each day: each owner counts over the union of the spans its days open, so
    it is a running sum of entries and exits, whatever the number of owners."""
    return overlap.distinct_in_span(transactions(spark, d).filter("code = 'P'"), "issuer", "owner", "tx_date", 30).withColumnRenamed("members", "owners_30d")


@query(_X + """, p AS (SELECT issuer, owner, tx_date, count(*) AS n, sum(value) AS v FROM tx WHERE code = 'P' GROUP BY ALL) SELECT issuer, owner,
  tx_date, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS earlier, round(max(v) OVER w, 4) AS largest_before, CAST(date_diff('day', max(tx_date) OVER w,
  tx_date) AS BIGINT) AS days_since FROM p WINDOW w AS (PARTITION BY issuer, owner ORDER BY tx_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_history(spark: SparkSession, d: str) -> DataFrame:
    """What an owner did in an issuer on strictly earlier days."""
    p = transactions(spark, d).filter("code = 'P'").groupBy("issuer", "owner", "tx_date").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    w = Window.partitionBy("issuer", "owner").orderBy(_day("tx_date")).rangeBetween(Window.unboundedPreceding, -1)
    return p.select("issuer", "owner", "tx_date", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("earlier"),
        F.round(F.max("v").over(w), 4).alias("largest_before"), F.datediff("tx_date", F.max("tx_date").over(w)).cast("long").alias("days_since"))


_CADENCE = _X + """, p AS (SELECT DISTINCT issuer, owner, tx_date FROM tx WHERE code = 'P'), g AS (SELECT *, date_diff('day',
  lag(tx_date) OVER (PARTITION BY issuer, owner ORDER BY tx_date), tx_date) AS gap FROM p)
SELECT issuer, owner, CAST(count(gap) AS BIGINT) AS gaps, median(gap) AS median_gap, round(stddev_pop(gap) / avg(gap), 8) AS variation FROM g GROUP BY issuer, owner HAVING count(gap) >= 3"""


@query(_CADENCE)
def purchase_cadence(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between an owner's purchase days: median and coefficient of variation."""
    p = transactions(spark, d).filter("code = 'P'").select("issuer", "owner", "tx_date").distinct()
    g = p.withColumn("gap", F.datediff("tx_date", F.lag("tx_date").over(Window.partitionBy("issuer", "owner").orderBy("tx_date"))))
    return g.groupBy("issuer", "owner").agg(F.count("gap").alias("gaps"), F.percentile("gap", 0.5).alias("median_gap"),
        F.round(F.stddev_pop("gap") / F.avg("gap"), 8).alias("variation")).filter("gaps >= 3")


@query(_X + f""", e AS (SELECT * FROM tx WHERE known_date <= DATE '{AS_OF}' AND tx_date <= DATE '{AS_OF}' AND code = 'P') SELECT issuer, """ + ", ".join(f"round(sum(shares * price) FILTER (tx_date >= DATE '{AS_OF}' - {n}) / nullif(sum(shares) FILTER (tx_date >= DATE '{AS_OF}' - {n}), 0), 6) AS basis_{n}" for n in (30,
    90, 180, 365)) + " FROM e GROUP BY issuer")
def cost_basis_windows(spark: SparkSession, d: str) -> DataFrame:
    """Share-weighted price paid within trailing calendar windows, all in one aggregate."""
    end = F.lit(AS_OF).cast("date")
    e = transactions(spark, d).filter((F.col("known_date") <= end) & (F.col("tx_date") <= end) & (F.col("code") == "P"))
    within = lambda n, c: F.sum(F.when(F.col("tx_date") >= F.date_sub(end, n), c))
    return e.groupBy("issuer").agg(*[F.round(within(n, F.col("shares") * F.col("price")) / F.nullif(within(n, F.col("shares")), F.lit(0.0)),
        6).alias(f"basis_{n}") for n in (30, 90, 180, 365)])


@query(_X + f""", q AS (SELECT issuer, arg_max(price, (tx_date, accession, line, part, price)) AS last_price FROM tx GROUP BY issuer),
  o AS (SELECT issuer, owner, sum(shares) AS shares, sum(shares * price) AS paid FROM tx WHERE code = 'P' AND tx_date <= DATE '{AS_OF}' GROUP BY ALL)
  SELECT issuer, owner, round(shares * last_price - paid, 5) AS unrealised FROM o JOIN q USING (issuer)""")
def owner_pnl(spark: SparkSession, d: str) -> DataFrame:
    """Unrealised result of each owner at the issuer's last price."""
    t = transactions(spark, d)
    q = t.groupBy("issuer").agg(F.max_by("price", F.struct("tx_date", "accession", "line", "part", "price")).alias("last_price"))
    o = t.filter((F.col("code") == "P") & (F.col("tx_date") <= F.lit(AS_OF).cast("date"))).groupBy("issuer",
        "owner").agg(F.sum("shares").alias("shares"), F.sum(F.col("shares") * F.col("price")).alias("paid"))
    return o.join(q, "issuer").select("issuer", "owner", F.round(F.col("shares") * F.col("last_price") - F.col("paid"), 5).alias("unrealised"))


_PULSE_COLS = """count(*) FILTER (code = 'P') AS purchases, count(*) FILTER (code = 'S') AS sales, count(DISTINCT CASE WHEN code = 'P' THEN owner
  END) AS buyers, count(DISTINCT CASE WHEN code = 'S' THEN owner END) AS sellers,
 count(DISTINCT CASE WHEN code = 'P' THEN issuer END) AS issuers_bought, CASE
  WHEN count(*) FILTER (code = 'S') > 0 THEN round(count(*) FILTER (code = 'P') / count(*) FILTER (code = 'S'), 8) END AS count_ratio,
 CASE WHEN sum(CASE WHEN code = 'S' THEN shares END) > 0 THEN round(sum(CASE WHEN code = 'P' THEN shares END) / sum(CASE WHEN code = 'S' THEN shares END), 8) END AS share_ratio"""


def _pulse(g) -> DataFrame:  # noqa: ANN001
    buys, sells = F.count_if(F.col("code") == "P"), F.count_if(F.col("code") == "S")
    of = lambda code, c: F.when(F.col("code") == code, F.col(c))
    sold = F.sum(of("S", "shares"))
    return g.agg(buys.alias("purchases"), sells.alias("sales"), F.count_distinct(of("P", "owner")).alias("buyers"),
        F.count_distinct(of("S", "owner")).alias("sellers"), F.count_distinct(of("P", "issuer")).alias("issuers_bought"),
        F.when(sells > 0, F.round(buys / sells, 8)).alias("count_ratio"), F.when(sold > 0, F.round(F.sum(of("P", "shares")) / sold, 8)).alias("share_ratio"))


@query(_X + f" SELECT CAST(date_trunc('month', tx_date) AS DATE) AS month, {_PULSE_COLS} FROM tx GROUP BY ALL")
def pulse_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Counts, distinct parties and purchase-to-sale ratios per month; null where nothing was sold."""
    return _pulse(transactions(spark, d).groupBy(F.to_date(F.date_trunc("month", "tx_date")).alias("month")))


@query(_X + """ SELECT month, week, role, GROUPING_ID(month, week, role) AS level, count(*) AS n, CAST(sum(shares) AS DOUBLE) AS shares FROM (SELECT *,
  CAST(date_trunc('month', tx_date) AS DATE) AS month, CAST(date_trunc('week', tx_date) AS DATE) AS week FROM tx) GROUP BY GROUPING SETS ((month),
  (month, role), (week), (week, role))""")
def pulse_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Two grains, over the market and by group, in one pass: grouping sets."""
    t = transactions(spark, d).select("shares", "role", F.to_date(F.date_trunc("month", "tx_date")).alias("month"), F.to_date(F.date_trunc("week", "tx_date")).alias("week"))
    sets = [[F.col("month")], [F.col("month"), F.col("role")], [F.col("week")], [F.col("week"), F.col("role")]]
    return t.groupingSets(sets, "month", "week", "role").agg(F.grouping_id("month", "week", "role").cast("long").alias("level"), F.count("*").alias("n"), F.sum("shares").alias("shares"))


@query(_X + """, m AS (SELECT CAST(date_trunc('month', tx_date) AS DATE) AS month, count(*) FILTER (code = 'P') AS n FROM tx GROUP BY ALL),
h AS (SELECT a.month, a.n, count(b.n) AS k, count(*) FILTER (b.n < a.n) AS less, count(*) FILTER (b.n = a.n) AS eq FROM m a LEFT JOIN m b ON b.month < a.month GROUP BY ALL)
SELECT month, n, CASE WHEN k >= 24 THEN round(least(100.0, 100.0 * (less + (eq + 1) / 2.0) / k), 8) END AS percentile FROM h""")
def pulse_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Each month's purchases among all earlier months'. Months are few; the window runs over one row per month."""
    m = transactions(spark, d).groupBy(F.to_date(F.date_trunc("month", "tx_date")).alias("month")).agg(F.count_if(F.col("code") == "P").alias("n"))
    h = F.collect_list("n").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("h", h)
    less, eq = F.size(F.filter("h", lambda x: x < F.col("n"))), F.size(F.filter("h", lambda x: x == F.col("n")))
    p = F.round(F.least(F.lit(100.0), F.lit(100.0) * (less + (eq + 1) / F.lit(2.0)) / F.size("h")), 8)
    return m.select("month", "n", F.when(F.size("h") >= 24, p).alias("percentile"))


@query(_X + """, c AS (SELECT issuer, quantile_cont(value, 0.995) AS q, count(*) AS n FROM tx WHERE code = 'P' GROUP BY issuer) SELECT issuer, CASE
  WHEN n >= 200 THEN round(q, 6) END AS cap FROM c""")
def winsor_cap(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated 99.5 % quantile of values, from 200 observations on."""
    t = transactions(spark, d).filter("code = 'P'")
    g = t.groupBy("issuer").agg(F.count("*").alias("n")).join(quantiles.quantiles(t, ["issuer"], "value", {"q": 0.995}), "issuer", "left")
    return g.select("issuer", F.when(F.col("n") >= 200, F.round("q", 6)).alias("cap"))


@query(_X + f""", b AS (SELECT *, CAST(floor(date_diff('day', tx_date, DATE '{AS_OF}') / 30) AS BIGINT) AS block FROM tx WHERE tx_date <= DATE '{AS_OF}'
  AND tx_date > DATE '{AS_OF}' - 3600) SELECT issuer, block, count(*) FILTER (code = 'P') AS purchases, round(coalesce(sum(CASE
  WHEN code = 'P' THEN value END), 0), 4) AS dollars FROM b GROUP BY ALL""")
def activity_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Activity in 30-day blocks counted back from a day."""
    end = F.lit(AS_OF).cast("date")
    t = transactions(spark, d).filter((F.col("tx_date") <= end) & (F.col("tx_date") > F.date_sub(end, 3600))).withColumn("block", F.floor(F.datediff(end, "tx_date") / 30))
    return t.groupBy("issuer", "block").agg(F.count_if(F.col("code") == "P").alias("purchases"),
        F.round(F.coalesce(F.sum(F.when(F.col("code") == "P", F.col("value"))), F.lit(0.0)), 4).alias("dollars"))


_SIDES = {"P": "buy", "S": "sale"}


@query(_X + """, t AS (SELECT issuer, code, value, tx_date, greatest(tx_date, known_date) AS enters FROM tx WHERE code IN ('P', 'S')),
  e AS (SELECT min(tx_date) AS a, max(enters) AS b FROM t),
c AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e),
w AS (SELECT day, count(*) FILTER (code = 'P') AS purchases_30d, count(*) FILTER (code = 'S') AS sales_30d, sum(CAST(value AS DECIMAL(28,
  6))) FILTER (code = 'P' AND value >= 0 AND isfinite(value)) AS bd, sum(CAST(value AS DECIMAL(28, 6))) FILTER (code = 'S' AND value >= 0
  AND isfinite(value)) AS sd,
  bool_or(NOT coalesce(value >= 0 AND isfinite(value), false)) FILTER (code = 'P') AS bm, bool_or(NOT coalesce(value >= 0 AND isfinite(value),
  false)) FILTER (code = 'S') AS sm, count(DISTINCT issuer) FILTER (code = 'P') AS buying_companies,
  count(DISTINCT issuer) FILTER (code = 'S') AS selling_companies, count(DISTINCT issuer) AS active_companies
  FROM c LEFT JOIN t ON t.enters <= day AND t.tx_date BETWEEN day - 29 AND day GROUP BY day),
d AS (SELECT *, CASE WHEN NOT coalesce(bm, false) THEN CAST(coalesce(bd, 0) AS DOUBLE) END AS buy_dollars, CASE WHEN NOT coalesce(sm,
  false) THEN CAST(coalesce(sd, 0) AS DOUBLE) END AS sale_dollars FROM w)
SELECT day, purchases_30d, sales_30d, purchases_30d / nullif(sales_30d, 0) AS ratio, buy_dollars, sale_dollars, buy_dollars / nullif(sale_dollars,
  0) AS dollar_ratio, buying_companies, selling_companies, active_companies FROM d""")
def barometer_known_30d(spark: SparkSession, d: str) -> DataFrame:
    """Market-wide counts, dollars, companies and ratios of the 30 trading days up to each day, as known by its end."""
    return rolling.barometer(transactions(spark, d), 30, _SIDES)


_MONTHS = _X + ", m AS (SELECT CAST(date_trunc('month', tx_date) AS DATE) AS month, count(*) FILTER (code = 'P') AS p, count(*) FILTER (code = 'S') AS s FROM tx GROUP BY ALL)"


@query(_MONTHS + """ SELECT month, p AS purchases, s AS sales, CASE
  WHEN count(*) OVER (ORDER BY month ROWS 2 PRECEDING) >= 3 THEN round(avg(p) OVER (ORDER BY month ROWS 2 PRECEDING), 8) END AS mean_3m FROM m""")
def monthly_barometer(spark: SparkSession, d: str) -> DataFrame:
    m = transactions(spark, d).groupBy(F.to_date(F.date_trunc("month",
        "tx_date")).alias("month")).agg(F.count_if(F.col("code") == "P").alias("purchases"), F.count_if(F.col("code") == "S").alias("sales"))
    return m.select("month", "purchases", "sales", F.round(Wf.rolling_mean(F.col("purchases"), Window.orderBy("month"), 3), 8).alias("mean_3m"))


@query(_MONTHS + """, i AS (SELECT month, p, row_number() OVER (ORDER BY month) - (year(month) * 12 + month(month)) AS island FROM m),
h AS (SELECT a.month, count(b.p) AS k, count(*) FILTER (b.p < a.p) AS less, count(*) FILTER (b.p = a.p) AS eq FROM i a LEFT
  JOIN i b ON b.island = a.island AND b.month < a.month GROUP BY ALL)
SELECT month, CASE WHEN k >= 24 THEN round(100.0 * (less + eq / 2.0) / k, 8) END AS percentile FROM h""")
def compass_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Mid-rank of a month among the unbroken run of months before it."""
    m = transactions(spark, d).groupBy(F.to_date(F.date_trunc("month", "tx_date")).alias("month")).agg(F.count_if(F.col("code") == "P").alias("p"))
    m = m.withColumn("island", F.row_number().over(Window.orderBy("month")) - (F.year("month") * 12 + F.month("month")))
    h = F.collect_list("p").over(Window.partitionBy("island").orderBy("month").rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("h", h)
    p = Wf.percentile_midrank(F.col("p"), F.col("h"), 24)
    return m.select("month", F.when(F.size("h") >= 24, F.round(p, 8)).alias("percentile"))


@query(_X + """, y AS (SELECT owner, year(tx_date) AS year, month(tx_date) AS month, min(known_date) AS first_filed,
  count(DISTINCT accession) AS accessions, count(*) AS n, count(*) FILTER (code = 'P') AS purchases, count(*) FILTER (code = 'S') AS sales FROM tx
  GROUP BY ALL) SELECT * FROM y""")
def owner_month_history(spark: SparkSession, d: str) -> DataFrame:
    t = transactions(spark, d).groupBy("owner", F.year("tx_date").cast("long").alias("year"), F.month("tx_date").cast("long").alias("month"))
    return t.agg(F.min("known_date").alias("first_filed"), F.count_distinct("accession").alias("accessions"), F.count("*").alias("n"),
        F.count_if(F.col("code") == "P").alias("purchases"), F.count_if(F.col("code") == "S").alias("sales"))


_ROUTINE = _X + """, m AS (SELECT issuer, owner, year(tx_date) AS y, month(tx_date) AS m, min(known_date) AS filed FROM tx WHERE code IN ('P', 'S') GROUP BY ALL),
g AS (SELECT DISTINCT issuer, owner, y FROM m), k AS (SELECT g.issuer, g.owner, g.y, m.m, count(DISTINCT m.y) AS n FROM g
  JOIN m ON m.issuer = g.issuer AND m.owner = g.owner AND m.y BETWEEN g.y - 3 AND g.y - 1 AND m.filed < make_date(g.y, 1, 1) GROUP BY ALL),
r AS (SELECT g.issuer, g.owner, g.y, coalesce(bool_or(k.n = 3), false) AS now FROM g LEFT JOIN k ON k.issuer = g.issuer AND k.owner = g.owner AND k.y = g.y GROUP BY ALL)
SELECT issuer, owner, CAST(y AS BIGINT) AS year, bool_or(now) OVER (PARTITION BY issuer, owner ORDER BY y) AS routine FROM r"""


@query(_ROUTINE)
def annual_routine_labels(spark: SparkSession, d: str) -> DataFrame:
    """Whether an owner traded in one calendar month in each of the three years before, as filed by then; once routine,
    always routine. Months of a year are one row's set, the absorbing state a running maximum: no fold is needed."""
    m = transactions(spark, d).filter("code in ('P', 'S')").groupBy("issuer", "owner", F.year("tx_date").alias("y"), F.month("tx_date").alias("m")).agg(F.min("known_date").alias("filed"))
    years = m.groupBy("issuer", "owner", "y").agg(F.collect_list(F.struct("m", "filed")).alias("months"))
    w = Window.partitionBy("issuer", "owner").orderBy("y")
    back = years.withColumn("prior", F.collect_list(F.struct("y", "months")).over(w.rangeBetween(-3, -1)))
    known = F.transform("prior", lambda p: F.array_distinct(F.transform(F.filter(p["months"], lambda x: x["filed"] < F.make_date(F.col("y"), F.lit(1), F.lit(1))), lambda x: x["m"])))
    k = back.withColumn("known", known)
    common = F.when(F.size("known") == 3, F.size(F.array_intersect(F.array_intersect(F.element_at("known", 1), F.element_at("known", 2)),
        F.element_at("known", 3))) > 0).otherwise(F.lit(False))
    return k.withColumn("now", common).select("issuer", "owner", F.col("y").cast("long").alias("year"), F.bool_or("now").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("routine"))


@query(_X + """, l AS (SELECT *, row_number() OVER (PARTITION BY accession, line ORDER BY known_date DESC, tx_date DESC, part DESC, issuer DESC,
  value DESC, shares DESC) AS rn FROM tx) SELECT accession, line, known_date, part FROM l WHERE rn = 1""")
def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    """The last known row of each transaction id, by an aggregate."""
    best = F.max(F.struct("known_date", "tx_date", "part", "issuer", "value", "shares"))
    return transactions(spark, d).groupBy("accession", "line").agg(best.alias("r")).select("accession", "line", "r.known_date", "r.part")


@query(_X + """, r AS (SELECT DISTINCT accession, line, issuer, known_date FROM tx), v AS (SELECT *, lead(known_date) OVER (PARTITION BY accession, line
  ORDER BY known_date, issuer) AS valid_to, row_number() OVER (PARTITION BY accession, line ORDER BY known_date, issuer) AS revision FROM r)
SELECT accession, line, issuer, known_date AS valid_from, valid_to, CAST(revision AS BIGINT) AS revision, CASE WHEN valid_to IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS state FROM v""")
def amendment_effective(spark: SparkSession, d: str) -> DataFrame:
    """Revisions of one row identity: each holds until the next becomes known."""
    r = transactions(spark, d).select("accession", "line", "issuer", "known_date").distinct()
    w = Window.partitionBy("accession", "line").orderBy("known_date", "issuer")
    v = r.select("accession", "line", "issuer", F.col("known_date").alias("valid_from"), F.lead("known_date").over(w).alias("valid_to"),
        F.row_number().over(w).cast("long").alias("revision"))
    return v.withColumn("state", F.when(F.col("valid_to").isNull(), "ACTIVE").otherwise("SUPERSEDED"))


@query(_JOINT + """, e AS (SELECT accession, line, array_sort(list_distinct(list(owner))) AS owners, count(DISTINCT issuer) AS facts,
  max(known_date) AS known_date FROM tx GROUP BY ALL) SELECT accession, line, CAST(len(owners) AS BIGINT) AS owners, facts > 1 AS conflicting,
  known_date FROM e""")
def economic_events(spark: SparkSession, d: str) -> DataFrame:
    """Joint owners' rows collapse to one event; differing facts are a conflict."""
    g = joint_transactions(spark, d).groupBy("accession", "line").agg(F.size(F.collect_set("owner")).cast("long").alias("owners"),
        (F.count_distinct("issuer") > 1).alias("conflicting"), F.max("known_date").alias("known_date"))
    return g


@query(_X + """, b AS (SELECT issuer, owner, accession, line, value, row_number() OVER (PARTITION BY issuer ORDER BY value DESC, accession, line, owner,
  part, tx_date) AS rn FROM tx WHERE code = 'P') SELECT issuer, owner, accession, line, value FROM b WHERE rn = 1 AND value >= 10000
  ORDER BY value DESC, issuer LIMIT 20""")
def largest_purchase_digest(spark: SparkSession, d: str) -> DataFrame:
    """Largest purchase of each issuer, the top twenty: a top-k report."""
    best = F.max(F.struct("value", *[(-F.col(c)).alias(c) for c in ("accession", "line", "owner", "part")]))
    g = transactions(spark, d).filter("code = 'P'").groupBy("issuer").agg(best.alias("r")).select("issuer", (-F.col("r.owner")).alias("owner"),
        (-F.col("r.accession")).alias("accession"), (-F.col("r.line")).alias("line"), "r.value")
    return g.filter("value >= 10000").orderBy(F.desc("value"), "issuer").limit(20)


@query(_X + " SELECT issuer, round(sum(value), 2) AS dollars FROM tx WHERE code = 'P' GROUP BY issuer ORDER BY sum(value) DESC, issuer LIMIT 10")
def top_issuers(spark: SparkSession, d: str) -> DataFrame:
    g = transactions(spark, d).filter("code = 'P'").groupBy("issuer").agg(F.sum("value").alias("v"))
    return g.orderBy(F.desc("v"), "issuer").limit(10).select("issuer", F.round("v", 2).alias("dollars"))


@query(_X + """, f AS (SELECT accession, owner, code, round(sum(value), 4) AS value, min(known_date) AS filed FROM tx GROUP BY ALL) SELECT accession,
  count(*) AS parts, count(*) FILTER (code = 'P') AS buys, count(*) FILTER (code = 'S') AS sales, round(sum(value), 3) AS value FROM f
  GROUP BY accession""")
def accession_counts(spark: SparkSession, d: str) -> DataFrame:
    f = transactions(spark, d).groupBy("accession", "owner", "code").agg(F.round(F.sum("value"), 4).alias("value"))
    return f.groupBy("accession").agg(F.count("*").alias("parts"), F.count_if(F.col("code") == "P").alias("buys"),
        F.count_if(F.col("code") == "S").alias("sales"), F.round(F.sum("value"), 3).alias("value"))


@query(_JOINT + """, d AS (SELECT DISTINCT issuer, owner, accession FROM tx WHERE code = 'P'), s AS (SELECT issuer, accession, list(owner) AS o FROM d
  GROUP BY ALL) SELECT a.issuer, a.accession, count(b.accession) AS independent FROM s a LEFT JOIN s b ON a.issuer = b.issuer
  AND a.accession <> b.accession AND NOT list_has_any(a.o, b.o) GROUP BY ALL""")
def independent_filings(spark: SparkSession, d: str) -> DataFrame:
    """Of each filing, how many others of its issuer share no owner with it."""
    return overlap.disjoint_filings(joint_transactions(spark, d).filter("code = 'P'"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A field out of JSON text, with the schema stated."""
    e = table(spark, d, "events")
    return e.withColumn("p", F.from_json("props", "k long")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@query(_X + ", m AS (SELECT issuer, code, sum(value) AS v FROM tx GROUP BY ALL) SELECT issuer, (list(code ORDER BY v DESC, code))[1:2] AS top FROM m GROUP BY issuer")
def top_contributions(spark: SparkSession, d: str) -> DataFrame:
    """The two codes that weigh most in each issuer, in order, as an array."""
    m = transactions(spark, d).groupBy("issuer", "code").agg(F.sum("value").alias("v"))
    arr = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), "code")))
    return m.groupBy("issuer").agg(F.transform(F.slice(arr, 1, 2), lambda x: x["code"]).alias("top"))


@query(_X + """, s AS (SELECT issuer, CASE WHEN issuer % 7 = 0 THEN NULL WHEN issuer % 7 = 1 THEN 'part ' || issuer
  ELSE CAST(issuer * 37 % 4000 AS VARCHAR) END AS sic FROM tx GROUP BY issuer), n AS (SELECT issuer, try_cast(sic AS INT) AS code FROM s), r(lo, hi,
  sector, k) AS (VALUES (0, 999, 'A', 1), (500, 1499, 'B', 2), (1500, 2999, 'C', 3), (3000, 3599, 'D', 4)) SELECT issuer,
  coalesce((SELECT arg_min(sector, k) FROM r WHERE code BETWEEN lo AND hi), CASE WHEN code IS NULL THEN 'INVALID' ELSE 'UNMAPPED' END) AS sector FROM n""")
def range_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A number into the first of several overlapping ranges: a generated CASE, which needs no join at all."""
    rules = [(0, 999, "A"), (500, 1499, "B"), (1500, 2999, "C"), (3000, 3599, "D")]
    i = transactions(spark, d).select("issuer").distinct()
    sic = F.when(F.col("issuer") % 7 == 0, None).when(F.col("issuer") % 7 == 1,
        F.concat(F.lit("part "), F.col("issuer").cast("string"))).otherwise((F.col("issuer") * 37 % 4000).cast("string"))
    code = sic.try_cast("int")
    case = F.when(code.isNull(), "INVALID")
    for lo, hi, sector in rules:
        case = case.when(code.between(lo, hi), sector)
    return i.select("issuer", case.otherwise("UNMAPPED").alias("sector"))
