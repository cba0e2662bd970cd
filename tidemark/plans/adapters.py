"""Canonical inputs out of the test tables, each in Spark and as an SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normal as N
from ..sources.tables import table

_BAR = ["open", "high", "low", "close", "adj_close", "volume"]


def bars(spark: SparkSession, d: str) -> DataFrame:
    """One bar per symbol and date, all of a symbol from one provider: the one with most days, then the first by name.

    Providers differ in rounding, unit and adjustment, so a series stitched from several would jump at the seams."""
    b = table(spark, d, "daily_bars").select(
        N.symbol(F.col("symbol")).alias("symbol"), "date", F.coalesce("provider", F.lit("")).alias("provider"), "provider_record_id",
        *[F.col(c).cast("double").alias(c) for c in _BAR], "is_adjusted", F.col("split_factor").cast("double").alias("split_factor"),
    ).filter("symbol is not null and date is not null")
    one = b.groupBy("symbol", "provider", "date").agg(F.min(F.struct("provider_record_id", *_BAR, "is_adjusted", "split_factor")).alias("r"))
    days = F.count("*").over(Window.partitionBy("symbol", "provider"))
    # both windows lie in the symbol's partition, in which later windows by symbol find it
    fullest = F.min(F.struct((-F.col("days")).alias("fewer"), "provider")).over(Window.partitionBy("symbol"))
    chosen = one.repartition("symbol").withColumn("days", days).withColumn("best", fullest).filter("provider = best.provider")
    return chosen.select("symbol", "date", "r.open", "r.high", "r.low", "r.close", F.coalesce("r.adj_close", "r.close").alias("adj_close"),
        "r.volume", "r.is_adjusted", "r.split_factor", "provider")


BARS_SQL = """typed_bars AS (SELECT upper(trim(symbol)) AS symbol, date, coalesce(provider, '') AS provider, provider_record_id,
  CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close,
  CAST(adj_close AS DOUBLE) AS adj_close, CAST(volume AS DOUBLE) AS volume, is_adjusted, CAST(split_factor AS DOUBLE) AS split_factor
  FROM daily_bars WHERE symbol IS NOT NULL AND date IS NOT NULL),
one_bar AS (SELECT * FROM typed_bars QUALIFY row_number() OVER (PARTITION BY symbol, provider, date ORDER BY provider_record_id NULLS FIRST,
  open NULLS FIRST, high NULLS FIRST, low NULLS FIRST, close NULLS FIRST, adj_close NULLS FIRST, volume NULLS FIRST) = 1),
fullest AS (SELECT symbol, provider FROM one_bar GROUP BY symbol, provider QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, provider) = 1),
bars AS (SELECT symbol, date, open, high, low, close, coalesce(adj_close, close) AS adj_close, volume, is_adjusted, split_factor, provider
  FROM one_bar JOIN fullest USING (symbol, provider))"""


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as transactions: a supplier is the issuer, customers in 25 groups are its owners."""
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("l_suppkey").alias("issuer"), (F.col("o_custkey") % 25).alias("owner"), F.to_date("l_shipdate").alias("tx_date"),
            F.to_date(F.greatest("l_shipdate", "o_orderdate")).alias("known_date"),
        F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("G").alias("code"),
            F.col("l_quantity").alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("SUPERSEDED").alias("status"), F.col("o_orderpriority").alias("role"),
            F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
    )


TX_SQL = """tx AS (SELECT l_suppkey AS issuer, o_custkey % 25 AS owner, CAST(l_shipdate AS DATE) AS tx_date, CAST(greatest(l_shipdate,
  o_orderdate) AS DATE) AS known_date, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'G' END AS code,
  l_quantity AS shares, l_extendedprice / l_quantity AS price, l_extendedprice AS value, CASE WHEN l_linestatus = 'O' THEN 'ACTIVE' ELSE 'SUPERSEDED'
  END AS status, o_orderpriority AS role, l_orderkey AS accession, l_linenumber AS line, l_partkey AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def joint_transactions(spark: SparkSession, d: str) -> DataFrame:
    """The transactions, a third of the filings filed by two owners or three jointly: a row per line and owner."""
    more = F.when(F.col("accession") % 3 == 1, (F.col("owner") * 7 + 3) % 25), F.when(F.col("accession") % 9 == 4, (F.col("owner") + 11) % 25)
    return transactions(spark, d).withColumn("owner", F.explode(F.array_distinct(F.array_compact(F.array("owner", *more)))))


JOINT_SQL = TX_SQL.replace("tx AS (", "single AS (", 1) + """, tx AS (SELECT s.* EXCLUDE (owner), unnest(list_distinct(list_filter([s.owner, CASE
  WHEN accession % 3 = 1 THEN (s.owner * 7 + 3) % 25 END,
  CASE WHEN accession % 9 = 4 THEN (s.owner + 11) % 25 END], lambda o: o IS NOT NULL))) AS owner FROM single s)"""


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals, copies once, with normal keys and the time from which each can be acted on."""
    s = table(spark, d, "insider_signals").distinct()
    return s.select("signal_id", N.cik(F.col("issuer_cik")).alias("cik"), N.ticker(F.col("ticker")).alias("ticker"), "signal_type", "score",
        F.coalesce("knowledge_at", "accepted_at").alias("known_at"), "transaction_date", "sector", F.col("exposure_family").alias("family"), "run_id")


SIGNALS_SQL = r"""sig AS (SELECT DISTINCT signal_id, lpad(issuer_cik, 10, '0') AS cik, regexp_replace(upper(trim(ticker)), '[\s./_-]+([A-Z0-9]{1,2})$',
  '-\1') AS ticker, signal_type, score, coalesce(knowledge_at, accepted_at) AS known_at, transaction_date, sector, exposure_family AS family, run_id
  FROM insider_signals)"""


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "market_sessions")
