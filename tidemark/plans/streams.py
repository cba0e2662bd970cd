"""Queries that run as bounded streams over the event table, and the flattened ownership documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ownership
from ..sources.tables import table
from ..streaming import run, stateful
from ..streaming.late import DifferentialTotals
from .problems import P2_TOTALS_SQL, _filings
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _events(spark: SparkSession, d: str) -> DataFrame:
    """A watermark needs a timestamp with a zone; the table's have none and mean UTC."""
    return run.file_stream(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    s = _events(spark, d).groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return run.to_table(s, "update", ["w", "event_type"]).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT event_id, unnest(generate_series(date_trunc('day', ts) - INTERVAL 2 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS starts
  FROM events) SELECT starts, count(*) AS n FROM e GROUP BY ALL""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    s = _events(spark, d).groupBy(F.window("at", "3 days", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return run.to_table(s, "update", ["w"]).select(F.col("w.start").cast("timestamp_ntz").alias("starts"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts
  FROM events), s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, starts DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS starts, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    s = _events(spark, d).groupBy(F.session_window("at", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return run.to_table(s, "complete").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("starts"), "n")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY ALL")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each event twice on its way, once at the end."""
    e = _events(spark, d)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).dropDuplicatesWithinWatermark(["event_id"])
    return run.to_table(twice.select("user_id", "event_type"), "append").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS "at" FROM events), k AS (SELECT key,
  min("at") AS "at" FROM u GROUP BY key UNION ALL SELECT u.key, min(u."at") FROM k JOIN u ON u.key = k.key AND u."at" >= k."at" + 86400 GROUP BY u.key,
  k."at") SELECT key, CAST(count(*) AS BIGINT) AS kept FROM k GROUP BY key""")
def stream_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """A day between kept events of a user, decided in a stream's state."""
    s = stateful.spaced(run.file_stream(spark, d, "events"), "user_id", "ts", 86400)
    return run.to_table(s, "append").groupBy("key").agg(F.count("*").alias("kept"))


@query(P2_TOTALS_SQL.split("SELECT period, CAST(sum(delta)")[0] + "SELECT period, CAST(sum(delta) AS BIGINT) AS filings FROM d GROUP BY period")
def stream_late_totals(spark: SparkSession, d: str) -> DataFrame:
    """Monthly totals corrected by versioned state over three batches of one span of arrival each."""
    totals = DifferentialTotals(spark, run.shared_folder(spark))
    filings = _filings(spark, d)
    at = F.unix_micros(F.col("arrived_at").cast("timestamp"))
    low, high = filings.agg(F.min(at), F.max(at)).first()  # two values
    third = ((high or 0) - (low or 0)) // 3 + 1
    batch = F.coalesce(F.floor((at - F.lit(low)) / F.lit(third)), F.lit(0))
    for k in range(3):
        totals.apply(filings.filter(batch == k), k)
    return totals.totals().select("period", "filings")


@query()
def ownership_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Every transaction of every filed document with every owner."""
    return ownership.transactions(table(spark, d, "sec_raw_records"), "delivery_id", "payload")


