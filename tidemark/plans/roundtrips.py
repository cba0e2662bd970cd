"""Queries that write whole tables in the file forms of the readers and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal as N
from ..operators import checks
from ..sinks import snapshot
from ..sinks.storage import scratch_folder
from ..sources import files
from ..sources.tables import table
from .adapters import BARS_SQL, bars
from .problems import _FILINGS_SQL
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _folder(spark: SparkSession) -> str:
    return scratch_folder(spark, "files")


@query(f"""WITH {BARS_SQL}, q AS (SELECT close, concat_ws(',', CASE WHEN NOT regexp_full_match(symbol, '[A-Z][A-Z0-9.\\-]*') THEN 'SYMBOL' END,
  CASE WHEN NOT coalesce(least(open, high, low, close) > 0 AND high >= low, false) THEN 'PRICE' END,
  CASE WHEN NOT coalesce(volume >= 0, false) THEN 'VOLUME' END) AS outcome FROM bars)
SELECT outcome, count(*) AS rows, round(coalesce(sum(close), 0), 2) AS closes FROM q GROUP BY outcome""")
def market_file(spark: SparkSession, d: str) -> DataFrame:
    """Bars written as guarded CSV with other column names and read back: rows by why they are set aside ('' if they aren't)."""
    path = f"{_folder(spark)}/market"
    b = bars(spark, d)
    named = {"date": "Date", "symbol": "Symbol", "open": "open", "high": "high", "low": "low", "close": "close", "adj_close": "Adj Close",
        "is_adjusted": "adjusted", "split_factor": "split_factor"}
    snapshot.export_csv(b.select(*[F.col(c).alias(n) for c, n in named.items()], F.col("volume").cast("long").alias("volume")), path)
    good, bad = files.market_csv(spark, path)
    both = good.select("close", F.lit("").alias("outcome")).unionByName(bad.select("close", F.array_join("reasons", ",").alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("rows"), F.round(F.coalesce(F.sum("close"), F.lit(0)).cast("double"), 2).alias("closes"))


@query(f"""WITH {BARS_SQL} SELECT symbol, count(*) AS bars, min(date) AS first_day, round(sum(high * (adj_close / close)), 4) AS highs, sum(CAST(volume AS BIGINT)) AS volume
FROM bars WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close <> 0 AND volume IS NOT NULL GROUP BY symbol""")
def chart_file(spark: SparkSession, d: str) -> DataFrame:
    """Each symbol's bars as a chart document of parallel arrays, and what the reader makes of it."""
    b = bars(spark, d).filter("close is null or close <> 0")
    day = F.unix_timestamp(F.col("date").cast("timestamp"))
    steps = F.array_sort(F.collect_list(F.struct(day.alias("t"), "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"), "adj_close")))
    of = lambda c: F.transform("s", lambda x: x[c])
    quote = F.struct(*[of(c).alias(c) for c in ("open", "high", "low", "close", "volume")])
    result = F.struct(F.struct("symbol").alias("meta"), of("t").alias("timestamp"),
        F.struct(F.array(quote).alias("quote"), F.array(F.struct(of("adj_close").alias("adjclose"))).alias("adjclose")).alias("indicators"))
    path = f"{_folder(spark)}/charts"
    written = b.groupBy("symbol").agg(steps.alias("s")).select(F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"}))
    written.write.text(path)
    back = files.chart_bars(spark.read.text(path), "value")
    return back.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("date").alias("first_day"), F.round(F.sum("high"), 4).alias("highs"), F.sum("volume").alias("volume"))


@query("""WITH kept AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0), r AS (SELECT 'orders' AS "table", 'RAGGED' AS problem,
  count(*) AS rows FROM orders WHERE o_orderkey % 97 = 0
UNION ALL SELECT 'lines', 'ORPHAN', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM kept)
UNION ALL SELECT 'lines', 'DUPLICATE_KEY', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
  SELECT "table", problem, rows FROM r WHERE rows > 0""")
def staged_tsv(spark: SparkSession, d: str) -> DataFrame:
    """Two tables staged as tab-separated files, some lines broken, read back and validated."""
    folder = _folder(spark)
    line = lambda *c: F.concat_ws("\t", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c])
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 97 == 0, line("o_orderkey", "o_custkey")).otherwise(line("o_orderkey", "o_custkey", "o_orderpriority")).alias("value"))
    head = spark.createDataFrame([("O_ORDERKEY\tO_CUSTKEY\tO_ORDERPRIORITY",)], "value string")
    head.unionByName(o).write.text(f"{folder}/orders.tsv")
    table(spark, d, "lineitem").select(line("l_orderkey", "l_linenumber", "l_partkey").alias("value")).write.text(f"{folder}/lines.tsv")
    orders, ragged = files.tsv_table(spark, f"{folder}/orders.tsv", ["o_orderkey", "o_custkey", "o_orderpriority"])
    lines, _ = files.tsv_table(spark, f"{folder}/lines.tsv", ["o_orderkey", "l_linenumber", "l_partkey"])
    found = files.validate_tables({"orders": orders, "lines": lines}, {"orders": ["o_orderkey"], "lines": ["o_orderkey", "l_linenumber"]}, "orders", "o_orderkey")
    broken = ragged.agg(F.count("*").alias("rows")).select(F.lit("orders").alias("table"), F.lit("RAGGED").alias("problem"), "rows").filter("rows > 0")
    return found.unionByName(broken)


_FORMED = _FILINGS_SQL + """, n AS (SELECT f.key, r.delivery_id, r.issuer_cik, r.provider, upper(trim(r.form_type)) AS form, r.accepted_at, r.payload
  FROM f JOIN sec_raw_records r USING (delivery_id) WHERE f.key <> '')"""


def _formed(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "sec_raw_records").withColumn("key", N.accession(F.col("accession_number"), F.col("provider_record_id"))).filter("key is not null")
    return r.select("key", "delivery_id", "issuer_cik", "provider", F.upper(F.trim("form_type")).alias("form"), "accepted_at", "payload")


@query(_FORMED + r"""SELECT accession, cik, form, filed FROM (SELECT key AS accession, coalesce(trim(issuer_cik), '') AS cik, form, coalesce(strftime(accepted_at, '%Y%m%d'), '') AS filed,
  row_number() OVER (PARTITION BY key ORDER BY form, coalesce(trim(issuer_cik), ''), coalesce(provider, ''), coalesce(strftime(accepted_at, '%Y%m%d'), '')) AS rn
  FROM n WHERE regexp_full_match(form, '[345](/A)?')) WHERE rn = 1""")
def index_file(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries as lines of a daily index; one line per filing is read back."""
    path = f"{_folder(spark)}/index"
    filed = F.date_format("accepted_at", "yyyyMMdd")
    fields = [F.coalesce(c, F.lit("")) for c in (F.col("issuer_cik"), F.col("provider"), F.col("form"), filed)]
    head = spark.createDataFrame([("CIK|Company Name|Form Type|Date Filed|File Name",), ("-" * 40,)], "value string")
    lines = _formed(spark, d).select(F.concat_ws("|", *fields, F.concat(F.lit("edgar/data/"), "key", F.lit(".txt"))).alias("value"))
    head.unionByName(lines).write.text(path)
    return files.daily_index(spark.read.text(path)).select("accession", "cik", "form", "filed")


@query("""SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter,
  '/files/' || year(o_orderdate) || 'q' || quarter(o_orderdate) || '_forms.zip' AS url FROM orders WHERE o_orderdate IS NOT NULL""")
def catalogue_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of links to quarterly archives, scraped."""
    q = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).filter("y is not null").distinct()
    link = F.concat(F.lit('<li><a href="/files/'), F.col("y").cast("string"), F.lit("q"), F.col("q").cast("string"), F.lit('_forms.zip">archive</a></li><a href="/about.html">about</a>'))
    links = files.catalogue_links(q.select(link.alias("html")), "html")
    return links.select(F.col("year").cast("long").alias("year"), F.col("quarter").cast("long").alias("quarter"), "url")


@query(_FORMED + r"""SELECT key AS accession, regexp_extract(form, '^\S+') AS form, date_trunc('second', accepted_at) AS accepted_at,
  nullif(sha256(regexp_replace(decode(payload), '^\s+|\s+$', '', 'g')), sha256('')) AS document FROM n WHERE form <> ''""")
def envelope_file(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries as complete submissions, with header lines and the document inside; header fields and document read back."""
    path = f"{_folder(spark)}/submissions"
    r = _formed(spark, d).filter("form <> ''")
    stamp = F.coalesce(F.date_format("accepted_at", "yyyyMMddHHmmss"), F.lit(""))
    text = F.concat(F.lit("<ACCEPTANCE-DATETIME>"), stamp, F.lit("\nACCESSION NUMBER:\t"), "key", F.lit("\nCONFORMED SUBMISSION TYPE:\t"), "form",
        F.lit("\n<XML>\n"), F.coalesce(F.col("payload").cast("string"), F.lit("")), F.lit("\n</XML>\n"))
    r.select(text.alias("text")).write.parquet(path)
    e = files.submission_envelope(spark.read.parquet(path), "text")
    return e.select("accession", "form", F.col("accepted_at").cast("timestamp_ntz").alias("accepted_at"), F.sha2("document", 256).alias("document"))


@query("SELECT CAST(delivery_id AS VARCHAR) AS delivery_id, provider_record_id, strftime(accepted_at, '%Y-%m-%d') AS day FROM sec_raw_records")
def cursor_codec(spark: SparkSession, d: str) -> DataFrame:
    """Positions of a scan as opaque cursors, and back."""
    r = table(spark, d, "sec_raw_records").withColumn("day", N.day_text(F.col("accepted_at"))).withColumn("cursor", files.encode_cursor("delivery_id", "provider_record_id", "day"))
    return r.select(*[c.alias(n) for c, n in zip(files.decode_cursor("cursor", 3), ("delivery_id", "provider_record_id", "day"))])


@query("""WITH s AS (SELECT cik, ticker, exchange, coalesce(trim(cik) <> '', false) AS a, coalesce(trim(ticker) <> '', false) AS b FROM identity_snapshots)
SELECT cik, ticker, exchange, concat_ws(',', CASE WHEN NOT a THEN 'MISSING_CIK' END, CASE WHEN NOT b THEN 'MISSING_TICKER' END) AS reasons FROM s""")
def positional_file(spark: SparkSession, d: str) -> DataFrame:
    """Identity rows as documents with a list of fields and arrays of values; rows without key fields are set aside."""
    path = f"{_folder(spark)}/identities"
    s = table(spark, d, "identity_snapshots")
    row = F.array("exchange", "cik", "ticker")
    s.groupBy("run_id", F.xxhash64("cik").alias("part")).agg(F.collect_list(row).alias("data")).select(F.to_json(F.struct(F.array(F.lit("Exchange"),
        F.lit("CIK"), F.lit("Ticker")).alias("fields"), "data"))).write.text(path)
    good, bad = files.positional_checked(spark.read.text(path), "value", ["cik", "ticker", "exchange"], ["cik", "ticker"])
    return good.withColumn("reasons", F.lit("")).unionByName(bad.withColumn("reasons", F.array_join("reasons", ",")))


@query("""SELECT 'lines' AS taxonomy, l_returnflag AS concept, l_linestatus AS unit, count(*) AS facts, round(sum(l_extendedprice), 2) AS value,
  min(CAST(l_shipdate AS DATE)) AS first_end, count(DISTINCT l_orderkey) AS accessions FROM lineitem GROUP BY ALL""")
def facts_file(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as documents of maps in maps of arrays, flattened."""
    path = f"{_folder(spark)}/facts"
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    entry = F.struct(day.alias("end"), F.col("l_extendedprice").cast("double").alias("val"), day.alias("filed"), F.col("l_orderkey").cast("string").alias("accn"))
    pairs = lambda k, v: F.map_from_entries(F.collect_list(F.struct(F.col(k), v)))
    units = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.collect_list(entry).alias("e"))
    concepts = units.groupBy("l_orderkey", "l_returnflag").agg(pairs("l_linestatus", F.col("e")).alias("units"))
    docs = concepts.groupBy("l_orderkey").agg(pairs("l_returnflag", F.struct("units")).alias("c"))
    docs.select(F.to_json(F.struct(F.create_map(F.lit("lines"), F.col("c")).alias("facts")))).write.text(path)
    f = files.nested_facts(spark.read.text(path), "value")
    return f.groupBy("taxonomy", "concept", "unit").agg(F.count("*").alias("facts"), F.round(F.sum("value"), 2).alias("value"),
        F.min("period_end").alias("first_end"), F.count_distinct("accession").alias("accessions"))


@query("SELECT form, n_nationkey, n_name FROM nation CROSS JOIN (VALUES ('array'), ('lines'), ('parquet'), ('wrapped')) f(form)")
def generic_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table as a JSON array, JSON lines, Parquet and a wrapped array, each read by its ending."""
    folder = _folder(spark)
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    n.write.json(f"{folder}/lines.jsonl")
    n.write.parquet(f"{folder}/rows.parquet")
    rows = n.agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("rows"))  # a table of nations is one document's size
    rows.select(F.to_json("rows")).write.text(f"{folder}/array.json")
    rows.select(F.to_json(F.struct("rows"))).write.text(f"{folder}/wrapped.json")
    forms = {"lines": ("lines.jsonl", None), "parquet": ("rows.parquet", None), "array": ("array.json", None), "wrapped": ("wrapped.json", "rows")}
    read = [files.any_rows(spark, f"{folder}/{path}", field).select(F.lit(form).alias("form"), F.col("n_nationkey").cast("long").alias("n_nationkey"),
        "n_name") for form, (path, field) in forms.items()]
    return read[0].unionByName(read[1]).unionByName(read[2]).unionByName(read[3])


@query("SELECT c_custkey, c_mktsegment FROM customer")
def envelope_batch(spark: SparkSession, d: str) -> DataFrame:
    """Records in batch envelopes without quarantines or failures; one with either would be refused as a whole."""
    path = f"{_folder(spark)}/batch"
    c = table(spark, d, "customer").groupBy(F.pmod("c_custkey", F.lit(997)).alias("part")).agg(F.collect_list(F.struct("c_custkey", "c_mktsegment")).alias("records"))
    none = F.array().cast("array<string>")
    c.select(F.to_json(F.struct("records", none.alias("quarantines"), none.alias("failures"), F.lit(True).alias("complete")))).write.text(path)
    return files.batch_envelope(spark, path, "c_custkey bigint, c_mktsegment string")


@query("""SELECT 'nation' AS kind, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region UNION ALL
  SELECT 'supplier', s_suppkey, s_name FROM supplier""")
def snapshot_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables written as a snapshot, twice, and read back through its manifest, content checked."""
    folder = _folder(spark)
    named = {"nation": "n", "region": "r", "supplier": "s"}
    tables = {t: table(spark, d, t) for t in named}
    for _ in range(2):
        snapshot.write_snapshot(tables, folder, "run-1")
    back = snapshot.read_snapshot(spark, folder)
    key = {"nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey"}
    parts = [back[t].select(F.lit(t).alias("kind"), F.col(key[t]).cast("long").alias("id"), F.col(f"{p}_name").alias("name")) for t, p in named.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT c_mktsegment, count(*) AS customers, sum(c_custkey) AS keys FROM customer GROUP BY c_mktsegment")
def partitioned_export(spark: SparkSession, d: str) -> DataFrame:
    """A folder of JSON lines per segment, read back by folder."""
    path = f"{_folder(spark)}/segments"
    snapshot.export_partitioned_json(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), path, "c_mktsegment")
    back = spark.read.schema("c_custkey long, c_mktsegment string").json(path)
    return back.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.sum("c_custkey").alias("keys"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS batch FROM orders")
def ledger_appends(spark: SparkSession, d: str) -> DataFrame:
    """A ledger of keys fed by overlapping batches, one of them delivered twice: each key once, in the batch that had it first."""
    path = f"{_folder(spark)}/ledger"
    o = table(spark, d, "orders").select("o_orderkey")
    first = o.filter("o_orderkey % 3 = 0")
    for batch, rows in ((0, first), (0, first), (1, o.unionByName(first))):
        snapshot.append_new(rows, path, "o_orderkey", spark, batch)
    return spark.read.parquet(path).select("o_orderkey", F.col("batch").cast("long").alias("batch"))


@query("""SELECT rule, rows FROM (SELECT 'line_has_order' AS rule, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'order_has_lines', count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'line_after_order', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND NOT coalesce(l_shipdate >= o_orderdate, false)
UNION ALL SELECT 'total_is_sum', count(*) FROM (SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey, o_totalprice
  HAVING NOT coalesce(abs(o_totalprice - sum(l_extendedprice)) <= 0.01, false)))""")
def referential_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break what two tables owe each other: links both ways, the order of their clocks, sums of members."""
    o = table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    li = table(spark, d, "lineitem")
    both = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    sums = both.groupBy("o_orderkey", "o_totalprice").agg(F.sum("l_extendedprice").alias("s"))
    named = lambda df, rule: df.agg(F.count("*").alias("rows")).select(F.lit(rule).alias("rule"), "rows")
    ok = lambda c: ~F.coalesce(c, F.lit(False))
    parts = [
        named(checks.orphans(li, o, "l_orderkey", "o_orderkey"), "line_has_order"),
        named(checks.orphans(o, li, "o_orderkey", "l_orderkey"), "order_has_lines"),
        named(both.filter(ok(F.col("l_shipdate") >= F.col("o_orderdate"))), "line_after_order"),
        named(sums.filter(ok(F.abs(F.col("o_totalprice") - F.col("s")) <= 0.01)), "total_is_sum"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
