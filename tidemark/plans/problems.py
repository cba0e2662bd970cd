"""Queries p1 to p7 over the test tables. Each runs over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal as N
from ..operators import asof, dedup, history, late, nested, rolling, spikes
from ..sources.tables import spread_table, table

# ---------------------------------------------------------------- 1: attributes as known at event time


def _events(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "insider_signals")
    return s.select(F.col("signal_id").alias("event_id"), N.cik(F.col("issuer_cik")).alias("entity"), F.coalesce("knowledge_at", "accepted_at").alias("t"))


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ticker_intervals").select(N.cik(F.col("cik")).alias("entity"), "interval_id", "valid_from", "valid_to", "knowledge_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    joined = asof.asof_attributes(_events(spark, d), _intervals(spark, d))
    return joined.filter("event_id is not null and interval_id is not null").select(F.col("event_id").alias("signal_id"), "interval_id")


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    """Which interval rules from when on, of each issuer."""
    return asof.current_state_versions(_intervals(spark, d)).select(F.col("entity").alias("cik"), F.when(F.year("starts") > 1, F.col("starts")).alias("starts"), "interval_id")


P1_FOUND_SQL = """
WITH e AS (SELECT DISTINCT signal_id, lpad(issuer_cik, 10, '0') AS cik, coalesce(knowledge_at, accepted_at) AS t FROM insider_signals),
m AS (SELECT e.signal_id, i.interval_id, row_number() OVER (PARTITION BY e.signal_id ORDER BY i.valid_from DESC NULLS LAST, i.knowledge_at DESC NULLS LAST, i.interval_id DESC) AS rn
      FROM e JOIN ticker_intervals i ON lpad(i.cik, 10, '0') = e.cik AND (i.valid_from IS NULL OR i.valid_from <= CAST(e.t AS DATE))
        AND (i.valid_to IS NULL OR CAST(e.t AS DATE) < i.valid_to) AND (i.knowledge_at IS NULL OR i.knowledge_at <= e.t))
SELECT signal_id, interval_id FROM m WHERE rn = 1 AND signal_id IS NOT NULL
"""
P1_VERSIONS_SQL = """
WITH i AS (SELECT lpad(cik, 10, '0') AS cik, interval_id, CAST(valid_from AS TIMESTAMP) AS vf, knowledge_at AS k, CAST(valid_to AS TIMESTAMP) AS stops,
             coalesce(greatest(CAST(valid_from AS TIMESTAMP), knowledge_at), TIMESTAMP '0001-01-01') AS starts FROM ticker_intervals WHERE cik IS NOT NULL),
r AS (SELECT * FROM i WHERE stops IS NULL OR starts < stops),
p AS (SELECT cik, starts AS point FROM r UNION SELECT cik, stops FROM r WHERE stops IS NOT NULL),
b AS (SELECT p.cik, p.point, r.interval_id, row_number() OVER (PARTITION BY p.cik, p.point ORDER BY r.vf DESC NULLS LAST, r.k DESC NULLS LAST, r.interval_id DESC NULLS LAST) AS rn
      FROM p LEFT JOIN r ON r.cik = p.cik AND r.starts <= p.point AND (r.stops IS NULL OR p.point < r.stops)),
c AS (SELECT cik, point, interval_id, lag(interval_id) OVER w AS was, row_number() OVER w AS n FROM b WHERE rn = 1 WINDOW w AS (PARTITION BY cik ORDER BY point))
SELECT cik, nullif(point, TIMESTAMP '0001-01-01') AS starts, interval_id FROM c WHERE n = 1 OR interval_id IS DISTINCT FROM was
"""

# ---------------------------------------------------------------- 2: late events


def _filings(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "sec_raw_records")
    return r.select(
        _accession().alias("key"),
        N.loose_date(F.col("report_date")).alias("stated_day"),
        "accepted_at",
        F.col("retrieved_at").alias("arrived_at"),
        F.col("delivery_id").alias("record_id"),
    )


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return late.deltas(late.versions(late.facts(_filings(spark, d))))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return late.beyond_cut_off(_deltas(spark, d)).select("period", F.col("key").alias("accession_number"))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    return late.totals(_deltas(spark, d))


def p2_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Every retraction and addition, in the order in which the totals change."""
    return _deltas(spark, d).filter("not late").select(F.col("key").alias("accession_number"), F.col("version").cast("long").alias("version"), "at",
        "period", F.col("delta").cast("long").alias("delta"))


_FILINGS_SQL = r"""
WITH s AS (SELECT CASE WHEN regexp_matches(coalesce(accession_number, ''), '\d{10}-?\d{2}-?\d{6}') THEN accession_number ELSE provider_record_id
  END AS raw, trim(report_date) AS rd, accepted_at, retrieved_at, delivery_id FROM sec_raw_records),
f AS (SELECT regexp_replace(regexp_extract(raw, '(^|[^0-9])([0-9]{10}-?[0-9]{2}-?[0-9]{6})($|[^0-9])', 2), '^(\d{10})-?(\d{2})-?(\d{6})$', '\1-\2-\3') AS key,
  CAST(coalesce(try_strptime(substr(rd, 1, 10), '%Y-%m-%d'), try_strptime(rd, '%Y%m%d'), try_strptime(rd, '%m/%d/%Y'), try_strptime(rd,
  '%d-%b-%Y')) AS DATE) AS day, accepted_at, retrieved_at, delivery_id FROM s)
"""
P2_FOUND_SQL = (
    _FILINGS_SQL
    + """, g AS (SELECT key, coalesce(arg_min(day, retrieved_at) FILTER (day IS NOT NULL), CAST(min(accepted_at) AS DATE)) AS day,
  min(retrieved_at) AS seen FROM f WHERE key <> '' GROUP BY key)
SELECT strftime(day, '%Y-%m') AS period, key AS accession_number FROM g WHERE seen >= date_trunc('month', day) + INTERVAL 1 MONTH + INTERVAL 45 DAY
"""
)
_VERSIONS_SQL = (
    _FILINGS_SQL
    + """, a AS (SELECT key, day, min(retrieved_at) AS seen_at, min(accepted_at) AS acc, arg_min(delivery_id, (retrieved_at, delivery_id)) AS id FROM f WHERE key <> '' GROUP BY key, day),
v AS (SELECT key, seen_at, row_number() OVER w AS version, min(seen_at) OVER w AS seen, coalesce(first_value(day IGNORE NULLS) OVER w, CAST(min(acc) OVER w AS DATE)) AS day FROM a
      WINDOW w AS (PARTITION BY key ORDER BY seen_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, CASE WHEN seen < date_trunc('month', day) + INTERVAL 1 MONTH + INTERVAL 45 DAY THEN strftime(day, '%Y-%m') END AS counted FROM v),
l AS (SELECT *, lag(counted) OVER (PARTITION BY key ORDER BY version) AS was FROM c),
d AS (SELECT key AS accession_number, version, seen_at, was AS period, CAST(-1 AS BIGINT) AS delta FROM l WHERE was IS DISTINCT FROM counted AND was IS NOT NULL
      UNION ALL SELECT key, version, seen_at, counted, CAST(1 AS BIGINT) FROM l WHERE was IS DISTINCT FROM counted AND counted IS NOT NULL)
"""
)
P2_TOTALS_SQL = _VERSIONS_SQL + """SELECT period, CAST(sum(delta) AS BIGINT) AS filings, CAST(count(*) FILTER (delta > 0) AS BIGINT) AS added,
  CAST(count(*) FILTER (delta < 0) AS BIGINT) AS retracted FROM d GROUP BY period"""
P2_DELTAS_SQL = _VERSIONS_SQL + 'SELECT accession_number, CAST(version AS BIGINT) AS version, seen_at AS "at", period, delta FROM d'

# ---------------------------------------------------------------- 3: nested records

_LINES = ["nonDerivativeTransaction", "derivativeTransaction"]
_NAMES = [*_LINES, "nonDerivativeTable", "derivativeTable", "reportingOwner", "rptOwnerCik", "footnoteId", "id", "transport", "fetches", "attempt"]


def _records_with_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = table(spark, d, "sec_raw_records")
    # nodes carry the delivery's number only; the accession joins them at the end
    nodes = nested.label_nodes(spread_table(spark, d, "sec_raw_records").select("delivery_id", "payload", "provenance"), F.col("delivery_id"), ["payload", "provenance"], _NAMES)
    return raw, nodes


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    raw, nodes = _records_with_nodes(spark, d)
    links = {"line": _LINES, "part": ["nonDerivativeTable", "derivativeTable"], "owner": ["reportingOwner"], "note": ["footnoteId"], "fetch": ["fetches"], "transport": ["transport"]}
    linked = nested.enclosing(nodes, links)
    letter = F.when(F.coalesce("line.name", "name") == "derivativeTransaction", "D").otherwise("N")
    name, value = F.col("name"), F.col("value")
    is_line = name.isin(_LINES) & F.col("part").isNotNull()
    is_note = F.col("line").isNotNull() & ((name == "id") & F.col("note").isNotNull() | (name == "footnoteId") & value.isNotNull() & (value != ""))
    is_fetch = (name == "attempt") & F.col("fetch").isNotNull() & F.col("transport").isNotNull() & (F.col("document") == "provenance")
    rows = linked.select(
        "record",
        F.when((name == "rptOwnerCik") & F.col("owner").isNotNull() & (F.col("document") == "payload"),
            F.struct(F.lit("owner").alias("kind"), F.lit("").alias("parent_key"), N.cik(value).alias("child_key")))
        .when(is_line, F.struct(F.lit("line").alias("kind"), letter.alias("parent_key"), F.col("ordinal").cast("string").alias("child_key")))
        .when(is_note, F.struct(F.lit("footnote").alias("kind"), F.concat(letter, F.col("line.ordinal").cast("string")).alias("parent_key"), value.alias("child_key")))
        .when(is_fetch, F.struct(F.lit("fetch").alias("kind"), F.col("record").cast("string").alias("parent_key"), value.alias("child_key")))
        .alias("r"),
    ).filter("r is not null and r.child_key is not null")
    keys = raw.select(F.col("delivery_id").alias("record"), _accession().alias("accession_number"))
    return rows.join(keys, "record").select("accession_number", "r.kind", "r.parent_key", "r.child_key").distinct()


def p3_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The labelled nodes from which the flat tables are cut."""
    return _records_with_nodes(spark, d)[1]


def p3_line_owners(spark: SparkSession, d: str) -> DataFrame:
    """Transaction codes linked to their transactions by the containment join."""
    raw = table(spark, d, "sec_raw_records")
    nodes = nested.label_nodes(raw, F.col("delivery_id"), ["payload"], [*_LINES, "transactionCode"])
    pairs = nested.contained_in(nodes.filter("name = 'transactionCode'"), nodes.filter(F.col("name").isin(_LINES)))
    return pairs.select(F.col("child_record").alias("delivery_id"), F.col("parent_name").alias("line_type"), F.col("parent_ordinal").alias("line"), F.col("child_value").alias("code"))


#: What stands at a path as a list: an array's members, one value alone, nothing for a null.
_ARRAY_SQL = """CASE WHEN {0} IS NULL OR json_type({0}) = 'NULL' THEN [] WHEN json_type({0}) = 'ARRAY'
  THEN list_filter(from_json({0}, '["JSON"]'), lambda e: e IS NOT NULL AND json_type(e) <> 'NULL') ELSE [{0}] END"""


def _lines_sql(letter: str, part: str) -> str:
    """Transactions of one table, out of XML by patterns and out of JSON by paths."""
    kind = {"N": "nonDerivative", "D": "derivative"}[letter]
    return f"""SELECT acc, delivery_id, '{letter}' AS letter, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT acc, delivery_id,
  regexp_extract_all(regexp_extract(x, '<{kind}Table>.*</{kind}Table>', 0, 's'), '<{kind}Transaction(?:\\s[^>]*)?(?:/>|>.*?</{kind}Transaction>)', 0, 's') AS l FROM xml)
UNION ALL SELECT acc, delivery_id, '{letter}', CAST(unnest(l) AS VARCHAR), generate_subscripts(l, 1) FROM (SELECT acc,
  delivery_id, {_ARRAY_SQL.format(f"(root->'$.{kind}Table.{kind}Transaction')")} AS l FROM js)"""


_P3 = (
    _FILINGS_SQL
    + rf""", t AS (SELECT nullif(f.key, '') AS acc, delivery_id, trim(decode(r.payload), chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS x,
  r.provenance AS p FROM f JOIN sec_raw_records r USING (delivery_id)),
xml AS (SELECT acc, delivery_id, regexp_replace(regexp_replace(x, '<!--.*?-->', '', 'gs'), '<!\[CDATA\[.*?\]\]>', '', 'gs') AS x FROM t WHERE x LIKE '<%' AND x LIKE '%</ownershipDocument>'),
jd AS (SELECT acc, delivery_id, CASE WHEN json_type(x) = 'VARCHAR' THEN json(json_extract_string(x, '$')) ELSE json(x) END AS d FROM t WHERE x NOT LIKE '<%' AND json_valid(x)),
js AS (SELECT acc, delivery_id, coalesce(d->'$.ownershipDocument', d) AS root FROM jd),
o AS (SELECT acc, unnest(regexp_extract_all(x, '<rptOwnerCik>\s*([^<]*?)\s*</rptOwnerCik>', 1)) AS cik FROM xml
  UNION ALL SELECT acc, json_extract_string(unnest({_ARRAY_SQL.format("(root->'$.reportingOwner')")}), '$.reportingOwnerId.rptOwnerCik') FROM js),
l AS ({_lines_sql("N", "nonDerivative")} UNION ALL {_lines_sql("D", "derivative")}),
n AS (SELECT acc, letter, pos, unnest(regexp_extract_all(line, '<footnoteId\s+id\s*=\s*["'']\s*([^"''\s]+)', 1)) AS id FROM l WHERE line LIKE '<%'
  UNION ALL SELECT acc, letter, pos, unnest(list_filter(regexp_extract_all(m, '"([^"]+)"', 1), lambda v: v <> 'id')) FROM (SELECT acc, letter, pos,
    unnest(regexp_extract_all(CAST(json(line) AS VARCHAR), '"footnoteId":("[^"]*"|\{{[^}}]*\}}|\[[^\]]*\])', 1)) AS m FROM l WHERE line NOT LIKE '<%')),
pv AS (SELECT acc, delivery_id, CASE WHEN json_type(p) = 'VARCHAR' THEN json(json_extract_string(p, '$')) ELSE json(p) END AS v FROM t WHERE json_valid(p)),
h AS (SELECT acc, delivery_id, json_extract_string(unnest({_ARRAY_SQL.format("(v->'$.transport.fetches')")}), '$.attempt') AS attempt FROM pv)"""
)
P3_FOUND_SQL = (
    _P3
    + """
SELECT DISTINCT acc AS accession_number, kind, parent_key, child_key FROM (
  SELECT acc, 'owner' AS kind, '' AS parent_key, lpad(cik, 10, '0') AS child_key FROM o WHERE cik <> ''
  UNION ALL SELECT acc, 'line', letter, CAST(pos AS VARCHAR) FROM l UNION ALL SELECT acc, 'footnote', letter || pos, id FROM n
  UNION ALL SELECT acc, 'fetch', CAST(delivery_id AS VARCHAR), attempt FROM h WHERE attempt IS NOT NULL)"""
)
P3_LINE_OWNERS_SQL = (
    _P3
    + r"""
SELECT delivery_id, CASE letter WHEN 'N' THEN 'nonDerivativeTransaction' ELSE 'derivativeTransaction' END AS line_type, pos AS line, code FROM (SELECT *, CASE WHEN line LIKE '<%'
  THEN CASE WHEN line LIKE '%<transactionCode>%' THEN regexp_extract(line, '<transactionCode>\s*([^<]*?)\s*</transactionCode>', 1) END
  ELSE json_extract_string(line, '$.transactionCoding.transactionCode') END AS code FROM l) WHERE code IS NOT NULL"""
)

# ---------------------------------------------------------------- 4: implausible readings


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "daily_bars").select(F.col("provider").alias("source"), N.symbol(F.col("symbol")).alias("series"), F.col("date").alias("day"),
        "high", "low", "close", "adj_close", "volume", "split_factor", F.col("available_at").alias("known_at"))
    return spikes.implausible(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # a reading's reasons stand in one task's output side by side, but readings are few: one small exchange
    return p4_flags(spark, d).select(F.col("source").alias("provider"), F.col("series").alias("symbol"), N.day_text(F.col("day")).alias("session_date"), "field").distinct()


# ---------------------------------------------------------------- 5: messages delivered more than once

_DELIVERY = ["delivery_id", "accession_number", "provider_record_id", "retrieved_at"]


def _accession() -> Column:
    return N.accession(F.col("accession_number"), F.col("provider_record_id"))


def _arrival() -> list[Column]:
    return [F.col("retrieved_at"), F.col("delivery_id")]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sec_raw_records").select(*_DELIVERY)
    return dedup.copies(m, _accession(), _arrival(), "delivery_id").select("delivery_id")


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "sec_raw_records").select(*_DELIVERY)
    return dedup.keep_first(m, _accession(), _arrival()).select("delivery_id", _accession().alias("accession_number"))


def p5_new_batch(spark: SparkSession, d: str) -> DataFrame:
    """The last provider's deliveries as a new batch against what the others have stored."""
    m = table(spark, d, "sec_raw_records").select("provider", *_DELIVERY)
    new = dedup.new_messages(m.filter("provider = 'sec-quarterly'"), m.filter("provider <> 'sec-quarterly'"), _accession(), _accession(), _arrival())
    return new.select("delivery_id", _accession().alias("accession_number"))


_P5 = _FILINGS_SQL + ", k AS (SELECT delivery_id, key, row_number() OVER (PARTITION BY key ORDER BY retrieved_at, delivery_id) AS rn FROM f WHERE key <> '')"
P5_FOUND_SQL = _P5 + "SELECT delivery_id FROM k WHERE rn > 1"
P5_KEPT_SQL = _P5 + "SELECT delivery_id, key AS accession_number FROM k WHERE rn = 1"
P5_NEW_BATCH_SQL = (
    _FILINGS_SQL
    + """, q AS (SELECT f.*, provider FROM f JOIN sec_raw_records r USING (delivery_id)),
k AS (SELECT delivery_id, key, row_number() OVER (PARTITION BY key ORDER BY retrieved_at, delivery_id) AS rn FROM q WHERE provider = 'sec-quarterly')
SELECT delivery_id, key AS accession_number FROM k WHERE rn = 1 AND key NOT IN (SELECT key FROM q WHERE provider <> 'sec-quarterly')
"""
)

# ---------------------------------------------------------------- 6: history of changing attributes


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "identity_snapshots").filter("identity_status = 'RESOLVED'")
    rows = s.select(
        N.cik(F.col("cik")).alias("entity"),
        "valid_from",
        F.col("valid_to").alias("stated_to"),
        "knowledge_at",
        F.coalesce(N.ticker(F.col("ticker")), F.lit("")).alias("ticker"),
        F.coalesce(N.symbol(F.col("exchange")), F.lit("")).alias("exchange"),
        "run_id",
    )
    h = history.version_history([rows], ["ticker", "exchange"], snapshot="run_id")
    return h.select(F.col("entity").alias("cik"), "ticker", "exchange", N.day_text(F.col("valid_from")).alias("valid_from"),
        F.coalesce(N.day_text(F.col("valid_to")), F.lit("")).alias("valid_to"))


P6_FOUND_SQL = r"""
WITH s AS (SELECT lpad(cik, 10, '0') AS cik, regexp_replace(upper(trim(ticker)), '[\s./_-]+([A-Z0-9]{1,2})$', '-\1') AS ticker,
  upper(trim(exchange)) AS exchange, valid_from, valid_to, knowledge_at
           FROM identity_snapshots WHERE identity_status = 'RESOLVED' AND cik IS NOT NULL AND valid_from IS NOT NULL),
h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY cik, valid_from ORDER BY knowledge_at DESC NULLS LAST, ticker DESC, exchange DESC, valid_to DESC NULLS LAST) = 1),
c AS (SELECT *, CASE WHEN lag(ticker) OVER w IS NOT DISTINCT FROM ticker AND lag(exchange) OVER w IS NOT DISTINCT FROM exchange
  AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS starts FROM h WINDOW w AS (PARTITION BY cik ORDER BY valid_from)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY cik ORDER BY valid_from) AS n FROM c),
v AS (SELECT cik, n, coalesce(any_value(ticker), '') AS ticker, coalesce(any_value(exchange), '') AS exchange, min(valid_from) AS valid_from,
  arg_max(coalesce(CAST(valid_to AS VARCHAR), ''), valid_from) AS stated FROM r GROUP BY cik, n)
SELECT cik, ticker, exchange, strftime(valid_from, '%Y-%m-%d') AS valid_from, coalesce(strftime(lead(valid_from) OVER (PARTITION BY cik
  ORDER BY valid_from), '%Y-%m-%d'), stated) AS valid_to FROM v
"""

# ---------------------------------------------------------------- 7: rolling totals


def _bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars that come twice count once; all providers of a symbol together."""
    b = table(spark, d, "daily_bars").select(N.symbol(F.col("symbol")).alias("entity"), F.col("date").alias("day"), "provider", "provider_record_id",
        F.col("volume").cast("double").alias("amount"), F.col("close").cast("decimal(18,4)").alias("level"))
    return b.distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    t = rolling.trailing(rolling.daily_totals(_bars(spark, d)), (7,))
    return t.filter("active_7 = 0").select(F.col("entity").alias("symbol"), N.day_text(F.col("day")).alias("day"))


def p7_rolling(spark: SparkSession, d: str) -> DataFrame:
    t = rolling.trailing(rolling.daily_totals(_bars(spark, d)), (7, 30))
    return t.select(
        F.col("entity").alias("symbol"),
        "day",
        *[F.col(f"total_{k}").alias(f"volume_{k}") for k in (7, 30)],
        *[F.col(f"mean_{k}").alias(f"mean_volume_{k}") for k in (7, 30)],
        *[F.col(f"level_{k}").alias(f"mean_close_{k}") for k in (7, 30)],
    )


_P7 = """
WITH b AS (SELECT DISTINCT upper(trim(symbol)) AS symbol, date AS day, provider, provider_record_id, CAST(volume AS DOUBLE) AS volume, close
  FROM daily_bars WHERE symbol IS NOT NULL AND date IS NOT NULL),
t AS (SELECT symbol, day, sum(volume) AS v, sum(close) AS c, count(close) AS n, count(*) FILTER (volume > 0) AS a FROM b GROUP BY ALL),
g AS (SELECT symbol, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM t GROUP BY symbol),
f AS (SELECT g.symbol, g.day, v, c, n, coalesce(a, 0) AS a FROM g LEFT JOIN t USING (symbol, day)),
"""
P7_FOUND_SQL = _P7 + """w AS (SELECT symbol, day, sum(a) OVER (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING) AS a7 FROM f) SELECT symbol,
  strftime(day, '%Y-%m-%d') AS day FROM w WHERE a7 = 0"""
P7_ROLLING_SQL = (
    _P7
    + """w AS (SELECT symbol, day, coalesce(sum(v) OVER p7, 0) AS volume_7, coalesce(sum(v) OVER p30, 0) AS volume_30,
  CAST(sum(c) OVER p7 AS DOUBLE) / nullif(sum(n) OVER p7, 0) AS c7, CAST(sum(c) OVER p30 AS DOUBLE) / nullif(sum(n) OVER p30, 0) AS c30
  FROM f WINDOW p7 AS (PARTITION BY symbol ORDER BY day ROWS 6 PRECEDING), p30 AS (PARTITION BY symbol ORDER BY day ROWS 29 PRECEDING))
SELECT symbol, day, volume_7, volume_30, volume_7 / 7 AS mean_volume_7, volume_30 / 30 AS mean_volume_30, c7 AS mean_close_7, c30 AS mean_close_30 FROM w
"""
)

QUERIES = {f.__name__: f for f in (p1_found, p1_versions, p2_found, p2_totals, p2_deltas, p3_found, p3_nodes, p3_line_owners, p4_found, p4_flags,
    p5_found, p5_kept, p5_new_batch, p6_found, p7_found, p7_rolling)}
SQL = {
    "p1_found": P1_FOUND_SQL, "p1_versions": P1_VERSIONS_SQL, "p2_found": P2_FOUND_SQL, "p2_totals": P2_TOTALS_SQL, "p2_deltas": P2_DELTAS_SQL,
        "p3_found": P3_FOUND_SQL, "p3_line_owners": P3_LINE_OWNERS_SQL, "p5_found": P5_FOUND_SQL,
    "p5_kept": P5_KEPT_SQL, "p5_new_batch": P5_NEW_BATCH_SQL, "p6_found": P6_FOUND_SQL, "p7_found": P7_FOUND_SQL, "p7_rolling": P7_ROLLING_SQL,
}
