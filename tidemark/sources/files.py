"""Readers of the file forms that facts arrive in. Rows that don't fit are kept aside, not lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks

_BAR_COLUMNS = ["date", "ticker", "open", "high", "low", "close", "adj_close", "volume", "is_adjusted", "adjustment_basis", "split_factor"]
#: Other names of columns in market files.
_ALIASES = {"symbol": "ticker", "adjusted": "is_adjusted", "adjclose": "adj_close", "adj close": "adj_close"}


def market_csv(spark: SparkSession, path: str, as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars, quarantined rows with reasons) of CSV files with a header.

    Everything is read as text, so that one bad field costs one row. Keys that come twice are quarantined with all their
    rows, as are rows after ``as_of``. available_at is the New York close of the day, in UTC."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    raw = raw.withColumnsRenamed({c: _ALIASES.get(c.strip().lower(), c.strip().lower()) for c in raw.columns})
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in _BAR_COLUMNS if c not in raw.columns})
    num = {c: F.col(c).try_cast("decimal(18,6)") for c in ("open", "high", "low", "close", "adj_close", "split_factor")}
    typed = raw.select(F.try_to_date(F.trim("date"), "yyyy-MM-dd").alias("date"), F.upper(F.trim("ticker")).alias("symbol"),
        *[v.alias(c) for c, v in num.items()], F.col("volume").try_cast("bigint").alias("volume"),
        F.col("is_adjusted").try_cast("boolean").alias("is_adjusted"), "adjustment_basis")
    typed = typed.withColumn("adj_close", F.coalesce("adj_close", "close"))
    copies = typed.groupBy("symbol", "date").agg(F.count("*").alias("__copies"))
    joined = typed.join(copies, ["symbol", "date"], "left")
    rules = {"DATE": F.col("date").isNotNull(), "SYMBOL": F.col("symbol").rlike(r"^[A-Z][A-Z0-9.\-]*$"),
        "PRICE": (F.least("open", "high", "low", "close") > 0) & (F.col("high") >= F.col("low")), "VOLUME": F.col("volume") >= 0,
        "DUPLICATE": (F.col("__copies") == 1) | F.col("__copies").isNull()}
    if as_of:
        rules["FUTURE"] = F.col("date") <= F.lit(as_of).cast("date")
    good, bad = checks.split_valid(joined, rules)
    close = F.to_utc_timestamp(F.to_timestamp(F.concat(F.col("date").cast("string"), F.lit(" 16:00:00"))), "America/New_York")
    return good.drop("__copies").withColumn("available_at", close), bad.drop("__copies")


def daily_bars(bars: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    """One symbol's bars between two days, both included: predicates that reach the scan."""
    return bars.filter((F.col("symbol") == symbol.upper().strip()) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def tsv_table(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, ragged lines) of tab-separated files, all columns text; lines with too few or many fields stay as they are."""
    lines = spark.read.text(path)
    parts = F.split("value", "\t", -1)
    marked = lines.withColumn("f", parts).withColumn("fits", F.size("f") == len(columns))
    header = F.upper(F.trim(F.element_at("f", 1))) == columns[0].upper()
    rows = marked.filter("fits").filter(~header).select(*[F.nullif(F.element_at("f", i + 1), F.lit("")).alias(c) for i, c in enumerate(columns)])
    return rows, marked.filter("not fits").select("value")


def validate_tables(tables: dict[str, DataFrame], keys: dict[str, list[str]], parent: str, link: str) -> DataFrame:
    """(table, problem, rows): repeated keys, null keys and children without a parent."""
    out = None
    for name, df in tables.items():
        k = keys[name]
        problems = checks.duplicates(df, k).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit("DUPLICATE_KEY").alias("problem"), "rows")
        nulls = df.filter(" or ".join(f"`{c}` is null" for c in k)).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit("NULL_KEY").alias("problem"), "rows")
        problems = problems.unionByName(nulls)
        if name != parent:
            lost = checks.orphans(df, tables[parent], link, link).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit("ORPHAN").alias("problem"), "rows")
            problems = problems.unionByName(lost)
        out = problems if out is None else out.unionByName(problems)
    return out.filter("rows > 0")


def any_rows(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """Rows of Parquet, JSON lines, a JSON array, or an object that wraps an array in ``field``, by the path's ending."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    df = spark.read.json(path, multiLine=not path.endswith((".jsonl", ".ndjson")))
    return df.select(F.explode(field).alias("r")).select("r.*") if field else df


def chart_bars(raw: DataFrame, text: str) -> DataFrame:
    """(symbol, date, open, high, low, close, adj_close, volume) of chart documents, which hold parallel arrays.

    OHLC are brought to the adjusted level; steps with any null are dropped; a text that doesn't parse has no rows."""
    number = "array<double>"
    schema = f"chart struct<result: array<struct<meta: struct<symbol: string>, timestamp: array<long>, indicators: struct<quote: array<struct<open: {number}, high: {number}, low: {number}, close: {number}, volume: array<long>>>, adjclose: array<struct<adjclose: {number}>>>>>>"
    r = raw.select(F.from_json(text, schema).alias("j")).select(F.explode("j.chart.result").alias("r"))
    q = r.select("r.meta.symbol", F.col("r.timestamp").alias("t"), F.element_at("r.indicators.quote", 1).alias("q"), F.element_at("r.indicators.adjclose", 1)["adjclose"].alias("a"))
    z = q.select("symbol", F.explode(F.arrays_zip(F.col("t"), F.col("q.open").alias("o"), F.col("q.high").alias("h"), F.col("q.low").alias("l"),
        F.col("q.close").alias("c"), F.col("q.volume").alias("v"), F.col("a"))).alias("z"))
    flat = z.select("symbol", *[F.col(f"z.{c}").alias(c) for c in ("t", "o", "h", "l", "c", "v", "a")]).dropna()
    ratio = F.col("a") / F.nullif(F.col("c"), F.lit(0.0))
    return flat.select("symbol", F.to_date(F.timestamp_seconds("t")).alias("date"), (F.col("o") * ratio).alias("open"),
        (F.col("h") * ratio).alias("high"), (F.col("l") * ratio).alias("low"), F.col("a").alias("close"), F.col("a").alias("adj_close"),
        F.col("v").alias("volume"))


def positional_rows(raw: DataFrame, text: str, wanted: list[str]) -> DataFrame:
    """Rows of documents {"fields": [...], "data": [[...], ...]}, fields found by their position in ``fields``; all text."""
    j = raw.select(F.from_json(text, "fields array<string>, data array<array<string>>").alias("j")).select("j.fields", F.explode("j.data").alias("row"))
    lower = F.transform("fields", lambda f: F.lower(f))
    at = lambda name: F.array_position(lower, name.lower())
    return j.select(*[F.when(at(w) > 0, F.try_element_at("row", at(w).cast("int"))).alias(w) for w in wanted])


def positional_checked(raw: DataFrame, text: str, wanted: list[str], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """``positional_rows`` as (rows, rows set aside with ``reasons``): one reason per required field that is null or blank."""
    rows = positional_rows(raw, text, wanted)
    return checks.split_valid(rows, {f"MISSING_{c.upper()}": F.trim(c) != "" for c in required})


class RefusedBatch(ValueError):
    pass


def batch_envelope(spark: SparkSession, path: str, records: str) -> DataFrame:
    """Rows of envelopes {"records": [...], "quarantines": [...], "failures": [...], "complete": true}, one a line.

    ``records``: DDL of one record. Nothing of the batch is read if an envelope has quarantines or failures, isn't complete
    or can't be parsed; only how many there are of each reaches the driver."""
    schema = f"records array<struct<{records}>>, quarantines array<string>, failures array<string>, complete boolean, _corrupt string"
    e = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    some = lambda c: F.count_if(F.size(F.coalesce(c, F.array())) > 0)
    bad = {"quarantines": some("quarantines"), "failures": some("failures"), "incomplete": F.count_if(~F.coalesce("complete", F.lit(False))), "unreadable": F.count("_corrupt")}
    found = {k: n for k, n in e.agg(*[c.alias(k) for k, c in bad.items()]).first().asDict().items() if n}
    if found:
        raise RefusedBatch(f"batch refused: {found}")
    return e.select(F.explode("records").alias("r")).select("r.*")


def nested_facts(raw: DataFrame, text: str) -> DataFrame:
    """(taxonomy, concept, unit, value, period_end, filed, accession) of documents with maps of maps of arrays."""
    schema = "facts map<string, map<string, struct<units: map<string, array<struct<`end`: string, val: double, filed: string, accn: string>>>>>>"
    a = raw.select(F.explode(F.from_json(text, schema)["facts"]).alias("taxonomy", "concepts"))
    b = a.select("taxonomy", F.explode("concepts").alias("concept", "c")).select("taxonomy", "concept", F.explode("c.units").alias("unit", "entries"))
    e = b.select("taxonomy", "concept", "unit", F.explode("entries").alias("e"))
    return e.select("taxonomy", "concept", "unit", F.col("e.val").alias("value"), F.try_to_date("e.end", "yyyy-MM-dd").alias("period_end"),
        F.try_to_date("e.filed", "yyyy-MM-dd").alias("filed"), F.col("e.accn").alias("accession"))


def daily_index(lines: DataFrame, form_pattern: str = r"^[345](/A)?$") -> DataFrame:
    """(cik, company, form, filed, path, accession) of pipe-separated index lines, one per accession: the first by form and
    path, so that one filing listed under several parties comes once."""
    f = F.split("value", r"\|")
    rows = lines.filter(F.size(f) == 5).select(*[F.trim(F.get(f, F.lit(i))).alias(c) for i, c in enumerate(("cik", "company", "form", "filed", "path"))])
    rows = rows.filter(F.col("form").rlike(form_pattern)).withColumn("accession", F.regexp_extract("path", r"(\d{10}-\d{2}-\d{6})", 1)).filter("accession <> ''")
    return rows.groupBy("accession").agg(F.min(F.struct("form", "path", "cik", "company", "filed")).alias("r")).select("r.cik", "r.company", "r.form", "r.filed", "r.path", "accession")


def catalogue_links(pages: DataFrame, html: str) -> DataFrame:
    """(year, quarter, url) of links to quarterly archives in HTML."""
    urls = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]*?(\d{4})q([1-4])[^"]*\.zip)"'), F.lit(1))).alias("url"))
    return urls.select(F.regexp_extract("url", r"(\d{4})q([1-4])", 1).cast("int").alias("year"),
        F.regexp_extract("url", r"(\d{4})q([1-4])", 2).cast("int").alias("quarter"), "url").distinct()


def submission_envelope(texts: DataFrame, text: str) -> DataFrame:
    """(accession, form, accepted_at, document) of complete submissions: header fields and the embedded XML."""
    t = F.col(text)
    return texts.select(
        F.nullif(F.regexp_extract(t, r"ACCESSION NUMBER:\s*(\S+)", 1), F.lit("")).alias("accession"),
            F.nullif(F.regexp_extract(t, r"CONFORMED SUBMISSION TYPE:\s*(\S+)", 1), F.lit("")).alias("form"),
        F.try_to_timestamp(F.regexp_extract(t, r"<ACCEPTANCE-DATETIME>(\d{14})", 1), F.lit("yyyyMMddHHmmss")).alias("accepted_at"),
            F.nullif(F.regexp_extract(t, r"(?s)<XML>\s*(.*?)\s*</XML>", 1), F.lit("")).alias("document"),
    )


def encode_cursor(*fields: str):  # noqa: ANN201
    """An opaque cursor of several columns."""
    return F.base64(F.to_json(F.array(*[F.col(f).cast("string") for f in fields])).cast("binary"))


def decode_cursor(cursor: str, n: int):  # noqa: ANN201
    """The n fields of a cursor, as text; nulls if it isn't one."""
    a = F.from_json(F.try_to_binary(F.col(cursor), F.lit("base64")).cast("string"), "array<string>")
    return [F.get(a, F.lit(i)) for i in range(n)]
