"""Readers, writers, resolving, constraints and streams on small files."""

import datetime as dt
import json

import pytest

from pyspark.sql import functions as F

from tidemark.functions import normal as N
from tidemark.operators import checks, resolve, study
from tidemark.operators import late as late_ops
from tidemark.sinks import snapshot, storage
from tidemark.sources import files
from tidemark.streaming.late import DifferentialTotals


def values(spark, column, rows):
    return [x[0] for x in spark.createDataFrame([(r,) for r in rows], "c string").select(column(F.col("c"))).collect()]


def test_normal_forms(spark):
    assert values(spark, N.cik, ["42", " 0000000042", None, "", "x", "12345678901"]) == ["0000000042", "0000000042", None, None, None, "12345678901"]
    same = ["9100000042-26-000098", "910000004226000098", " 9100000042-26-000098.txt", "archive/1/910000004226000098/9100000042-26-000098.txt"]
    assert set(values(spark, N.accession, same)) == {"9100000042-26-000098"}
    assert values(spark, N.accession, ["row-000001", None, "1234567890123456789"]) == [None] * 3
    assert values(spark, N.ticker, [" brk.b", "BRK B", "brk-B ", "abc", None, " "]) == ["BRK-B", "BRK-B", "BRK-B", "ABC", None, None]
    assert set(values(spark, N.loose_date, ["2024-08-29", "20240829", "08/29/2024", "29-AUG-2024", "2024-08-29T00:00:00Z", "2024-08-29 "])) == {dt.date(2024, 8, 29)}
    assert values(spark, N.loose_date, ["N/A", "", None, "2024-13-45", "99999999"]) == [None] * 5


def test_market_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("date,Symbol,open,high,low,close,volume\n2024-01-02,abc,1,2,1,2,10\n2024-01-03,abc,1,2,1,2,x\n2024-07-02,abc,2,1,2,1,5\n2024-01-04,d,1,1,1,1,0\n2024-01-04,d,1,1,1,1,0\n2025-01-01,e,1,1,1,1,0\n")
    good, bad = files.market_csv(spark, str(tmp_path / "m.csv"), "2024-12-31")
    assert [(x.symbol, x.available_at) for x in good.collect()] == [("ABC", dt.datetime(2024, 1, 2, 21))]
    assert sorted((x.symbol, tuple(x.reasons)) for x in bad.collect()) == [("ABC", ("PRICE",)), ("ABC", ("VOLUME",)), ("D", ("DUPLICATE",)), ("D", ("DUPLICATE",)), ("E", ("FUTURE",))]
    assert files.daily_bars(good, "abc", "2024-01-01", "2024-01-02").count() == 1


def test_tsv_and_validation(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("ID\tV\n1\ta\n2\t\nragged\n2\tb\n")
    (tmp_path / "c.tsv").write_text("CID\tID\n9\t1\n8\t7\n")
    s, ragged = files.tsv_table(spark, str(tmp_path / "s.tsv"), ["ID", "V"])
    c, _ = files.tsv_table(spark, str(tmp_path / "c.tsv"), ["CID", "ID"])
    assert s.count() == 3 and [x.value for x in ragged.collect()] == ["ragged"]
    got = files.validate_tables({"s": s, "c": c}, {"s": ["ID"], "c": ["CID"]}, "s", "ID").collect()
    assert {(x.table, x.problem, x.rows) for x in got} == {("s", "DUPLICATE_KEY", 1), ("c", "ORPHAN", 1)}


def test_json_forms(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"rows": [{"a": 1}, {"a": 2}]}))
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert files.any_rows(spark, str(tmp_path / "w.json"), "rows").count() == files.any_rows(spark, str(tmp_path / "l.jsonl")).count() == 2
    chart = json.dumps({"chart": {"result": [{"meta": {"symbol": "A"}, "timestamp": [0, 86400], "indicators": {"quote": [{"open": [1.0, 1.0], "high": [2.0, 2.0], "low": [1.0, 1.0], "close": [2.0, None], "volume": [5, 6]}], "adjclose": [{"adjclose": [1.0, 1.0]}]}}]}})
    raw = spark.createDataFrame([(chart,), ("{",), (None,)], "t string")
    assert [(x.symbol, x.open, x.close) for x in files.chart_bars(raw, "t").collect()] == [("A", 0.5, 1.0)]
    table = spark.createDataFrame([(json.dumps({"fields": ["cik", "Ticker"], "data": [[1, "A"], [2, None], [3]]}),)], "t string")
    assert [(x.ticker, x.cik, x.none) for x in files.positional_rows(table, "t", ["ticker", "cik", "none"]).collect()] == [("A", "1", None), (None, "2", None), (None, "3", None)]
    facts = spark.createDataFrame([(json.dumps({"facts": {"g": {"Assets": {"units": {"USD": [{"end": "2024-01-01", "val": 5, "filed": "2024-02-01", "accn": "x"}]}}}}}),)], "t string")
    assert [(x.taxonomy, x.concept, x.unit, x.value) for x in files.nested_facts(facts, "t").collect()] == [("g", "Assets", "USD", 5.0)]


def test_index_catalogue_envelope_cursor(spark):
    lines = spark.createDataFrame([("h",), ("1|B|4|20240101|edgar/1/0000000001-24-000001.txt",), ("2|A|4|20240101|edgar/0/0000000001-24-000001.txt",), ("3|C|10-K|20240101|edgar/0000000001-24-000002.txt",)], "value string")
    assert [(x.cik, x.accession) for x in files.daily_index(lines).collect()] == [("2", "0000000001-24-000001")]
    page = spark.createDataFrame([('<a href="/f/2024q1_form345.zip">x</a><a href="/f/2023q4.zip">',), (None,)], "h string")
    assert {(x.year, x.quarter) for x in files.catalogue_links(page, "h").collect()} == {(2024, 1), (2023, 4)}
    env = spark.createDataFrame([("ACCESSION NUMBER:\t0000000001-24-000001\nCONFORMED SUBMISSION TYPE:\t4\n<ACCEPTANCE-DATETIME>20240102030405\n<XML>\n<a/>\n</XML>",), ("",)], "t string")
    got = files.submission_envelope(env, "t").collect()
    assert (got[0].accession, got[0].form, got[0].document) == ("0000000001-24-000001", "4", "<a/>") and got[1].document is None
    c = spark.createDataFrame([("2024", "x"), (None, "y")], "a string, b string").withColumn("c", files.encode_cursor("a", "b"))
    assert [tuple(x) for x in c.select(*files.decode_cursor("c", 2)).collect()][0] == ("2024", "x")


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    snapshot.write_snapshot({"t": df}, str(tmp_path), "r1")
    snapshot.write_snapshot({"t": df.orderBy(F.desc("i"))}, str(tmp_path), "r1")
    with pytest.raises(snapshot.SnapshotConflict):
        snapshot.write_snapshot({"t": df.filter("i = 1")}, str(tmp_path), "r1")
    assert snapshot.read_snapshot(spark, str(tmp_path))["t"].count() == 2
    storage.Storage(spark, str(tmp_path)).write("r1/manifest.json", b"{}")
    with pytest.raises(snapshot.SnapshotConflict):
        snapshot.read_snapshot(spark, str(tmp_path))
    snapshot.export_csv(spark.createDataFrame([("=1+1",), (" @x",), ("ok",)], "s string"), str(tmp_path / "csv"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "csv")).collect() if x.value != '"s"') == ["\"' @x\"", "\"'=1+1\"", '"ok"']
    for batch in (0, 0, 1):
        snapshot.append_new(df, str(tmp_path / "ledger"), "i", spark, batch)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2


def test_resolving(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", 1, "x"), ("b", 1, "z"), ("c", 1, None), (None, 1, "q")], "k string, at int, v string")
    assert {tuple(x) for x in resolve.latest_without_conflict(rows, "k", "at", ["v"]).collect()} == {("a", 2, "y", False), ("b", 1, None, True), ("c", 1, None, False)}
    assert {x.k for x in resolve.unique_claims(rows, "k", "v").collect()} == {"a", "b"}


def test_constraints(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(2,), (None,)], "k int")
    assert [tuple(x) for x in checks.duplicates(a, ["k"]).collect()] == [(1, 2)]
    assert checks.orphans(a, b, "k", "k").count() == 3
    assert {tuple(x) for x in checks.set_difference(a, b, ["k"]).collect()} == {(1, "left"), (2, "right")}
    assert {tuple(x) for x in checks.violations(a, {"known": F.col("k") > 0}).collect()} == {("known", 1)}
    assert {tuple(x) for x in checks.changes(a.filter("v = 'x'"), a.filter("v = 'y'"), ["k"], ["v"]).collect()} == {(1, "CHANGED")}
    assert checks.violations(a.limit(0), {"known": F.col("k") > 0}).collect()[0].rows == 0


def test_sessions(spark):
    s = spark.createDataFrame([(dt.date(2024, 1, 2), 0, dt.datetime(2024, 1, 2, 21)), (dt.date(2024, 1, 5), 1, dt.datetime(2024, 1, 5, 18))], "session_date date, session_idx int, close_utc timestamp_ntz")
    times = [dt.datetime(2023, 12, 1), dt.datetime(2024, 1, 2, 21), dt.datetime(2024, 1, 2, 21, 1), dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 5, 18, 1), None]
    e = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "t timestamp_ntz, session_date int")
    assert [x.session_idx for x in study.session_at_or_after(e, s, "t").orderBy("session_date").collect()] == [0, 0, 1, 1, None, None]


def test_differential_stream_state(spark, tmp_path):
    schema = "key string, stated_day date, accepted_at timestamp_ntz, arrived_at timestamp_ntz, record_id long"
    d, t = dt.date(2024, 1, 15), dt.datetime(2024, 2, 3)
    batches = [[("a", None, t, t, 1), ("b", d, t, t, 2)], [("a", d, t, t + dt.timedelta(1), 3)], [("c", d, t, dt.datetime(2024, 6, 1), 4)]]
    totals = DifferentialTotals(spark, str(tmp_path))
    for i, rows in enumerate(batches):
        totals.apply(spark.createDataFrame(rows, schema), i)
    totals.apply(spark.createDataFrame(batches[2], schema), 2)  # delivered again
    assert {(x.period, x.filings) for x in totals.totals().collect()} == {("2024-01", 2), ("2024-02", 0)}
    assert [x.key for x in totals.beyond_cut_off().collect()] == ["c"]
    totals.apply(spark.createDataFrame([], schema), 3)
    totals.apply(spark.createDataFrame([("c", dt.date(2024, 5, 20), t, dt.datetime(2024, 5, 25), 5), ("d", None, None, None, 6)], schema), 4)  # c was seen in time for another month
    assert {(x.period, x.filings) for x in totals.totals().collect()} == {("2024-01", 2), ("2024-02", 0), ("2024-05", 1)}
    assert totals.beyond_cut_off().collect() == []
    once = late_ops.totals(late_ops.deltas(late_ops.versions(late_ops.facts(spark.createDataFrame([r for b in batches for r in b], schema)))))
    assert {(x.period, x.filings) for x in once.collect()} == {("2024-01", 2), ("2024-02", 0)}
