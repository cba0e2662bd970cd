"""Statements: amendments, predicates, flattening, quantiles, sinks that refuse or claim."""

import datetime as dt
import json
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.functions import predicates as P
from tidemark.operators import fold, quantiles, resolve, rolling
from tidemark.sinks import snapshot, storage
from tidemark.sources import files, ownership, records

SCHEMA = "revision_id string, transaction_id string, issuer string, owner string, table_type string, row_sequence int, accession string, content_hash string, is_amendment boolean, supersedes string, amends_accession string, known_at timestamp_ntz, recorded_at timestamp_ntz, valid_from timestamp_ntz, problem string"


def t(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(day)


def row(rev, accession, day, amends=False, supersedes=None, of=None, issuer="i", owner="o", seq=1, content=None, valid=None):
    return (rev, f"tx-{rev}", issuer, owner, "N", seq, accession, content or rev, amends, supersedes, of, t(day), t(day), t(valid if valid is not None else day), "")


def resolved(spark, rows, **kw):
    return resolve.resolve_revisions(spark.createDataFrame(rows, SCHEMA), **kw).collect()


def test_amendment_chain_by_accession_and_revision(spark):
    rows = [row("r1", "a1", 0), row("r2", "a2", 5, True, of="a1"), row("r2x", "a2", 6, True, of="a1", content="r2"), row("r9", "b1", 1, seq=2)]
    got = {x.accession: x for x in resolved(spark, rows) if x.problem is None}
    assert len(got) == 3 and (got["a1"].status, got["a1"].valid_to, got["a1"].revision) == ("SUPERSEDED", t(5), 0)
    assert (got["a2"].status, got["a2"].revision, got["a2"].transaction_id, got["a2"].supersedes) == ("ACTIVE", 1, "tx-r1", "r1")
    again = [*rows, row("r3", "a3", 9, True, supersedes=got["a2"].revision_id)]
    got = {x.accession: x for x in resolved(spark, again)}
    assert got["a3"].revision == 2 and got["a2"].status == "SUPERSEDED" and got["a3"].transaction_id == "tx-r1"
    early = {x.accession: x.status for x in resolved(spark, again, as_of=F.lit(t(5)).cast("timestamp_ntz"))}
    assert early == {"a1": "SUPERSEDED", "a2": "ACTIVE", "b1": "ACTIVE"}


def test_amendments_set_aside(spark):
    rows = [
        row("r1", "a1", 0), row("other", "z1", 0, owner="p"), row("m1", "m1", 0, seq=4), row("m2", "m1", 1, seq=4, content="m2"), row("late", "l1", 3, seq=5, valid=9),
        row("unknown", "a2", 1, True, of="nowhere"), row("lost", "a3", 1, True, supersedes="nobody"), row("mismatch", "a4", 2, True, supersedes="other"), row("link", "a5", 2, True, supersedes="r1", of="a9"),
        row("fine", "a6", 3, True, of="a1"), row("fork", "a7", 4, True, of="a1"), row("ambiguous", "m3", 5, True, of="m1", seq=4), row("too early", "l2", 4, True, of="l1", seq=5),
        (None, "x", "i", "o", "N", 1, "a", "c", True, None, None, t(0), t(0), t(0), ""),
    ]
    got = {x.transaction_id.removeprefix("tx-"): x.problem for x in resolved(spark, rows) if x.problem}
    assert got == {"unknown": "UNRESOLVED_AMENDMENT", "lost": "UNRESOLVED_AMENDMENT", "mismatch": "AMENDMENT_IDENTITY_MISMATCH", "link": "AMENDMENT_LINK_CONFLICT", "fork": "AMENDMENT_CHAIN_FORK", "ambiguous": "AMBIGUOUS_AMENDMENT", "too early": "AMENDMENT_TIME_CONFLICT", "x": "NO_KEY"}
    assert resolved(spark, []) == []
    assert len(resolved(spark, rows + rows)) == len(rows) + 1  # repeated content is one; rows without key are kept apart


def test_in_force_and_sides(spark):
    rows = [("ACTIVE", 0, None), (None, None, None), ("VOID", 0, None), ("SUPERSEDED", 0, None), ("Status.SUPERSEDED", 0, 9), ("SUPERSEDED", 0, 4), ("ACTIVE", 6, None), ("ACTIVE", 0, 5), ("DRAFT", None, None)]
    df = spark.createDataFrame([(s, a, b) for s, a, b in rows], "s string, a int, b int")
    got = [x[0] for x in df.select(P.in_force(F.col("s"), F.col("a"), F.col("b"), F.lit(5))).collect()]
    assert got == [True, True, False, False, True, False, False, False, False]
    sides = [("P", "A", None, None), ("P", "D", None, None), (None, None, "OPEN_MARKET_PURCHASE", None), ("X", "", None, "OPEN_MARKET_SALE"), ("S", "D", "OTHER", None), (None, None, None, None)]
    df = spark.createDataFrame(sides, "c string, ad string, k string, e string")
    cols = [F.col(c) for c in ("c", "ad", "k", "e")]
    assert [tuple(x) for x in df.select(P.purchase(*cols), P.sale(*cols)).collect()] == [(True, False), (False, False), (True, False), (False, True), (False, True), (False, False)]


def test_codes_and_economic_classes(spark):
    df = spark.createDataFrame([(c, a) for c in ("P", " t", "X", "A", "C", None) for a in ("A", "D")], "c string, a string")
    k = ownership.classification(F.col("c"))
    got = {(x[0], x[1]): (x[2], x[3]) for x in df.select("c", "a", k, ownership.economic_classification(k, F.col("a"))).collect()}
    assert got["P", "D"] == ("OPEN_MARKET_PURCHASE",) * 2 and got[" t", "A"] == ("TRANSFER", "OTHER_ACQUISITION") and got["X", "D"] == ("TRANSFER", "OTHER_DISPOSITION")
    assert got["A", "A"] == ("AWARD", "GRANT_AWARD") and got["C", "A"] == ("OTHER", "OTHER_ACQUISITION") and got[None, "D"] == ("OTHER", "OTHER_DISPOSITION")


def test_flat_rows_of_any_spelling(spark):
    a = spark.createDataFrame([(1, ("42",), ("p", "a", "x", 3.0, 2.0))], "row_id int, issuer struct<cik:string>, transaction struct<code:string,acquiredDisposed:string,value:string,shares:double,pricePerShare:double>")
    (got,) = records.flat_transactions(a, ["row_id"]).collect()
    assert (got.row_id, got.issuer_cik, got.owner_cik, got.code, got.acquired_disposed, got.value_usd, got.table_type, got.lifecycle_status) == (1, "42", "", "P", "A", 6.0, "NON_DERIVATIVE", "ACTIVE")
    b = spark.createDataFrame([("7", "S", None, 5.0)], "issuer string, transaction_code string, status string, value_usd double")
    (got,) = records.flat_transactions(b).collect()
    assert (got.issuer_cik, got.code, got.lifecycle_status, got.value_usd, got.valid_to) == ("7", "S", "ACTIVE", 5.0, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_like_numpy(spark, seed):
    r = random.Random(seed)
    groups = {"a": [r.gauss(0, 0.1) for _ in range(997)], "b": [0.0] * 300 + [r.choice([-1.5, 0.25, 1e9, -1e-9]) for _ in range(40)], "c": [3.0], None: [1.0, 2.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("d", None), ("c", float("nan"))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x.k: x for x in quantiles.quantiles(df, ["k"], "v", {"p10": 0.1, "median": 0.5, "top": 1.0}).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.allclose([got[k].p10, got[k].median, got[k].top], np.quantile(vs, [0.1, 0.5, 1.0]), rtol=1e-12, atol=1e-15)
    trimmed = {x.k: x for x in quantiles.trimmed_means(df, ["k"], "v", 0.05).collect()}
    for k, vs in groups.items():
        cut = int(len(vs) * 0.05)
        kept = sorted(vs)[cut : len(vs) - cut]
        assert trimmed[k].kept == len(kept) and np.isclose(trimmed[k].trimmed_mean, np.mean(kept), rtol=1e-9, atol=1e-12)
    ids = df.withColumn("id", F.monotonically_increasing_id())
    top = quantiles.top_rows(ids, ["k"], "v", F.floor(F.col("n") * 0.3), ["id"]).collect()
    for k, vs in groups.items():
        assert sorted(x.v for x in top if x.k == k) == sorted(sorted(vs, reverse=True)[: int(len(vs) * 0.3)])
    assert quantiles.quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == quantiles.trimmed_means(df.limit(0), ["k"], "v", 0.1).count() == 0


def test_ordered_index(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("x"))
    got = rolling.ordered_index(df, ["x"], "i").collect()
    assert sorted((x.x, x.i) for x in got) == [(k, k) for k in range(500)]


def test_cooldown_with_override(spark):
    steps = [(0, 50.0), (5, 60.0), (9, 95.0), (20, 90.0), (23, 91.0)]
    df = spark.createDataFrame([(steps,), ([],)], "s array<struct<day:int,score:double>>")
    got = [x[0] for x in df.select(fold.cooldown(F.col("s"), 14, 40.0)).collect()]
    assert (got[0].kept, got[0].overridden) == (3, 1) and got[1].kept == 0


def test_batches_are_refused_as_a_whole(spark, tmp_path):
    good = {"records": [{"a": 1}], "quarantines": [], "failures": [], "complete": True}
    (tmp_path / "good.json").write_text(json.dumps(good) + "\n" + json.dumps(good))
    assert files.batch_envelope(spark, str(tmp_path / "good.json"), "a bigint").count() == 2
    for name, bad in {"q": {**good, "quarantines": ["x"]}, "f": {**good, "failures": ["x"]}, "i": {**good, "complete": False}}.items():
        (tmp_path / name).write_text(json.dumps(good) + "\n" + json.dumps(bad))
        with pytest.raises(files.RefusedBatch):
            files.batch_envelope(spark, str(tmp_path / name), "a bigint")
    (tmp_path / "broken").write_text(json.dumps(good)[:-5])
    with pytest.raises(files.RefusedBatch):
        files.batch_envelope(spark, str(tmp_path / "broken"), "a bigint")


def test_snapshots_refuse_what_was_not_written(spark, tmp_path):
    df, folder = spark.createDataFrame([(1, "a")], "i int, s string"), str(tmp_path / "s")
    snapshot.write_snapshot({"t": df}, folder, "r1")
    df.withColumn("i", F.lit(2)).write.mode("overwrite").parquet(f"{folder}/r1/t")
    with pytest.raises(snapshot.SnapshotConflict, match="content"):
        snapshot.read_snapshot(spark, folder)
    df.write.mode("overwrite").parquet(f"{folder}/r1/t")
    assert snapshot.read_snapshot(spark, folder)["t"].count() == 1
    df.write.parquet(f"{folder}/r1/stray")
    with pytest.raises(snapshot.SnapshotConflict, match="other files"):
        snapshot.read_snapshot(spark, folder)
    for name in ("../x", "a/b", "", ".hidden", "a..b"):
        with pytest.raises(ValueError):
            storage.checked_name(name)


def test_at_most_once(spark, tmp_path):
    sent, path = [], str(tmp_path / "claims")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")

    def failing(rows):
        sent.extend(x.k for x in rows.collect())
        raise OSError("no line")

    with pytest.raises(OSError):
        snapshot.deliver_at_most_once(df, path, "k", spark, 0, failing)
    assert not snapshot.deliver_at_most_once(df, path, "k", spark, 0, failing)  # claimed: never again
    assert snapshot.deliver_at_most_once(spark.createDataFrame([(2, "b"), (3, "d")], df.schema), path, "k", spark, 1, lambda rows: sent.extend(x.k for x in rows.collect()))
    assert sorted(sent) == [1, 2, 3]


def test_merged_observations(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, "x"), ("a", 2, None), ("b", 1, None)]
    got = {(x.k, x.at): (x.v, x.conflict) for x in resolve.merged_observations(spark.createDataFrame(rows, "k string, at int, v string"), ["k", "at"], ["v"]).collect()}
    assert got == {("a", 1): ("x", False), ("a", 2): (None, True), ("b", 1): (None, False)}


def test_overlay_by_whole_key(spark):
    base = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 1, None), (None, 1, 9.0)], "a int, b int, v double")
    over = spark.createDataFrame([(1, 1, 50.0, "x"), (1, 2, None, "x"), (3, 1, 7.0, "x"), (None, 1, 1.0, "x")], "a int, b int, c double, v string")
    from tidemark.operators import checks

    got = {(x.a, x.b): (x.v, x.origin) for x in checks.overlay(base, over, ["a", "b"], "v", "c").collect()}
    assert got == {(1, 1): (50.0, "OVERLAY"), (1, 2): (6.0, "WITHDRAWN"), (2, 1): (None, "BASE"), (None, 1): (9.0, "BASE")}
    assert {(x.a, x.b, x.side) for x in checks.scope_difference(base, over, ["a", "b"]).collect()} == {(2, 1, "left"), (3, 1, "right")}
    assert checks.overlay(base.limit(0), over, ["a", "b"], "v", "c").count() == 0


def test_zoned_dates(spark):
    from tidemark.functions import normal as N

    rows = ["2024-01-02", "2024-01-02Z", "2024-01-02-05:00", "2024-01-02 05:00", "2024-13-02Z", " 2024-01-02", "", None]
    got = [x[0] for x in spark.createDataFrame([(r,) for r in rows], "s string").select(N.zoned_date(F.col("s"))).collect()]
    assert got == [dt.date(2024, 1, 2)] * 3 + [None] * 5


def test_day_checkpoints_name_their_content(spark):
    from tidemark.operators import checks

    rows = [("d1", "a", True), ("d1", "b", False), ("d2", "c", True)]
    f = lambda r: {x.d: x for x in checks.day_checkpoints(spark.createDataFrame(r, "d string, k string, s boolean"), "d", "k", "s").collect()}
    one, two = f(rows), f(rows[::-1])
    assert (one["d1"].discovered, one["d1"].stored, one["d1"].failed, one["d1"].complete, one["d2"].complete) == (2, 1, 1, False, True)
    assert one["d1"].name == two["d1"].name and f([("d1", "a", True), ("d1", "b", True)])["d1"].name != one["d1"].name


def test_distinct_members_like_brute_force(spark):
    from tidemark.operators import overlap

    r = random.Random(6)
    rows = [(r.choice("ab"), r.choice(["p", "q", "r", None]), r.choice([0, 1, 5, 30, 31, 32, 61, 62, 63, 95, 200, None])) for _ in range(120)]
    df = spark.createDataFrame([(k, m, None if n is None else dt.date(2024, 1, 1) + dt.timedelta(n), 0) for k, m, n in rows], "k string, m string, d date, members int")
    got = {(x.k, (x.d - dt.date(2024, 1, 1)).days): x.members for x in overlap.distinct_in_span(df, "k", "m", "d", 30).collect()}
    known = {(k, m, n) for k, m, n in rows if m is not None and n is not None}
    assert got == {(k, n): len({m for j, m, o in known if j == k and n - 30 <= o <= n}) for k, _, n in known}
    assert overlap.distinct_in_span(df.limit(0), "k", "m", "d", 30).count() == 0


def test_packed_files_are_named_by_content():
    name, packed = snapshot.pack(b"content" * 100)
    assert (name, packed) == snapshot.pack(b"content" * 100) and snapshot.unpack(name, packed) == b"content" * 100
    with pytest.raises(snapshot.SnapshotConflict):
        snapshot.unpack(name, snapshot.pack(b"other")[1])


def test_input_manifest(spark, tmp_path):
    import hashlib

    store = storage.Storage(spark, str(tmp_path))
    store.write("a/b.json", b"{}")
    good = {"as_of": "2024-07-01T20:00:00+00:00", "inputs": [{"path": "a/b.json", "sha256": hashlib.sha256(b"{}").hexdigest()}]}
    snapshot.check_input_manifest(store, good)
    snapshot.check_input_manifest(store, {**good, "as_of": "2024-01-02T21:00:00+00:00"})
    bad = [{**good, "as_of": "2024-07-01T21:00:00+00:00"}, {**good, "inputs": good["inputs"] * 2}, {**good, "inputs": [{"path": "a", "sha256": ""}, *good["inputs"]]}, {**good, "inputs": [{"path": "../b", "sha256": ""}]}]
    for manifest in bad:
        with pytest.raises(ValueError):
            snapshot.check_input_manifest(store, manifest)
    store.write("a/b.json", b"[]")
    with pytest.raises(snapshot.SnapshotConflict):
        snapshot.check_input_manifest(store, good)
