"""Jobs that queries once did in part: each test fails on the part alone."""

import datetime as dt
import random

import numpy as np

from pyspark.sql import functions as F

from tidemark.operators import bootstrap, overlap, rolling

D0 = dt.date(2024, 1, 1)


def day(k):
    return D0 + dt.timedelta(k)


def reference_triggers(rows, days, least, strong):
    """The rule as told in words: all anchors of each session, in order of disclosure."""
    out = set()
    for issuer, session in {(r[0], r[3]) for r in rows}:
        known = sorted((r for r in rows if r[0] == issuer and r[3] <= session), key=lambda r: (r[3], r[4], r[5]))
        best = None
        for anchor in (r[2] for r in known):
            inside = [r for r in known if anchor - dt.timedelta(days) <= r[2] <= anchor]
            owners = len({r[1] for r in inside})
            if any(r[3] == session for r in inside) and (best is None or owners > best[0]):
                best = owners, anchor
        if best and best[0] >= least:
            out.add((issuer, session, best[0], best[1], best[0] >= strong))
    return out


def test_cluster_triggers_look_at_trading_days_known_by_the_session(spark):
    r = random.Random(3)
    # a late filing completes an old window; three old trades of distant days are disclosed together
    rows = [("late", 1, day(100), day(101)), ("late", 2, day(110), day(111)), ("late", 3, day(105), day(300))]
    rows += [("apart", k, day(100 * k), day(400)) for k in (1, 2, 3)]
    rows += [(r.choice("abc"), r.randrange(6), day(t := r.randrange(200)), day(t + r.choice([0, 1, 2, 60, 150]))) for _ in range(150)]
    rows = [(*x, i, 1) for i, x in enumerate(rows)]
    df = spark.createDataFrame(rows, "issuer string, owner int, tx_date date, known_date date, accession int, line int")
    got = {(x.issuer, x.session, x.owners, x.anchor, x.strong) for x in overlap.cluster_triggers(df, 30, 2, 3).collect()}
    assert got == reference_triggers(rows, 30, 2, 3)
    assert ("late", day(300), 3, day(110), True) in got and not any(x[0] == "apart" for x in got)


def test_barometer_counts_what_is_known_by_each_day(spark):
    r = random.Random(5)
    rows = [("a", "P", day(0), day(10), 5.0), ("a", "P", day(1), day(40), 7.0), ("b", "S", day(3), day(2), 2.0), ("b", "P", day(5), day(20), None), ("c", "G", day(0), day(0), 1.0), ("c", "P", day(8), None, 1.0)]
    rows += [(r.choice("abcde"), r.choice("PS"), day(t := r.randrange(40, 160)), day(t + r.choice([-3, 0, 1, 20, 29, 30, 90])), r.choice([1.25, 3.1, 10.0] * 5 + [-1.0, None])) for _ in range(120)]
    df = spark.createDataFrame(rows, "issuer string, code string, tx_date date, known_date date, value double")
    got = {x.day: x for x in rolling.barometer(df, 30, {"P": "buy", "S": "sale"}).collect()}
    used = [x for x in rows if x[1] in "PS" and x[3]]
    first, last = min(x[2] for x in used), max(max(x[2], x[3]) for x in used)
    assert sorted(got) == [first + dt.timedelta(k) for k in range((last - first).days + 1)]
    for at, x in got.items():
        inside = [y for y in used if at - dt.timedelta(29) <= y[2] <= at and y[3] <= at]
        buys, sales = ([y for y in inside if y[1] == c] for c in "PS")
        dollars = [None if any(y[4] is None or y[4] < 0 for y in side) else sum(y[4] for y in side) for side in (buys, sales)]
        assert (x.purchases_30d, x.sales_30d) == (len(buys), len(sales))
        assert [None if v is None else round(v, 6) for v in (x.buy_dollars, x.sale_dollars)] == [None if v is None else round(v, 6) for v in dollars]
        assert (x.buying_companies, x.selling_companies, x.active_companies) == tuple(len({y[0] for y in side}) for side in (buys, sales, inside))
        assert (x.ratio is None) == (not sales) and (x.dollar_ratio is None) == (None in dollars or not dollars[1])
    assert got[day(9)].purchases_30d == 0 and got[day(10)].purchases_30d == 1
    assert rolling.barometer(df.limit(0), 30, {"P": "buy", "S": "sale"}).count() == 0


def test_republished_filings_in_any_spelling_and_by_content(spark):
    from tidemark.plans.research import _republished

    def xml(shares, layout=""):
        return f"<ownershipDocument>{layout}<documentType>4</documentType><issuer><issuerCik>0000000007</issuerCik></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>0000000009</rptOwnerCik></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>0</isOfficer></reportingOwnerRelationship></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-01-05</value></transactionDate><transactionAmounts><transactionShares><value>{shares}</value></transactionShares></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"

    json_ = '{"issuer": {"issuerCik": "7"}, "reportingOwner": [{"reportingOwnerId": {"rptOwnerCik": "9"}, "reportingOwnerRelationship": {"isDirector": true}}], "nonDerivativeTable": {"nonDerivativeTransaction": {"transactionDate": "2024-01-05", "transactionAmounts": {"transactionShares": 100}}}}'
    at = lambda k: dt.datetime(2024, 1, k, 12)
    rows = [
        (1, "000000000124000001", "row-000001", "4", at(9), xml(100)), (2, "0000000001-24-000001", "x/0000000001-24-000001.txt", "4 ", at(3), json_), (3, None, "a/0000000001-24-000001.txt", "4", at(9), xml("100.0", "\n ")),
        (4, "0000000001-24-000002", "row-1", "4", at(5), xml(100)), (5, "000000000124000002", "row-2", "4", at(6), xml(200)),
        (6, "0000000001-24-000003", "row-3", "4", at(5), xml(100)), (7, "0000000001-24-000003", "row-3", "4/A", at(5), None), (8, "0000000001-24-000003", "row-3", "4", at(5), "<ownershipDocument><issuer>"),
        (9, None, "row-4", "4", at(5), xml(1)),
    ]
    raw = spark.createDataFrame([(*r[:5], r[5] and r[5].encode()) for r in rows], "delivery_id long, accession_number string, provider_record_id string, form_type string, retrieved_at timestamp_ntz, payload binary")
    got = {x.accession[-1]: (x.first_day.day, x.days, x.deliveries, x.form_conflict, x.content_conflict, x.conflicting) for x in _republished(raw).collect()}
    assert got == {"1": (3, 2, 3, False, False, False), "2": (5, 2, 2, False, True, True), "3": (5, 1, 3, True, False, True)}


def test_bootstrap_intervals_are_of_medians(spark):
    rng = np.random.default_rng(1)
    x = {"odd": np.round(np.exp(rng.normal(0, 2, 401)), 2), "even": np.exp(rng.normal(1, 2, 300)), "one": np.array([3.0]), "two": np.array([0.0, 1.0]), "ties": np.repeat([1.0, 2.0, 5.0], [3, 4, 2])}
    rows = [(g, float(v)) for g, vs in x.items() for v in vs] + [("none", None), ("none", float("nan")), ("odd", float("inf"))]
    df = spark.createDataFrame(rows, "g string, x double")
    drawn = bootstrap.medians(df, ["g"], "x").collect()
    assert drawn and sorted(drawn) == sorted(bootstrap.medians(df.repartition(7), ["g"], "x").collect())
    got = {y.g: y for y in bootstrap.median_intervals(spark.createDataFrame(drawn, "g string, n long, median double, draws array<double>")).collect()}
    draws = {y.g: y.draws for y in drawn}
    assert (got["none"].n, got["none"].median, got["none"].low) == (0, None, None)
    assert (got["one"].median, got["one"].low, got["one"].high) == (3.0, 3.0, 3.0)
    for g in set(x) - {"one"}:
        plain = np.median(rng.choice(x[g], (20000, len(x[g]))), axis=1)
        assert got[g].n == len(x[g]) and got[g].median == np.median(x[g]) and len(draws[g]) == 2000
        assert [got[g].low, got[g].high] == list(np.quantile(draws[g], [0.025, 0.975])) or np.allclose([got[g].low, got[g].high], np.quantile(draws[g], [0.025, 0.975]))
        for v in np.quantile(plain, [0.05, 0.3, 0.6, 0.9]):  # the same distribution, within the error of 2,000 draws
            assert abs((np.array(draws[g]) <= v).mean() - (plain <= v).mean()) < 0.05
    pair = spark.createDataFrame([(got["odd"].median, draws["odd"], got["even"].median, draws["even"])], "a double, x array<double>, b double, y array<double>")
    one = pair.select(*bootstrap.median_difference(F.col("a"), F.col("x"), F.col("b"), F.col("y"))).collect()[0]
    plain = np.median(rng.choice(x["odd"], (20000, 401)), axis=1) - np.median(rng.choice(x["even"], (20000, 300)), axis=1)
    assert one[0] == got["odd"].median - got["even"].median and np.allclose(one[1:], np.quantile(plain, [0.025, 0.975]), atol=0.25)
    assert bootstrap.medians(df.limit(0), ["g"], "x").count() == 0


def test_filings_of_several_owners(spark):
    r = random.Random(7)
    sets = {(i, a): set(r.sample("pqrst", r.choice([1, 1, 2, 3]))) for i in "xyz" for a in range(12)}
    days = {k: day(r.randrange(60)) for k in sets}
    rows = [(i, a, o, days[i, a]) for (i, a), s in sets.items() for o in s for _ in range(r.choice([1, 2]))]
    df = spark.createDataFrame(rows, "issuer string, accession int, owner string, tx_date date")
    got = {(x.issuer, x.accession): x.independent for x in overlap.disjoint_filings(df).collect()}
    assert got == {(i, a): sum(j == i and b != a and not s & t for (j, b), t in sets.items()) for (i, a), s in sets.items()}
    got = {(x.issuer, x.accession): x.candidates for x in overlap.including_filings(df).collect()}
    month = lambda k: days[k].replace(day=1)
    assert got == {(i, a): sum(j == i and b < a and month((j, b)) == month((i, a)) and t >= s for (j, b), t in sets.items()) for (i, a), s in sets.items()}
    assert any(len(s) > 1 for s in sets.values()) and max(got.values()) > 0


def test_outliers_are_looked_for_until_none_is_left(monkeypatch):
    from tidemark.operators import spikes

    g = np.random.default_rng(2960)
    n, size = int(g.integers(30, 200)), 0.01
    x = np.cumsum(g.normal(0, size, n)) + g.normal(0, size, n)
    k = int(g.integers(5, n // 2))
    at = g.choice(n, k, False)
    x[at] += size * 1.2 ** g.uniform(0, 12, k) * g.choice([-1, 1], k)
    rounds, median = [], spikes.running_median
    monkeypatch.setattr(spikes, "running_median", lambda y, half: rounds.append(1) or median(y, half))
    found = spikes.phase_space_outliers(x, 4, 0.6, 0.0)[0]
    assert len(rounds) > 8  # it went on beyond any fixed number of rounds
    y = np.where(found, np.nan, x)
    y = np.interp(np.arange(n), np.flatnonzero(~found), x[~found])
    u = y - median(y, 4)
    assert found.sum() > 10 and np.abs(u).max() <= 0.6 * np.sqrt(2 * np.log(n)) * spikes._scale(u) * 1.5


def test_positional_join_of_sides_that_differ(spark):
    schema = "symbol string, pos int, {0} struct<date:date,close:double>"
    left = spark.createDataFrame([("a", 1, (day(1), 1.0)), ("a", 2, (day(2), 2.0)), ("a", 3, (day(4), 3.0)), ("b", 1, (day(1), 1.0))], schema.format("l"))
    right = spark.createDataFrame([("a", 1, (day(1), 1.0)), ("a", 2, (day(2), 2.5)), ("a", 3, (day(3), 3.0)), ("a", 4, (day(4), 3.0)), ("b", 1, (day(1), 1.0))], schema.format("r"))
    got = {x.symbol: (x.rows, x.other_day, x.other_close, x.alone) for x in overlap.positional(left, right).collect()}
    assert got == {"a": (4, 1, 1, 1), "b": (1, 0, 0, 0)}


def test_user_snapshots_have_a_row_per_user(spark, tmp_path):
    from tidemark.plans.identity import user_changes

    early, late = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 20)
    rows = [(u, early, u, "view") for u in range(1200)] + [(2000 + u, late, u, "view") for u in range(0, 1200, 2)] + [(5000, late, 1500, "view"), (5001, early, 1600, "click")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = {x.user_id: x.change for x in user_changes(spark, str(tmp_path)).collect()}
    assert got == {**{u: "CHANGED" for u in range(0, 1200, 2)}, 1500: "ADDED", 1600: "REMOVED"}
