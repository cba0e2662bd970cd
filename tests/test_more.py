"""Overlaps, scores, bootstrap intervals, range frames over a calendar, spacing in a stream."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.functions import windows as Wf
from tidemark.operators import bootstrap, market, overlap, study
from tidemark.streaming import run, stateful

D0 = dt.date(2024, 1, 1)


def day(k):
    return D0 + dt.timedelta(k)


def test_points_in_intervals_like_brute_force(spark):
    r = random.Random(2)
    points = [(r.choice(["a", "b", None]), r.choice([None, *map(day, range(300))]), i) for i in range(120)]
    spans = [(r.choice(["a", "b", None]), *r.choices([None, *map(day, range(300))], k=2), i) for i in range(60)]
    p, s = spark.createDataFrame(points, "k string, at date, i int"), spark.createDataFrame(spans, "k string, a date, b date, j int")
    got = {(x.i, x.j) for x in overlap.points_in_intervals(p, s, "k", "at", "a", "b", 16).collect()}
    assert got == {(i, j) for k, at, i in points for q, a, b, j in spans if k and k == q and at and a and b and a < at <= b}
    assert overlap.points_in_intervals(p.limit(0), s, "k", "at", "a", "b").count() == 0


def test_weighted_score(spark):
    df = spark.createDataFrame([(100.0, 50.0, 0.0), (100.0, None, 0.0), (None, None, None)], "a double, b double, c double")
    got = [x[0] for x in df.select(scores.weighted_score({"a": 0.5, "b": 0.3, "c": 0.2})).collect()]
    assert got[0] == pytest.approx(65.0) and got[1] == pytest.approx(50 / 0.7) and got[2] is None
    assert [x[0] for x in df.select(scores.clamp(F.col("a"), 0.0, 60.0)).collect()] == [60.0, 60.0, None]


def test_bootstrap_interval(spark):
    rows = spark.range(2000, numPartitions=3).select(F.lit("g").alias("g"), (F.col("id") % 100).cast("double").alias("x"), "id")
    one = bootstrap.poisson_bootstrap_mean(rows, ["g"], "x", ["id"]).collect()[0]
    two = bootstrap.poisson_bootstrap_mean(rows.repartition(7), ["g"], "x", ["id"]).collect()[0]
    assert (one.n, one.mean) == (2000, 49.5) and (one.low, one.high) == (two.low, two.high)
    error = 28.87 / 2000**0.5
    assert 1.2 * error < 49.5 - one.low < 2.9 * error and 1.2 * error < one.high - 49.5 < 2.9 * error
    assert bootstrap.poisson_bootstrap_mean(rows.limit(0), ["g"], "x", ["id"]).count() == 0


def test_forward_outcomes_need_exact_sessions(spark):
    rows = [("a", i, 10.0 + i, 9.0, 10.0 + i) for i in (0, 1, 2, 3, 5)]
    b = spark.createDataFrame(rows, "symbol string, session_idx long, open double, low double, close double")
    got = {x.session_idx: x for x in study.forward_outcomes(b, (2,)).collect()}
    assert got[0].forward_return == pytest.approx(13 / 11 - 1) and got[0].worst == pytest.approx(9 / 11 - 1)
    assert got[1].forward_return is None and got[2].forward_return == pytest.approx(15 / 13 - 1) and got[2].worst is None
    assert got[3].forward_return is None


def test_later_rows_change_nothing_earlier(spark):
    r = random.Random(1)
    rows = [("s", day(i), 10 + r.random(), 12.0, 9.0, 10 + r.random(), 10 + r.random(), float(r.randint(1, 9)), True) for i in range(120)]
    schema = "symbol string, date date, open double, high double, low double, close double, adj_close double, volume double, is_adjusted boolean"
    all_, first = (market.price_features(spark.createDataFrame(x, schema)) for x in (rows, rows[:90]))
    assert all_.filter(F.col("date") < day(90)).orderBy("date").collect() == first.orderBy("date").collect()


def test_midrank(spark):
    df = spark.createDataFrame([(2.0, [1.0, 2.0, 2.0, 3.0]), (2.0, []), (None, [1.0])], "v double, h array<double>")
    assert [x[0] for x in df.select(Wf.percentile_midrank(F.col("v"), F.col("h"), 1)).collect()] == [50.0, 50.0, None]


def test_spacing_in_a_stream(spark, tmp_path):
    times = [0, 5, 9, 10, 19, 21, None]
    rows = [("a", None if t is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)) for t in times] + [(None, dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, "k string, at timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    s = stateful.spaced(run.file_stream(spark, str(tmp_path), "t"), "k", "at", 10)
    got = [x["at"] for x in run.to_table(s, "append").collect()]
    assert [t - min(got) for t in sorted(got)] == [0, 10, 21]


def test_amendment_chains(spark):
    from tidemark.operators import resolve

    rows = [("k", 1, "o1", False), ("k", 3, "a1", True), ("k", 3, "a1", True), ("k", 5, "a2", True), ("k", 7, "o2", False), ("j", 1, "x", True), ("i", 1, "o", False), ("i", 2, "p", True), ("i", 2, "q", True), (None, 1, "n", True), ("h", None, "t", False)]
    df = spark.createDataFrame(rows, "link string, at int, id string, amends boolean")
    got = {x.id: (x.revision, x.replaces, x.valid_to, x.problem) for x in resolve.amendments(df, ["link"], "at", "id", F.col("amends")).collect()}
    assert got == {
        "o1": (0, None, 3, None), "a1": (1, "o1", 5, None), "a2": (2, "a1", None, None), "o2": (0, None, None, None), "x": (None, None, None, "NO_PREDECESSOR"), "o": (0, None, None, None),
        "p": (None, None, None, "AMBIGUOUS"), "q": (None, None, None, "AMBIGUOUS"), "n": (None, None, None, "NO_KEY"), "t": (None, None, None, "NO_KEY"),
    }
