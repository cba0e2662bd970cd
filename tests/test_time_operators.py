"""As-of attributes, late events, deduplication, histories, rolling totals: against plain Python, with what data can do."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from tidemark.operators import asof, dedup, fold, history, late, rolling

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id string, entity string, t timestamp_ntz"
INTERVALS = "entity string, interval_id long, valid_from date, valid_to date, knowledge_at timestamp_ntz, bucket string"


def brute_asof(events, intervals):
    out = {}
    for e, entity, t in events:
        fit = [i for i in intervals if entity is not None and t is not None and i[0] == entity and (i[2] is None or i[2] <= t.date()) and (i[3] is None or t.date() < i[3]) and (i[4] is None or i[4] <= t)]
        best = max(fit, key=lambda i: (i[2] or dt.date.min, i[4] or dt.datetime.min, i[1]), default=None)
        out[e, entity, t] = best and best[1]
    return out


@pytest.mark.parametrize("seed,per_bucket", [(1, 1000), (2, 7), (3, 20)])
def test_asof_like_brute_force(spark, seed, per_bucket):
    r = random.Random(seed)
    entity = lambda: r.choice(["a"] * 6 + ["b", "c", "d", None])
    day = lambda: None if r.random() < 0.15 else T0.date() + dt.timedelta(r.randint(0, 30))
    time = lambda: None if r.random() < 0.1 else T0 + dt.timedelta(hours=r.randint(0, 800))
    events = [(f"e{k}", entity(), time()) for k in range(150)]
    events += events[:20]
    intervals = [(entity(), k, day(), day(), time(), "x") for k in range(60)]
    intervals += intervals[:5]
    got = asof.asof_attributes(spark.createDataFrame(events, EVENTS), spark.createDataFrame(intervals, INTERVALS), per_bucket).collect()
    assert {(x.event_id, x.entity, x.t): x.interval_id for x in got} == brute_asof(events, intervals)
    assert len(got) == len(set(events))


def test_asof_future_rows_change_nothing(spark):
    events = spark.createDataFrame([("e", "a", T0)], EVENTS)
    old = [("a", 1, None, None, T0 - dt.timedelta(1), "")]
    new = old + [("a", 2, None, None, T0 + dt.timedelta(microseconds=1), "")]
    for rows in (old, new):
        assert [x.interval_id for x in asof.asof_attributes(events, spark.createDataFrame(rows, INTERVALS)).collect()] == [1]


def test_asof_empty_sides(spark):
    none, some = spark.createDataFrame([], EVENTS), spark.createDataFrame([("e", "a", T0)], EVENTS)
    nothing = spark.createDataFrame([], INTERVALS)
    assert asof.asof_attributes(none, nothing).count() == 0
    assert [x.interval_id for x in asof.asof_attributes(some, nothing).collect()] == [None]


def test_asof_hot_entity_and_hot_event(spark):
    """An entity with most rows goes through many buckets, and so do copies of one event; each event comes out once."""
    events = spark.range(3000).select(
        F.when(F.col("id") < 1200, F.lit("same")).otherwise(F.col("id").cast("string")).alias("event_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("entity"),
        F.when(F.col("id") < 1200, F.lit(T0)).otherwise(F.timestamp_add("HOUR", F.col("id") % 50, F.lit(T0))).cast("timestamp_ntz").alias("t"),
    )
    intervals = spark.createDataFrame([("hot", 1, None, dt.date(2024, 1, 2), None, ""), ("hot", 2, dt.date(2024, 1, 2), None, None, "")], INTERVALS)
    for ways in (1, 5):
        got = asof.asof_attributes(events, intervals, 100, ways)
        assert got.count() == 1802 and got.distinct().count() == 1802
        counts = {x.interval_id: x["count"] for x in got.groupBy("interval_id").count().collect()}
        want = {1: 0, 2: 0, None: 0}
        for e, entity, t in {(x.event_id, x.entity, x.t) for x in events.collect()}:
            want[None if entity is None else 1 if t < T0 + dt.timedelta(1) else 2] += 1
        assert counts == want


def test_asof_reads_events_once(spark, tmp_path):
    spark.createDataFrame([("e", "a", T0)], EVENTS).write.parquet(str(tmp_path / "e"))
    plan = asof.asof_attributes(spark.read.parquet(str(tmp_path / "e")), spark.createDataFrame([], INTERVALS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_late_lists_and_totals_come_from_deltas(spark):
    """A key that moves from one late month to another is retracted from the first list; without its deltas it is in none."""
    rows = [("k", dt.date(2023, 1, 5), T0, T0, 1)]
    later = [("k", None, dt.datetime(2022, 5, 1), dt.datetime(2023, 12, 1), 2)]
    v = late.versions(late.facts(spark.createDataFrame(rows + later, "key string, stated_day date, accepted_at timestamp_ntz, arrived_at timestamp_ntz, record_id long")))
    d = late.deltas(v)
    assert [(x.period, x.delta) for x in d.filter("late").orderBy("version", "delta").collect()] == [("2022-05", 1), ("2022-05", -1), ("2023-01", 1)]
    assert [(x.period, x.key) for x in late.beyond_cut_off(d).collect()] == [("2023-01", "k")]
    assert late.beyond_cut_off(d.filter("delta > 0")).count() == 2 and late.beyond_cut_off(d.limit(0)).count() == 0


RECORDS = "key string, stated_day date, accepted_at timestamp_ntz, arrived_at timestamp_ntz, record_id long"


def test_late_events(spark):
    d = dt.date(2024, 1, 15)
    rows = [
        ("on time", d, T0, dt.datetime(2024, 3, 16, 23, 59), 1), ("late", d, T0, dt.datetime(2024, 3, 17), 2), ("moves", None, dt.datetime(2024, 2, 3), dt.datetime(2024, 2, 3), 3),
        ("moves", d, dt.datetime(2024, 2, 3), dt.datetime(2024, 2, 9), 4), ("no day", None, None, T0, 5), ("no arrival", d, T0, None, 6), (None, d, T0, T0, 7),
    ]
    v = late.versions(late.facts(spark.createDataFrame(rows + rows[:3], RECORDS)))
    assert {(x.period, x.key) for x in late.beyond_cut_off(late.deltas(v)).collect()} == {("2024-01", "late")}
    moves = late.deltas(v).filter("key = 'moves'").orderBy("version", "delta").collect()
    assert [(x.version, x.period, x.delta) for x in moves] == [(1, "2024-02", 1), (2, "2024-02", -1), (2, "2024-01", 1)]
    assert {(x.period, x.filings, x.added, x.retracted) for x in late.totals(late.deltas(v)).collect()} == {("2024-01", 3, 3, 0), ("2024-02", 0, 1, 1)}


def test_late_empty(spark):
    v = late.versions(late.facts(spark.createDataFrame([], RECORDS)))
    assert late.totals(late.deltas(v)).count() == 0 and late.beyond_cut_off(late.deltas(v)).count() == 0


MESSAGES = "id long, key string, at long, count string"


def test_keep_first_and_copies(spark):
    rows = [(1, "a", 5, "x"), (2, "a", 5, "y"), (3, "a", None, "z"), (4, None, 1, ""), (5, None, 1, ""), (6, "b", 2, ""), (7, "a", 4, "")]
    m = spark.createDataFrame(rows, MESSAGES)
    order = [F.col("at"), F.col("id")]
    assert {x.id for x in dedup.keep_first(m, F.col("key"), order).collect()} == {4, 5, 6, 7}
    assert {x.id for x in dedup.copies(m, F.col("key"), order, "id").collect()} == {1, 2, 3}
    stored = spark.createDataFrame([("b",), (None,)], "known string")
    assert {x.id for x in dedup.new_messages(m, stored, F.col("key"), F.col("known"), order).collect()} == {4, 5, 7}
    empty = spark.createDataFrame([], MESSAGES)
    assert dedup.keep_first(empty, F.col("key"), order).count() == dedup.copies(empty, F.col("key"), order, "id").count() == 0


def test_ranks_are_limited_before_the_shuffle(spark):
    m = spark.createDataFrame([(1, "a", 5, "x")], MESSAGES)
    plan = dedup.keep_first(m, F.col("key"), [F.col("at"), F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


SNAPSHOTS = "entity string, valid_from date, stated_to date, knowledge_at timestamp_ntz, a string, extra string"


def test_history(spark):
    d = lambda k: dt.date(2024, 1, k)
    rows = [
        ("x", d(1), None, T0, "p", ""), ("x", d(3), None, T0, "p", ""), ("x", d(5), d(30), T0, "q", ""), ("x", d(5), None, T0 - dt.timedelta(1), "wrong", ""), ("x", d(7), d(20), T0, "p", ""),
        ("y", d(2), None, T0, None, ""), ("y", d(4), None, None, None, ""), (None, d(1), None, T0, "n", ""), ("z", None, None, T0, "n", ""),
    ]
    first, second = rows[:4], rows[3:]
    h = history.version_history([spark.createDataFrame(first, SNAPSHOTS), spark.createDataFrame(second, SNAPSHOTS)], ["a"]).collect()
    assert {tuple(x) for x in h} == {("x", "p", d(1), d(5)), ("x", "q", d(5), d(7)), ("x", "p", d(7), d(20)), ("y", None, d(2), None)}
    assert history.version_history([spark.createDataFrame([], SNAPSHOTS)], ["a"]).count() == 0


def brute_history(rows):
    """rows: entity, day, stated_to, known, value"""
    out = []
    for e in {r[0] for r in rows}:
        best = {}
        for r in rows:
            if r[0] == e:
                rank = (r[3] is not None, r[3] or T0, r[4] is not None, r[4] or "", r[2] is not None, r[2] or dt.date.min)
                best[r[1]] = max(best.get(r[1], (rank, r)), (rank, r), key=lambda x: x[0])
        days = [best[k][1] for k in sorted(best)]
        for i, r in enumerate(days):
            if i and days[i - 1][4] == r[4]:
                continue
            nxt = next((k for k in range(i + 1, len(days)) if days[k][4] != r[4]), None)
            out.append((e, r[4], r[1], days[nxt][1] if nxt else days[-1][2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_rows", [1, 7, 1000])
def test_history_merges_many_snapshots(spark, chunk_rows):
    """Snapshots that overlap in entities and days, cut into chunks of any size, and one entity with a third of the rows."""
    r = random.Random(chunk_rows)
    rows = [(r.choice(["hot", f"e{r.randint(0, 9)}", f"e{r.randint(0, 9)}"]), T0.date() + dt.timedelta(r.randint(0, 40)), r.choice([None, T0.date()]), r.choice([None, T0 + dt.timedelta(r.randint(0, 3))]), r.choice(["p", "q", None]), f"s{r.randint(0, 30)}") for _ in range(900)]
    df = spark.createDataFrame(rows + rows[:50], "entity string, valid_from date, stated_to date, knowledge_at timestamp_ntz, a string, snap string")
    got = [tuple(x) for x in history.version_history([df.filter("snap < 's2'"), df.filter("snap >= 's2'")], ["a"], "snap", chunk_rows).collect()]
    assert sorted(got, key=str) == brute_history(rows)


def test_merge_gives_order_and_holds_a_chunk_per_run():
    import pyarrow as pa

    r = random.Random(8)
    runs = {f"s{k}": sorted((f"e{r.randint(0, 99):02}", T0.date() + dt.timedelta(k)) for _ in range(60)) for k in range(5)}
    packed = [b for name, keys in runs.items() for b in history._pack(iter([pa.RecordBatch.from_pydict({"snapshot": [name] * 60, "entity": [e for e, _ in keys], "valid_from": [d for _, d in keys]})]), 8)]
    chunks = pa.Table.from_batches(packed).sort_by([("entity", "ascending"), ("valid_from", "ascending")])
    got = [(x["entity"], x["valid_from"]) for x in history._merged(iter(chunks.to_batches()))]
    assert len(chunks) == 40 and got == sorted(k for keys in runs.values() for k in keys)


def test_trailing_like_brute_force(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), T0.date() + dt.timedelta(r.choice([*range(20), 60, 61])), float(r.randint(0, 3)), 1) for _ in range(40)] + [("a", None, 1.0, 1), (None, T0.date(), 1.0, 1), ("c", T0.date(), None, 1)]
    df = spark.createDataFrame(rows, "entity string, day date, amount double, total int").withColumn("level", F.col("amount").cast("decimal(18,4)"))
    got = {(x.entity, x.day): x for x in rolling.trailing(rolling.daily_totals(df), (7, 30)).collect()}
    for e in "abc":
        days = [x[1] for x in rows if x[0] == e and x[1]]
        n = (max(days) - min(days)).days + 1
        assert sum(k[0] == e for k in got) == n
        for i in range(n):
            day = min(days) + dt.timedelta(i)
            for k in (7, 30):
                inside = [x[2] for x in rows if x[0] == e and x[1] and day - dt.timedelta(k) < x[1] <= day and x[2] is not None]
                g = got[e, day]
                assert g[f"total_{k}"] == sum(inside) and g[f"mean_{k}"] == sum(inside) / k and g[f"active_{k}"] == sum(v > 0 for v in inside)
                assert g[f"level_{k}"] == (pytest.approx(sum(inside) / len(inside)) if inside else None)


def test_greedy_spacing(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(60)])) for _ in range(200)]
    got = {(x.k, x.o) for x in fold.greedy_spacing(spark.createDataFrame(rows, "k string, o int"), ["k"], "o", 7).collect()}
    want = set()
    for k in "ab":
        last = None
        for o in sorted({o for q, o in rows if q == k and o is not None}):
            if last is None or o - last >= 7:
                want.add((k, o))
                last = o
    assert got == want


def test_ordered_index(spark):
    rows = spark.range(100, numPartitions=5).select((F.col("id") * 37 % 101).alias("v"))
    got = rolling.ordered_index(rows, ["v"], "i").collect()
    assert [x.v for x in sorted(got, key=lambda x: x.i)] == sorted(x.v for x in got) and {x.i for x in got} == set(range(100))
