"""Attributes as known at event time.

An interval counts for an event at time t when valid_from <= day(t) < valid_to and knowledge_at <= t. As day(t) belongs
to t, both conditions are ranges of the same clock: the interval is current in [max(valid_from 00:00, knowledge_at),
valid_to 00:00). ``current_state_versions`` sweeps each entity's intervals in the order they become available and writes
down which one rules from when on, ties already resolved; ``asof_attributes`` then needs nothing but the latest version
at or before t, which an embedded DuckDB finds by ASOF LEFT JOIN in every hash bucket."""

from __future__ import annotations

import datetime as dt
import heapq
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 100_000
_VERSIONS = "entity string, starts timestamp_ntz, interval_id long"
_DAWN = dt.datetime(1, 1, 1)


def _priority(row: dict) -> tuple:
    """Latest valid_from, then latest knowledge_at, then highest id win; heapq has the smallest on top."""
    back = lambda x: -((x - _DAWN) // dt.timedelta(microseconds=1)) if x is not None else 1
    return back(row["valid_from"]), back(row["knowledge_at"]), -row["interval_id"]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by entity and start: state is a heap of one entity's open intervals, whatever the history's length."""
    schema = pa.schema([("entity", pa.string()), ("starts", pa.timestamp("us")), ("interval_id", pa.int64())])
    out: list[tuple] = []
    heap: list[tuple] = []
    entity, ruling = None, None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def rules(at: dt.datetime, interval_id: int | None) -> None:
        nonlocal ruling
        ruling = interval_id
        if out and out[-1][:2] == (entity, at):
            out.pop()  # of one instant only the last change holds
        out.append((entity, at, interval_id))

    def settle(until: dt.datetime | None) -> None:
        """Closes what ends by ``until``; each end hands over to the best interval still open."""
        while heap and heap[0][1] is not None and (until is None or heap[0][1] <= until):
            end = heap[0][1]
            while heap and heap[0][1] is not None and heap[0][1] <= end:
                heapq.heappop(heap)
            rules(end, heap[0][2] if heap else None)

    for batch in batches:
        for row in batch.to_pylist():
            if row["entity"] != entity:
                settle(None)
                heap.clear()
                entity, ruling = row["entity"], None
            settle(row["starts"])
            heapq.heappush(heap, (_priority(row), row["stops"], row["interval_id"]))
            if heap[0][2] != ruling:
                rules(row["starts"], heap[0][2])
        if len(out) > 50_000:
            yield packed(out[:-1])
            out = out[-1:]
    settle(None)
    if out:
        yield packed(out)


def current_state_versions(intervals: DataFrame) -> DataFrame:
    """(entity, starts, interval_id): from ``starts`` on that interval rules, or none where the id is null.

    intervals: entity string, interval_id long, valid_from date, valid_to date, knowledge_at timestamp_ntz; null bounds are
    open, null knowledge_at means always known. Empty intervals and rows without entity or id never rule. Repeated rows
    and an empty table do no harm. There is one version at most per entity and instant."""
    dawn = F.lit(str(_DAWN)).cast("timestamp_ntz")
    rows = (
        intervals.select("entity", "interval_id", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"),
            F.col("valid_to").cast("timestamp_ntz").alias("stops"), F.col("knowledge_at").cast("timestamp_ntz").alias("knowledge_at"))
        .filter("entity is not null and interval_id is not null")
        .withColumn("starts", F.coalesce(F.greatest("valid_from", "knowledge_at"), dawn))
        .filter(F.col("stops").isNull() | (F.col("starts") < F.col("stops")))
        .distinct()
    )
    return rows.repartition("entity").sortWithinPartitions("entity", "starts", "interval_id").mapInArrow(_sweep, _VERSIONS)


_EVENTS = pa.schema([("event_id", pa.string()), ("entity", pa.string()), ("t", pa.timestamp("us"))])
_STARTS = pa.schema([("entity", pa.string()), ("starts", pa.timestamp("us")), ("interval_id", pa.int64())])
_FOUND = pa.schema([*_EVENTS, ("interval_id", pa.int64())])


def _asof_bucket(events: pa.Table, versions: pa.Table) -> pa.Table:
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": "400MB"}) as db:
        db.register("ev", events)
        db.register("ver", versions)
        got = db.sql(
            "SELECT e.event_id, e.entity, e.t, v.interval_id FROM (SELECT DISTINCT event_id, entity, t FROM ev) e "
            "ASOF LEFT JOIN (SELECT entity, starts, interval_id FROM ver) v ON e.entity = v.entity AND e.t >= v.starts"
        ).to_arrow_table()
    return got.cast(_FOUND)


def _asof_partition(batches: Iterator[pa.RecordBatch], rows_per_bucket: int) -> Iterator[pa.RecordBatch]:
    """Buckets of about ``rows_per_bucket`` rows out of a partition sorted by entity, versions before events, copies of an
    event side by side. What is held is one bucket, and the versions of the entity that goes on in the next."""
    import pyarrow.compute as pc

    held: list[pa.Table] = []

    def joined(t: pa.Table) -> list[pa.RecordBatch]:
        is_event = pc.field("is_event")
        return _asof_bucket(t.filter(is_event).select(_EVENTS.names), t.filter(~is_event).select(_STARTS.names)).to_batches(max_chunksize=20_000)

    def cut(t: pa.Table) -> tuple[pa.Table, pa.Table]:
        """(bucket, what the next one begins with): the last event, whose copies may follow, and its entity's versions."""
        is_event = t.column("is_event")
        own, *same = (pc.equal(pc.fill_null(t.column(c), blank), pc.fill_null(t.column(c)[-1:], blank)[0]) for c, blank in (("entity", ""), ("event_id", ""), ("t", _DAWN)))
        copies = pc.and_(is_event, pc.and_(own, pc.and_(*same)))
        rest = t.filter(pc.or_(copies, pc.and_(own, pc.invert(is_event))))
        return t.filter(pc.invert(copies)), rest.group_by(rest.column_names).aggregate([])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= rows_per_bucket:
            bucket, rest = cut(pa.concat_tables(held))
            held = [rest]
            yield from joined(bucket)
    if held:
        yield from joined(pa.concat_tables(held))


def asof_attributes(events: DataFrame, intervals: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET, ways: int | None = None) -> DataFrame:
    """(event_id, entity, t, interval_id) for every distinct event; interval_id is null where nothing was known and valid.

    events: event_id string, entity string, t timestamp_ntz; other columns are ignored, nulls are kept and match nothing.
    Events are hash-partitioned by entity and one of ``ways`` salts, a hash of the event; an entity's versions, of which
    there are few, go to each of its salts. With a third as many ways as there are shuffle partitions (the default)
    an entity that holds a third of all events gives no partition more than an even share of them, and nothing has to be
    counted beforehand: events are read once, and nothing reaches the driver. Partitions are worked off in buckets of about
    ``rows_per_bucket`` rows, so their size doesn't matter to memory."""
    spark = events.sparkSession
    ways = ways or max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 3))
    none = {"time": F.lit(None).cast("timestamp_ntz"), "id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")}
    left = events.select(
        "event_id", "entity", F.col("t").cast("timestamp_ntz").alias("t"), none["time"].alias("starts"), none["id"].alias("interval_id"),
        F.lit(True).alias("is_event"), F.pmod(F.xxhash64("event_id", "t"), F.lit(ways)).alias("salt"),
    )
    right = current_state_versions(intervals).select(
        none["text"].alias("event_id"), "entity", none["time"].alias("t"), "starts", "interval_id",
        F.lit(False).alias("is_event"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))).alias("salt"),
    )
    both = left.unionByName(right).repartition("entity", "salt").sortWithinPartitions("entity", "salt", "is_event", "event_id", "t")
    return both.drop("salt").mapInArrow(partial(_asof_partition, rows_per_bucket=rows_per_bucket), "event_id string, entity string, t timestamp_ntz, interval_id long")
