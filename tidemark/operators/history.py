"""History of changing attributes out of periodic snapshots, by a k-way merge.

Snapshots are co-partitioned by entity and each is sorted by entity and day within a partition, which costs nothing where
they are stored that way. Every such run is cut into chunks of a few hundred rows, packed as Arrow; put in order of their
first rows, the chunks are opened one after another as the merge comes to them, so that a heap over one open chunk per run
gives all rows in order of entity and day. What is held is these chunks and the version that is open: no history, and no
snapshot, is ever collected."""

from __future__ import annotations

import datetime as dt
import heapq
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk. A task holds as many chunks as there are snapshots.
CHUNK = 128
_CHUNKS = "entity string, valid_from date, chunk binary"


def _pack(batches: Iterator[pa.RecordBatch], chunk_rows: int) -> Iterator[pa.RecordBatch]:
    """Chunks of rows sorted by snapshot, entity and day; none has rows of two snapshots."""
    for batch in batches:
        table = batch.drop_columns(["snapshot"])
        snapshots = batch.column("snapshot").to_pylist()
        starts, out = 0, []
        while starts < batch.num_rows:
            ends = starts + 1
            while ends < batch.num_rows and ends - starts < chunk_rows and snapshots[ends] == snapshots[starts]:
                ends += 1
            part = table.slice(starts, ends - starts)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as writer:
                writer.write_batch(part)
            out.append((part.column("entity")[0].as_py(), part.column("valid_from")[0].as_py(), sink.getvalue().to_pybytes()))
            starts = ends
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.date32(), pa.binary()))], names=["entity", "valid_from", "chunk"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """All rows in order of entity and day, out of chunks in order of their first rows."""
    heap: list[tuple] = []  # entity, day, number of the chunk, the row, the chunk's rest
    count = 0

    def put(rows: Iterator[dict], number: int) -> None:
        row = next(rows, None)
        if row is not None:
            heapq.heappush(heap, (row["entity"], row["valid_from"], number, row, rows))

    def upto(entity: str | None, day: dt.date | None) -> Iterator[dict]:
        while heap and (entity is None or heap[0][:2] < (entity, day)):
            _, _, number, row, rows = heapq.heappop(heap)
            yield row
            put(rows, number)

    for batch in batches:
        for entity, day, chunk in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield from upto(entity, day)
            put(iter(pa.ipc.open_stream(chunk).read_all().to_pylist()), count)
            count += 1
    yield from upto(None, None)


def _rank(row: dict, attributes: list[str]) -> tuple:
    """Of one day the latest knowledge holds, then the greatest values; nulls are least."""
    known = row["knowledge_at"]
    return known is not None, known or dt.datetime.min, [(row[a] is not None, row[a] or "") for a in attributes], row["stated_to"] is not None, row["stated_to"] or dt.date.min


def _close_versions(batches: Iterator[pa.RecordBatch], attributes: list[str]) -> Iterator[pa.RecordBatch]:
    names = ["entity", *attributes, "valid_from", "valid_to"]
    types = [pa.string()] * (1 + len(attributes)) + [pa.date32()] * 2
    open_, out = None, []  # open_: entity, payload, valid_from, valid_to stated by the last snapshot seen

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def take(row: dict) -> None:
        nonlocal open_
        payload = [row[a] for a in attributes]
        if open_ is not None and open_[0] == row["entity"] and open_[1] == payload:
            open_[3] = row["stated_to"]
            return
        if open_ is not None:
            out.append((open_[0], *open_[1], open_[2], row["valid_from"] if open_[0] == row["entity"] else open_[3]))
        open_ = [row["entity"], payload, row["valid_from"], row["stated_to"]]

    holds = None  # of the rows of one entity and day seen so far
    for row in _merged(batches):
        if holds is not None and (holds["entity"], holds["valid_from"]) == (row["entity"], row["valid_from"]):
            holds = max(holds, row, key=lambda r: _rank(r, attributes))
            continue
        if holds is not None:
            take(holds)
        holds = row
        if len(out) > 20_000:
            yield packed()
            out.clear()
    if holds is not None:
        take(holds)
    if open_ is not None:
        out.append((open_[0], *open_[1], open_[2], open_[3]))
    if out:
        yield packed()


def version_history(snapshots: list[DataFrame], attributes: list[str], snapshot: str | None = None, chunk_rows: int = CHUNK) -> DataFrame:
    """(entity, *attributes, valid_from, valid_to), gapless per entity; a version is an unbroken run of equal attributes.

    Each of ``snapshots`` has entity string, valid_from date, stated_to date, knowledge_at timestamp and the attributes as
    strings, and may hold several snapshots told apart by the column named ``snapshot``; extra columns are dropped. Rows
    without entity or valid_from say nothing. Rows of one snapshot, entity and day are reduced to one before the shuffle,
    so an entity has at most a row per snapshot and day afterwards, however often it was delivered. Of several snapshots
    of one entity and day the latest knowledge_at holds (null is earliest; then the greatest attributes, so that repeated
    and tied rows give one result). The last version ends where the entity's last snapshot says, or is open (null)."""
    keep = ["entity", "valid_from", "stated_to", "knowledge_at", *attributes]
    named = [s.select(F.concat_ws("/", F.lit(str(i)), F.col(snapshot).cast("string") if snapshot else F.lit("")).alias("snapshot"), *keep) for i, s in enumerate(snapshots)]
    rows = reduce(DataFrame.unionByName, named).filter("entity is not null and valid_from is not null")
    holds = rows.groupBy("snapshot", "entity", "valid_from").agg(F.max(F.struct("knowledge_at", *attributes, "stated_to")).alias("s"))
    flat = holds.select("snapshot", "entity", "valid_from", F.col("s.knowledge_at").cast("timestamp_ntz").alias("knowledge_at"), "s.stated_to", *[f"s.{a}" for a in attributes])
    runs = flat.repartition("entity").sortWithinPartitions("snapshot", "entity", "valid_from")
    # chunks stay in their partition: only their few first rows are sorted, in place
    chunks = runs.mapInArrow(partial(_pack, chunk_rows=chunk_rows), _CHUNKS).sortWithinPartitions("entity", "valid_from")
    schema = ", ".join(["entity string", *[f"`{a}` string" for a in attributes], "valid_from date", "valid_to date"])
    return chunks.mapInArrow(partial(_close_versions, attributes=attributes), schema)
