"""Immutable snapshots: data first, the manifest that names them last."""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import json
from collections.abc import Callable
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import content_hash
from .storage import Storage, checked_name


class SnapshotConflict(ValueError):
    pass


def fingerprint(df: DataFrame) -> str:
    """Hash of a table's rows in any order: schema, count and sums of row hashes; one small row reaches the driver."""
    h = content_hash(df.columns)
    parts = [F.sum(F.conv(F.substring(h, i, 8), 16, 10).cast("decimal(38,0)")) for i in (1, 9, 17, 25)]
    got = df.agg(F.count("*"), *parts).first()
    return hashlib.sha256(json.dumps([df.schema.simpleString(), [str(x) for x in got]]).encode()).hexdigest()


def write_snapshot(tables: dict[str, DataFrame], folder: str, run_id: str) -> dict:
    """Each table as Parquet under folder/run_id, then a manifest of their fingerprints, then folder/current.json.

    Writing a run again is allowed if it has the same content and refused otherwise. A reader that follows current.json
    never sees a half-written run. ``folder`` is on any storage Spark can write to."""
    spark = next(iter(tables.values())).sparkSession
    store = Storage(spark, folder)
    manifest_name = f"{checked_name(run_id)}/manifest.json"
    manifest = {"run_id": run_id, "tables": {checked_name(name): fingerprint(df) for name, df in sorted(tables.items())}}
    if store.exists(manifest_name):
        if json.loads(store.read(manifest_name)) != manifest:
            raise SnapshotConflict(f"run {run_id} was written with other content")
    else:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{run_id}/{name}")
        store.write(manifest_name, canonical_json(manifest).encode())
    digest = hashlib.sha256(store.read(manifest_name)).hexdigest()
    store.write("current.json", canonical_json({"run_id": run_id, "sha256": digest}).encode())
    return manifest


def read_snapshot(spark: SparkSession, folder: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables current.json points to. Raises if the manifest isn't the one that was written, if a name in it leaves the
    run's folder, if the folder holds anything the manifest doesn't name or lacks what it names, and, with ``verify``, if
    a table's content isn't what was written."""
    store = Storage(spark, folder)
    current = json.loads(store.read("current.json"))
    run_id = checked_name(current["run_id"])
    raw = store.read(f"{run_id}/manifest.json")
    if hashlib.sha256(raw).hexdigest() != current["sha256"]:
        raise SnapshotConflict("the manifest was changed")
    marks = {checked_name(name): mark for name, mark in json.loads(raw)["tables"].items()}
    if store.names(run_id) != sorted([*marks, "manifest.json"]):
        raise SnapshotConflict("the folder holds other files than the manifest names")
    tables = {name: spark.read.parquet(f"{folder}/{run_id}/{name}") for name in marks}
    if verify:
        changed = [name for name, df in tables.items() if fingerprint(df) != marks[name]]
        if changed:
            raise SnapshotConflict(f"content was changed: {', '.join(changed)}")
    return tables


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV whose text can't be taken for a formula by a spreadsheet."""
    safe = [F.regexp_replace(F.col(f.name), r"^(\s*)(?=[=+@\-])", "'$1").alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema]
    df.select(*safe).write.mode("overwrite").option("quoteAll", True).option("escape", '"').csv(path, header=True)


def export_partitioned_json(df: DataFrame, path: str, by: str, ways: int | None = None) -> None:
    """A folder of JSON lines per value of ``by``. A value's rows go to ``ways`` tasks, a third of the shuffle partitions if
    not stated, so that one that most rows have isn't one task's work."""
    ways = ways or max(1, -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 3))
    df.repartition(F.col(by), F.pmod(F.xxhash64(*df.columns), F.lit(ways))).write.mode("overwrite").partitionBy(by).json(path)


def append_new(df: DataFrame, path: str, key: str, spark: SparkSession, batch_id: int) -> None:
    """Appends rows whose key isn't there yet, as an at-least-once stream's ``foreachBatch`` needs: each batch owns a folder
    and may be written again. Of what is there, only keys are read."""
    if Storage(spark, path).names():
        known = spark.read.parquet(path).filter(F.col("batch") != batch_id).select(key)
        df = df.join(known, key, "left_anti")
    df.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def deliver_at_most_once(df: DataFrame, path: str, key: str, spark: SparkSession, batch_id: int, send: Callable[[DataFrame], None]) -> bool:
    """Claims the batch's new keys, then sends their rows. A batch that was claimed before is never sent again, even if sending
    it failed: rows may be lost that way, none is sent twice. Whether anything was sent."""
    store = Storage(spark, path)
    if store.exists(f"batch={batch_id}/_SUCCESS"):
        return False
    append_new(df, path, key, spark, batch_id)
    claimed = spark.read.schema(df.select(key).schema).parquet(f"{path}/batch={batch_id}")
    send(df.dropDuplicates([key]).join(claimed, key, "left_semi"))
    return True


def pack(content: bytes) -> tuple[str, bytes]:
    """(name, gzip bytes) of a small file: the same content gives the same bytes on any day, and the name is its hash."""
    return f"{hashlib.sha256(content).hexdigest()}.gz", gzip.compress(content, 9, mtime=0)


def unpack(name: str, packed: bytes) -> bytes:
    """The content; raises if it isn't what the name says."""
    content = gzip.decompress(packed)
    if f"{hashlib.sha256(content).hexdigest()}.gz" != name:
        raise SnapshotConflict(f"{name} holds other content")
    return content


def check_input_manifest(store: Storage, manifest: dict) -> None:
    """Raises unless ``as_of`` is the very close of a New York session (16:00 there, in UTC), every input is a plain relative path
    inside the folder, none comes twice or lies within another, and each has the hash it is stated with.

    manifest: {"as_of": "2024-07-01T20:00:00Z", "inputs": [{"path": ..., "sha256": ...}]}; inputs are small files."""
    at = dt.datetime.fromisoformat(manifest["as_of"]).astimezone(ZoneInfo("America/New_York"))
    if (at.hour, at.minute, at.second, at.microsecond) != (16, 0, 0, 0):
        raise ValueError(f"as_of is no close: {manifest['as_of']}")
    paths = [x["path"] for x in manifest["inputs"]]
    for path in paths:
        for part in path.split("/"):
            checked_name(part)
    parts = sorted(p.split("/") for p in paths)
    for a, b in zip(parts, parts[1:]):
        if b[: len(a)] == a:
            raise ValueError(f"inputs overlap: {'/'.join(a)}, {'/'.join(b)}")
    for x in manifest["inputs"]:
        if hashlib.sha256(store.read(x["path"])).hexdigest() != x["sha256"]:
            raise SnapshotConflict(f"{x['path']} was changed")
