"""Which of several statements holds: latest, unique, conflicting, in force."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_without_conflict(rows: DataFrame, key: str, at: str, content: list[str]) -> DataFrame:
    """(key, at, *content, conflict): the latest statement of each key; ``conflict`` if several of that time differ, in which
    case the content is null. Everything is one aggregate: distinct contents per key and time, then the latest time."""
    per_time = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.min(F.struct(*content)).alias("low"), F.max(F.struct(*content)).alias("high"))
    last = per_time.groupBy(key).agg(F.max(F.struct(at, "low", "high")).alias("r"))
    clash = ~F.col("r.low").eqNullSafe(F.col("r.high"))
    return last.select(key, F.col(f"r.{at}").alias(at), *[F.when(~clash, F.col(f"r.low.{c}")).alias(c) for c in content], clash.alias("conflict"))


def unique_claims(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose ``value`` is claimed by one key only; null values claim nothing and are dropped."""
    claims = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(key).alias("__low"), F.max(key).alias("__high"))
    sole = claims.filter(F.col("__low") == F.col("__high")).select(value)
    return rows.join(sole, value, "left_semi")


def valid_on(intervals: DataFrame, key: str, day: Column, as_of: Column) -> DataFrame:
    """The interval of each key in force on a day by what was known as of a time: latest start, open end first, then
    source and value by name. Null bounds are open, null knowledge is always known; empty intervals never hold."""
    held = intervals.filter(
        (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)) & (F.col("knowledge_at").isNull() | (F.col("knowledge_at") <= as_of))
    )
    order = [F.desc_nulls_last("valid_from"), F.col("valid_to").isNotNull(), F.asc_nulls_last("source"), F.asc_nulls_last("ticker"), F.asc("interval_id")]
    return held.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rn = 1").drop("__rn")


def prior_unique_value(events: DataFrame, observations: DataFrame, days_back: int) -> DataFrame:
    """events (event_id, key, day) with ``value``: the only value observed for the key on one of the ``days_back`` days before (day
    itself included), null if there is none or several.

    Both sides are reduced to one row per key and day before the window, so a key with very many of either has no more rows
    there than the calendar has days; the value then joins the events by key and day. Events without key or day have none."""
    seen = observations.select("key", "day", "value").filter("key is not null and day is not null and value is not null")
    obs = seen.groupBy("key", "day").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    asked = events.select("key", "day").filter("key is not null and day is not null").distinct().withColumn("asked", F.lit(True))
    days = asked.join(obs, ["key", "day"], "full")
    w = Window.partitionBy("key").orderBy(F.unix_date("day")).rangeBetween(-days_back, 0)
    low, high = F.min("low").over(w), F.max("high").over(w)
    found = days.withColumn("value", F.when(low == high, low)).filter("asked and value is not null").select("key", "day", "value")
    return events.select("event_id", "key", "day").join(found, ["key", "day"], "left").select("event_id", "key", "day", "value")


def amendments(rows: DataFrame, link: list[str], at: str, row_id: str, is_amendment: Column) -> DataFrame:
    """rows with ``revision``, ``replaces``, ``valid_to`` and ``problem``: statements of one link in order of ``at``.

    An amendment replaces the statement before it and takes the next revision; originals start at 0 again. Problems:
    NO_PREDECESSOR for an amendment with nothing before it, AMBIGUOUS for one of a time that several statements of its link
    share, NO_KEY for rows with a null in the link or no time; such rows replace nothing and are replaced by nothing.
    Statements are ranked within their link only; repeated rows are one."""
    marked = rows.distinct().withColumn("__amends", F.coalesce(is_amendment, F.lit(False)))
    keyed = F.lit(True)
    for c in [*link, at]:
        keyed = keyed & F.col(c).isNotNull()
    marked = marked.withColumn("__keyed", keyed)
    same = F.count("*").over(Window.partitionBy(*link, at))
    first = F.min(at).over(Window.partitionBy(*link))
    problem = F.when(~F.col("__keyed"), "NO_KEY").when(F.col("__amends") & (same > 1), "AMBIGUOUS").when(F.col("__amends") & (F.col(at) == first), "NO_PREDECESSOR")
    marked = marked.withColumn("problem", problem)
    # only rows without a problem take part, so a chain goes on over a quarantined one
    chain = Window.partitionBy(*link, F.col("problem").isNull()).orderBy(at, row_id)
    ok = F.col("problem").isNull()
    start = F.max(F.when(~F.col("__amends"), F.col("__n"))).over(chain.rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("__n", F.row_number().over(chain))
    out = out.withColumns({"revision": F.when(ok, F.col("__n") - F.coalesce(start, F.lit(1))).cast("long"), "replaces": F.when(ok & F.col("__amends"), F.lag(row_id).over(chain))})
    replaced = F.lead("__amends").over(chain)
    return out.withColumn("valid_to", F.when(ok & replaced, F.lead(at).over(chain))).drop("__amends", "__keyed", "__n")


def merged_observations(rows: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """(*key, *content, conflict): repeated observations of one key are one; of those that differ the content is null and
    ``conflict`` true. An observation is never changed by a later one, so appending a delivery again changes nothing."""
    g = rows.groupBy(*key).agg(F.min(F.struct(*content)).alias("__low"), F.max(F.struct(*content)).alias("__high"))
    clash = ~F.col("__low").eqNullSafe(F.col("__high"))
    return g.select(*key, *[F.when(~clash, F.col(f"__low.{c}")).alias(c) for c in content], clash.alias("conflict"))


_REVISED = "revision_id string, transaction_id string, accession string, revision int, status string, supersedes string, valid_from timestamp_ntz, valid_to timestamp_ntz, problem string"


def _resolve_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over statements sorted by row identity and order of knowledge; state is one identity's chain."""
    names = [x.split(" ")[0] for x in _REVISED.split(", ")]
    text, time = pa.string(), pa.timestamp("us")
    schema = pa.schema(list(zip(names, [text, text, text, pa.int32(), text, text, time, time, text])))
    out: list[dict] = []
    identity, seen, by_revision, by_accession = None, set(), {}, {}

    def add(row: dict, **facts: object) -> dict:
        made = {**dict.fromkeys(names), "revision_id": row["revision_id"], "transaction_id": row["transaction_id"], "accession": row["accession"], **facts}
        out.append(made)
        return made

    def stands(made: dict) -> None:
        by_revision[made["revision_id"]] = made
        by_accession.setdefault(made["accession"], []).append(made)

    for batch in batches:
        for row in batch.to_pylist():
            own = row["issuer"], row["owner"], row["table_type"], row["row_sequence"]
            if own != identity:
                identity, seen, by_revision, by_accession = own, set(), {}, {}
            content = row["accession"], row["content_hash"]
            if content in seen:
                continue
            seen.add(content)
            if not row["is_amendment"]:
                stands(add(row, revision=0, status="ACTIVE", valid_from=row["valid_from"]))
                continue
            named, accession = row["supersedes"], row["amends_accession"]
            if named is not None:
                before = by_revision.get(named)
                problem = "UNRESOLVED_AMENDMENT" if before is None else "AMENDMENT_LINK_CONFLICT" if accession not in (None, before["accession"]) else None
            else:
                fits = by_accession.get(accession or row["accession"], [])
                before = fits[0] if len(fits) == 1 else None
                problem = None if before else "AMBIGUOUS_AMENDMENT" if fits else "UNRESOLVED_AMENDMENT"
            if problem is None and before["valid_to"] is not None:
                problem = "AMENDMENT_CHAIN_FORK"
            starts = max(row["valid_from"], row["known_at"])
            if problem is None and starts < before["valid_from"]:
                problem = "AMENDMENT_TIME_CONFLICT"
            if problem is not None:
                add(row, problem=problem, supersedes=named)
                continue
            before["valid_to"], before["status"] = starts, "SUPERSEDED"
            parts = (before["transaction_id"], before["revision_id"], row["accession"], row["content_hash"])
            made = add(row, revision=before["revision"] + 1, status="ACTIVE", supersedes=before["revision_id"], valid_from=starts, transaction_id=before["transaction_id"])
            made["revision_id"] = "txr_" + hashlib.sha256("|".join(parts).encode()).hexdigest()
            stands(made)
        # rows of the identity that goes on may still change
        open_ = set(map(id, by_revision.values()))
        done = [r for r in out if id(r) not in open_]
        if len(done) > 20_000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            out = [r for r in out if id(r) in open_]
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def resolve_revisions(statements: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(revision_id, transaction_id, accession, revision, status, supersedes, valid_from, valid_to, problem): every statement as a
    revision of its transaction, or with the problem for which it is set aside.

    statements: revision_id, transaction_id, issuer, owner, table_type, accession, content_hash strings, row_sequence int,
    is_amendment boolean, supersedes and amends_accession strings, known_at, recorded_at and valid_from timestamp_ntz; other
    columns are dropped. What became known after ``as_of`` isn't seen. An amendment names the revision it replaces, or the
    filing whose very same row it replaces (its own, if it names none); nothing is matched by price, date or amount. Rows
    repeated with one content are one. Problems: UNRESOLVED_AMENDMENT, AMBIGUOUS_AMENDMENT, AMENDMENT_CHAIN_FORK,
    AMENDMENT_LINK_CONFLICT, AMENDMENT_TIME_CONFLICT, AMENDMENT_IDENTITY_MISMATCH (the revision named is another row's) and
    NO_KEY for rows with a null in their identity or times. One shuffle by row identity; what is held is one row's chain."""
    columns = ["revision_id", "transaction_id", "issuer", "owner", "table_type", "row_sequence", "accession", "content_hash", "is_amendment",
        "supersedes", "amends_accession", "known_at", "recorded_at", "valid_from"]
    known = statements.select(*columns)
    if as_of is not None:
        known = known.filter(F.col("known_at") <= as_of)
    keys = ["issuer", "owner", "table_type", "row_sequence"]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "revision_id", "accession", "content_hash", "known_at", "recorded_at", "valid_from"]])
    aside = known.filter(~whole).select("revision_id", "transaction_id", "accession", F.lit("NO_KEY").alias("problem"))
    ordered = known.filter(whole).withColumn("is_amendment", F.coalesce("is_amendment", F.lit(False))).repartition(*keys).sortWithinPartitions(*keys,
        "known_at", "recorded_at", "accession", "revision_id", "content_hash")
    found = ordered.mapInArrow(_resolve_rows, _REVISED)
    # a revision that isn't this row's may be another's
    elsewhere = known.select(F.col("revision_id").alias("supersedes"), F.col("known_at").alias("__known")).groupBy("supersedes").agg(F.min("__known").alias("__known"))
    own = known.groupBy("revision_id").agg(F.min("known_at").alias("__at"))
    lost = F.col("problem") == "UNRESOLVED_AMENDMENT"
    named = found.filter(lost & F.col("supersedes").isNotNull()).join(elsewhere, "supersedes", "left").join(own, "revision_id", "left")
    other = F.when(F.col("__known") <= F.col("__at"), "AMENDMENT_IDENTITY_MISMATCH").otherwise(F.col("problem"))
    named = named.withColumn("problem", other).select(*found.columns)
    rest = found.filter(~F.coalesce(lost, F.lit(False)) | F.col("supersedes").isNull())
    return rest.unionByName(named).unionByName(aside, allowMissingColumns=True)
