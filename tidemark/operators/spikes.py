"""Implausible readings in measurement series, told from each source's own behaviour.

Phase-space thresholding: the log readings, freed of their local level, and their first and second differences span a
space in which normal readings fill an ellipsoid; its axes come from medians, its size from the number of readings. What
lies outside farthest of its neighbourhood is replaced from the readings around it and the ellipsoid is drawn anew, until
nothing new lies out; what then fits the cleaned series was only a neighbour of a fault and goes back in. Outliers become
spikes if the series takes them back within a few readings. Runs of zero difference and bounds catch the other faults,
and steps that last are looked up to see whether they bear out a stated split."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Readings of a spike at most.
BACK_WITHIN = 3
#: How far beyond the extremes of normal noise the ellipsoid reaches: log prices have long tails, log volumes don't.
PRICE_WIDTH, VOLUME_WIDTH = 1.7, 1.0
#: Least half-axis of the ellipsoid, in logs: for prices, and for volumes two dozen times the local level.
PRICE_FLOOR, VOLUME_FLOOR = 0.08, float(np.log(24.0))
#: Shares that no day can trade.
VOLUME_BOUND = 1e12
#: Readings of one value that are a standstill.
STILL = 6
_OUT = pa.schema([("source", pa.string()), ("series", pa.string()), ("day", pa.date32()), ("field", pa.string()), ("reason", pa.string())])


def running_median(x: np.ndarray, half: int) -> np.ndarray:
    half = min(half, max(1, (len(x) - 1) // 2))
    padded = np.pad(x, half, mode="reflect") if len(x) > half else np.pad(x, half, mode="edge")
    return np.partition(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), half, axis=1)[:, half]


def _scale(x: np.ndarray) -> float:
    """Median deviation as a normal sigma, of the readings that deviate at all: a series at rest on most days isn't judged
    by its rest."""
    a = np.abs(x)
    a = a[a > 1e-12]
    return 1.4826 * float(np.partition(a, len(a) // 2)[len(a) // 2]) if len(a) else 0.0


def phase_space_outliers(x: np.ndarray, half: int, width: float, floor: float) -> tuple[np.ndarray, float]:
    """(mask of the readings outside the ellipsoid, its half-axis along single steps), drawn anew until nothing new lies
    out. The mask only grows meanwhile, so that ends. ``floor``: least half-axis along values."""
    n = len(x)
    out = np.zeros(n, bool)
    if n < 5:
        return out, np.inf
    radius = width * np.sqrt(2 * np.log(n))
    at, y = np.arange(n), x
    while True:
        u = y - running_median(y, half)
        d1 = np.gradient(u)
        d2 = np.gradient(d1)
        power = np.dot(u, u)
        theta = np.arctan(np.dot(u, d2) / power) if power > 0 else 0.0
        c, s = np.cos(theta), np.sin(theta)
        # of white noise the central differences have these parts of its deviation
        parts = ((u, 1.0), (d1, 0.5**0.5), (d2, 0.5), (c * u + s * d2, 1.0), (c * d2 - s * u, 0.5))
        axes = [max(radius * _scale(v), floor * part, 1e-12) for v, part in parts]
        q0, q1, q2, qa, qb = ((v / axis) ** 2 for (v, _), axis in zip(parts, axes))
        r = np.where(out, 0.0, np.nan_to_num(np.maximum(np.maximum(q0 + q1, q1 + q2), qa + qb)))
        new = r > 1
        if not new.any() or n - out.sum() < 3:
            break
        near = np.lib.stride_tricks.sliding_window_view(np.pad(r, BACK_WITHIN), 2 * BACK_WITHIN + 1).max(axis=1)
        out |= new & (r >= near)
        y = np.where(out, np.interp(at, at[~out], x[~out]), x)
    return out & (np.abs(x - y + u) > axes[0]), max(radius * _scale(np.diff(y)), floor)


def taken_back(x: np.ndarray, half: int) -> np.ndarray:
    """Runs of up to BACK_WITHIN outliers which the series enters and leaves by steps, to one side, beyond the ellipsoid."""
    out = np.zeros(len(x), bool)
    mask, step = phase_space_outliers(x, half, PRICE_WIDTH, PRICE_FLOOR)
    for a, b in _runs(mask):
        if b - a <= BACK_WITHIN and 0 < a and b < len(x):
            run, before, after = x[a:b], x[a - 1], x[b]
            out[a:b] = max(run.min() - max(before, after), min(before, after) - run.max()) >= step
    return out


def _runs(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return zip(edges[::2], edges[1::2])


def standstill(x: np.ndarray, trading: np.ndarray) -> np.ndarray:
    """Repeats, after the first, in runs of one value with STILL readings or more on days with trading."""
    out = np.zeros(len(x), bool)
    if len(x) < STILL:
        return out
    starts = np.concatenate([[0], np.flatnonzero(np.diff(x) != 0) + 1, [len(x)]])
    for k in np.flatnonzero(np.diff(starts) >= STILL):
        a, b = starts[k], starts[k + 1]
        if trading[a:b].sum() >= STILL:
            out[a + 1 : b] = trading[a + 1 : b]
    return out


def _splits(close: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factors that prices don't bear out, log factor to add from each reading on). close: nan where it is unusable."""
    wrong = np.zeros(len(close), bool)
    shift = np.zeros(len(close))
    good = np.flatnonzero(~np.isnan(close))
    for i in np.flatnonzero(~np.isnan(factor) & (factor != 1)):
        if factor[i] <= 0:
            wrong[i] = True
            continue
        k = np.searchsorted(good, i)
        before, after = close[good[max(0, k - 3) : k]], close[good[k : k + 3]]
        if not len(before) or not len(after):
            continue
        step, stated = np.log(np.median(after) / np.median(before)), np.log(factor[i])
        if abs(step + stated) < abs(stated) / 2:
            shift[i:] += stated
        else:
            wrong[i] = True
    return wrong, shift


def _series_faults(c: dict[str, np.ndarray]) -> list[tuple[np.ndarray, str, str]]:
    """(positions, field, reason) of one series in order of days."""
    close, adj, volume = c["close"], c["adj_close"], c["volume"]
    trading = ~(volume == 0)  # an unknown volume is no sign of a day without trading
    faults: list[tuple[np.ndarray, str, str]] = []
    add = lambda at, field, reason: len(at) and faults.append((at, field, reason))
    with np.errstate(invalid="ignore", divide="ignore"):
        impossible = (close <= 0) | (close > c["high"] * 1.0001) | (close < c["low"] * 0.9999)
        add(np.flatnonzero(impossible), "close", "impossible")
        add(np.flatnonzero(adj <= 0), "adj_close", "impossible")
        add(np.flatnonzero((volume < 0) | (volume >= VOLUME_BOUND)), "volume", "impossible")
        wrong, shift = _splits(np.where(impossible, np.nan, close), c["split_factor"])
        add(np.flatnonzero(wrong), "split_factor", "not borne out")
        for field, values, more in (("close", close, shift), ("adj_close", adj, None)):
            at = np.flatnonzero(values > 0)
            if len(at) > 2:
                x = np.log(values[at]) + (more[at] if more is not None else 0.0)
                add(at[taken_back(x, 4)], field, "spike")
        at = np.flatnonzero((volume > 0) & (volume < VOLUME_BOUND))
        if len(at) > 2:
            x = np.log(volume[at])
            mask, _ = phase_space_outliers(x, 10, VOLUME_WIDTH, VOLUME_FLOOR)
            for a, b in _runs(mask):
                # volume differs from day to day by itself, so a run is taken back when it ends
                if b - a <= BACK_WITHIN and x[a:b].min() > np.median(x[max(0, a - 10) : b + 10]):
                    add(at[a:b], "volume", "spike")
        for field, values in (("close", close), ("adj_close", adj), ("volume", volume)):
            at = np.flatnonzero(~np.isnan(values))
            add(at[standstill(values[at], trading[at])], field, "standstill")
    return faults


def _scan(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by source, series and day; holds one series and one batch."""

    def flush(t: pa.Table, last: bool) -> tuple[list[tuple], pa.Table]:
        source, series = (t.column(k).combine_chunks().dictionary_encode() for k in ("source", "series"))
        source, series = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (source, series))
        codes = source.indices.to_numpy().astype(np.int64) * (len(series.dictionary) + 1) + series.indices.to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
        keep = len(codes) if last else cuts[-2]
        values = {f: t.column(f).to_numpy() for f in fields}
        rows: list[tuple] = []
        days = t.column("day").to_pylist() if keep else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > keep:
                break
            for at, field, reason in _series_faults({f: v[a:b].astype(float) for f, v in values.items()}):
                key = (source.dictionary[source.indices[int(a)].as_py()].as_py(), series.dictionary[series.indices[int(a)].as_py()].as_py())
                rows.extend((*key, days[a + i], field, reason) for i in at)
        return rows, t.slice(keep)

    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None or rest.num_rows == 0 else pa.concat_tables([rest, t])
        if t.num_rows == 0:
            continue
        rows, rest = flush(t, False)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)
    if rest is not None and rest.num_rows:
        rows, _ = flush(rest, True)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def implausible(readings: DataFrame) -> DataFrame:
    """(source, series, day, field, reason), distinct; a reading can have several reasons.

    readings: source, series strings, day date, high, low, close, adj_close, volume, split_factor and known_at timestamp;
    extra columns are dropped. Rows without source, series or day are left out, null readings are no faults. A series has
    one reading per day, the one known last (then the greatest), so however often rows come, a series is no longer than
    its calendar; that is aggregated before the shuffle. Series of under three readings have bounds only."""
    fields = ["high", "low", "close", "adj_close", "volume", "split_factor"]
    rows = readings.filter("source is not null and series is not null and day is not null").select("source", "series", "day", "known_at", *[F.col(f).cast("double").alias(f) for f in fields])
    one = rows.groupBy("source", "series", "day").agg(F.max(F.struct("known_at", *fields)).alias("r")).select("source", "series", "day", *[f"r.{f}" for f in fields])
    ordered = one.repartition("source", "series").sortWithinPartitions("source", "series", "day")
    return ordered.mapInArrow(partial(_scan, fields=fields), "source string, series string, day date, field string, reason string")
