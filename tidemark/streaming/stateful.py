"""Decisions by key over unbounded streams, with the state Spark keeps for them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spaced(stream: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """(key, at) of events kept when at least ``seconds`` after the last one kept of their key; state is one time per key.

    Events of a batch are taken in order; one that comes after a later one was kept is not kept."""

    def decide(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        last = state.getOption[0] if state.exists else None
        times = sorted(t for p in parts for t in p["at"])
        kept = []
        for t in times:
            if last is None or t - last >= seconds:
                kept.append(t)
                last = t
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({"key": [k[0]] * len(kept), "at": kept})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.unix_timestamp(F.col(at).cast("timestamp")).alias("at")).filter("key is not null and at is not null")
    return rows.groupBy("key").applyInPandasWithState(decide, "key string, at long", "last long", "append", "NoTimeout")
