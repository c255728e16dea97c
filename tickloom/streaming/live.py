"""Structured Streaming forms: state is bounded by a watermark, or one row a key."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(s: DataFrame, ts: str, width: str, late: str, keys: Sequence[str] = (), slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates of fixed or sliding event-time windows; ticks later than `late` are left out."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = s.withWatermark(ts, late).groupBy(window, *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def distinct_within(s: DataFrame, ts: str, keys: Sequence[str], late: str) -> DataFrame:
    """The first tick of each of `keys` within the watermark."""
    return s.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def changes(s: DataFrame, key: str, by: Sequence[str], value: str) -> DataFrame:
    """Ticks whose value differs from the one before of the same key.

    The state is each key's last value.  Ticks are put in order within a
    micro-batch; across batches they count in order of arrival.
    """
    kind = s.schema

    def step(_, frames, state):
        last, some = state.get if state.exists else (None, False)
        # A key's batch comes in several frames: keep them until all are read, to sort them.
        f = pd.concat(list(frames)).sort_values(list(by), kind="stable")
        v = f[value].astype(object).where(f[value].notna(), None)
        before = v.shift(1)
        before.iloc[0] = last
        same = (v == before) | (v.isna() & before.isna())
        if not some:
            same.iloc[0] = False
        state.update((v.iloc[-1], True))
        yield f[~same.astype(bool)]

    state = f"last {kind[value].dataType.simpleString()}, some boolean"
    return s.groupBy(key).applyInPandasWithState(step, kind, state, "append", "NoTimeout")
