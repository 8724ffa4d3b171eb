"""The event operators on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounce_stream(rows: DataFrame, key: str, ts: str, arg: str, quiet: str, late: str) -> DataFrame:
    """Debounce with a watermark: a burst fires when the watermark passes its quiet time."""
    marked = rows.withWatermark(ts, late)
    burst = marked.groupBy(key, F.session_window(ts, quiet).alias("w"))
    return burst.agg(F.max_by(arg, ts).alias(arg), F.count("*").alias("n")).select(key, F.col("w.end").alias("fired"), arg, "n")


def throttle_stream(rows: DataFrame, key: str, ts: str, seconds: float, late: str) -> DataFrame:
    """Throttle with one number of state a key; the rows of a trigger are taken in the order of time.

    A key's state goes when the watermark is past the time at which any row passes again.  What a trigger holds of one
    key is held at once: bound it by the source's options.
    """
    gap = int(seconds * 1_000_000)
    own = rows.withWatermark(ts, late).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    schema = own.schema

    def passing(_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        frame = pd.concat(list(frames)).sort_values("_us", kind="stable")
        keep = []
        for t in frame["_us"].tolist():
            ok = last is None or t - last >= gap
            keep.append(ok)
            last = t if ok else last
        state.update((last,))
        state.setTimeoutTimestamp(max((last + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield frame[keep]

    out = own.groupBy(key).applyInPandasWithState(passing, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.drop("_us")


def latest_stream(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key so far (output mode update or complete)."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(key, "last.*")
