"""Events in order: status changes, latest states, debounce and throttle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(rows: DataFrame, key: str, chunk: Column, order: list[str], value: str, name: str) -> DataFrame:
    """With the value of the row before with the same key.

    Rows are ordered within chunks of a key; only the last row of each chunk is ordered over chunks, so a key with a
    large share of all rows is never sorted in one task.  Chunks must follow the order.
    """
    own = rows.withColumn("_c", chunk)
    here = Window.partitionBy(key, "_c").orderBy(*order)
    ends = own.groupBy(key, "_c").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("last"))
    carried = ends.withColumn("carry", F.lag("last").over(Window.partitionBy(key).orderBy("_c"))).select(F.col(key).alias("_k"), F.col("_c").alias("_d"), "carry")
    inner = own.withColumn("_v", F.lag(F.struct(F.col(value).alias("v"))).over(here))
    met = inner.join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_c").eqNullSafe(F.col("_d")))
    return met.withColumn(name, F.coalesce("_v", "carry")["v"]).select(*rows.columns, name)


def changes(rows: DataFrame, key: str, status: str, order: list[str], chunk: Column) -> DataFrame:
    """Rows whose status isn't empty and differs from that of the row before with the same key."""
    told = rows.where(F.col(status).isNotNull() & (F.col(status) != ""))
    return before(told, key, chunk, order, status, "_before").where(~F.col("_before").eqNullSafe(F.col(status))).drop("_before")


def latest_state(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(key, "last.*")


#: Gaps that make one chunk of a key's events.
CHUNK_GAPS = 16


def _runs(rows: DataFrame, key: str, tie: str, gap: int) -> DataFrame:
    """With _run, the time at which the row's run began; a run ends where the next row comes more than gap later.

    Both the row before and the start of the run are found within chunks of time and carried from chunk to chunk, so a
    key with a large share of all rows is never worked on in one task.  rows have _us, microseconds.
    """
    chunk = F.floor(F.col("_us") / (CHUNK_GAPS * gap))
    own = before(rows, key, chunk, ["_us", tie], "_us", "_last").withColumn("_c", chunk)
    own = own.withColumn("_start", F.when(F.col("_last").isNull() | (F.col("_us") - F.col("_last") > gap), F.col("_us")))
    within = Window.partitionBy(key, "_c").orderBy("_us", tie).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy(key, "_c").agg(F.max("_start").alias("s")).select(F.col(key).alias("_k"), F.col("_c").alias("_d"), F.max("s").over(over).alias("_carry"))
    met = own.withColumn("_run", F.max("_start").over(within)).join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_c") == F.col("_d")))
    return met.withColumn("_run", F.coalesce("_run", "_carry")).select(*rows.columns, "_run")


def debounce(rows: DataFrame, key: str, ts: str, arg: str, quiet_seconds: float) -> DataFrame:
    """(key, fired, arg, n): one call a burst, with the last argument, when the quiet time has passed.

    An event exactly at the end of the quiet time still belongs to the burst; events without a time are left out.
    """
    quiet = int(quiet_seconds * 1_000_000)
    own = rows.where(F.col(ts).isNotNull()).select(key, ts, arg).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    burst = _runs(own, key, arg, quiet).groupBy(key, "_run").agg(F.max(ts).alias("_end"), F.max_by(arg, F.struct(ts, arg)).alias(arg), F.count("*").alias("n"))
    return burst.select(key, (F.col("_end") + F.make_dt_interval(secs=F.lit(quiet / 1e6))).alias("fired"), arg, "n")


def _same(a: object, b: object) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def _whole(frames: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Frames of whole chunks, of rows that come sorted by key and chunk, and the bounds of each chunk."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        own, c = frame[key], frame["_c"].to_numpy()
        new = np.ones(len(frame), dtype=bool)
        new[1:] = (c[1:] != c[:-1]) | ~(own.eq(own.shift()) | own.isna() & own.shift().isna()).to_numpy()[1:]
        if rest and _same(rest[-1][key].iloc[-1], own.iloc[0]) and rest[-1]["_c"].iloc[-1] == c[0]:
            new[0] = False
        at = np.flatnonzero(new)
        if len(at):
            done = pd.concat([*rest, frame.iloc[: at[-1]]]) if rest else frame.iloc[: at[-1]]
            if len(done):
                held = sum(map(len, rest))
                starts = sorted({0, *(at[:-1] + held).tolist()})
                yield done, list(zip(starts, [*starts[1:], len(done)]))
            rest = [frame.iloc[at[-1] :]]
        else:
            rest.append(frame)
    if rest:
        done = pd.concat(rest)
        yield done, [(0, len(done))]


def _hops(us: np.ndarray, gap: int) -> np.ndarray:
    """For each row the next that passes if it does; the number of rows if there is none."""
    return np.searchsorted(us, us + gap, side="left")


def throttle(rows: DataFrame, key: str, ts: str, tie: str, seconds: float) -> DataFrame:
    """Rows that pass: the first of a key, then each that comes at least so long after the last that passed.

    Sequential by nature, but what a chunk of time does to the last passing time is a step function.  The functions of
    all chunks are made at once, composed a key, chunk after chunk, and then all chunks are walked at once from the time
    that they are entered with; only the small functions of a key ever meet in one task.  Rows without a time are left out.
    """
    gap = int(seconds * 1_000_000)
    own = rows.where(F.col(ts).isNotNull()).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    own = own.withColumn("_c", F.floor(F.col("_us") / (CHUNK_GAPS * gap)))
    kind = dict(rows.dtypes)[key]

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in _whole(frames, key):
            every, chunk = frame["_us"].to_numpy(), frame["_c"].to_numpy()
            upto, out = [], []
            for a, b in bounds:
                us, n = every[a:b], b - a
                after, end = _hops(us, gap), np.arange(n)
                # rows at which a walk may begin: up to a gap after the chunk's begin, and the next one
                first = min(n, int(np.searchsorted(us, (int(chunk[a]) * CHUNK_GAPS + 1) * gap)) + 1)
                end = end[:first]
                while True:  # a chunk has no more passing rows than gaps and one
                    then = after[end]
                    if (then == n).all():
                        break
                    end = np.where(then < n, then, end)
                exits = us[end]
                last = np.append(exits[1:] != exits[:-1], True)  # equal ends need one step
                upto.append(us[:first][last].tolist())
                out.append(exits[last].tolist())
            at = [a for a, _ in bounds]
            yield pd.DataFrame({key: frame[key].iloc[at].to_numpy(), "_c": chunk[at], "upto": upto, "exit": out})

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, own_key, allowed = False, None, 0
        for frame in frames:
            entered = []
            for k, upto, out in zip(frame[key], frame["upto"], frame["exit"]):
                if not begun or not _same(k, own_key):
                    begun, own_key, allowed = True, k, -(1 << 62)
                entered.append(allowed)
                at = int(np.searchsorted(upto, allowed, side="left"))
                if at < len(out):
                    allowed = int(out[at]) + gap
            yield pd.DataFrame({"_k": frame[key], "_d": frame["_c"], "_allowed": entered})

    def passing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in _whole(frames, key):
            every, allowed = frame["_us"].to_numpy(), frame["_allowed"].to_numpy()
            keep = np.zeros(len(frame), dtype=bool)
            for a, b in bounds:
                us = every[a:b]
                at = int(np.searchsorted(us, allowed[a], side="left"))
                while at < len(us):
                    keep[a + at] = True
                    at = int(np.searchsorted(us, us[at] + gap, side="left"))
            yield frame[keep]

    spread = own.repartition(key, "_c").sortWithinPartitions(key, "_c", "_us", tie)
    made = spread.select(key, "_c", "_us").mapInPandas(steps, f"{key} {kind}, _c long, upto array<long>, exit array<long>")
    entered = made.repartition(key).sortWithinPartitions(key, "_c").mapInPandas(entries, f"_k {kind}, _d long, _allowed long")
    met = own.join(entered, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_c") == F.col("_d"))).select(*own.columns, "_allowed")
    ordered = met.repartition(key, "_c").sortWithinPartitions(key, "_c", "_us", tie)
    return ordered.mapInPandas(passing, met.schema).select(*rows.columns)


def newest(rows: DataFrame, key: str, token: str) -> DataFrame:
    """Of several loads of one key only that of the newest token."""
    return latest_state(rows, key, token)


def every(page: Column, n: int = 5) -> Column:
    """Whether a page number is due for a sign of life."""
    return page % n == 0


def progress(phase: Column, done: Column, total: Column) -> Column:
    """Steps done of a job with four phases, pages counted within the first."""
    share = F.when(total > 0, done / total).otherwise(F.lit(0.0))
    return F.when(phase == "ocr", share).when(phase == "translation", F.lit(1.0)).when(phase == "site", F.lit(2.0)).when(phase == "cleanup", F.lit(3.0)).when(phase == "done", F.lit(4.0)).otherwise(F.lit(0.0))
