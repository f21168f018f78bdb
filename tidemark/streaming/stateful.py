"""Streaming forms: the push of latest signals, rate limits, lockouts, replay guard."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import signals


def read_stream(spark: SparkSession, path: str, schema: str, time: str = "ts", delay: str = "10 minutes", glob: str | None = None) -> DataFrame:
    """A stream of Parquet files with event time and watermark; times without a zone count as UTC."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.parquet(path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def push(bars: DataFrame, sink: Callable[[DataFrame], None], all_bars: Callable[[], DataFrame], every: str = "30 seconds", watchlist: Callable[[], DataFrame] | None = None):
    """On each trigger with new bars the signals are computed anew from the whole table and handed to the sink as a snapshot: all of them, or (user_id, signal...) of what each user watches if there is a watchlist(user_id, asset). Exchange preferences don't apply."""

    def snapshot(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            found = signals.compute(all_bars())
            sink(found if watchlist is None else signals.watched(found, watchlist().select("user_id", "asset", F.lit(False).alias("preferred"))))

    return bars.writeStream.foreachBatch(snapshot).trigger(processingTime=every)


def keep(state: GroupState, value: tuple, until: float) -> None:
    """The key's new state, which goes when the watermark passes until (in seconds)."""
    state.update(value)
    state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs()) + 1)


def in_order(batches: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """All rows that a key has in a trigger, by time; they come in several batches, which are in no order."""
    return pd.concat(list(batches)).sort_values(["t", by], ignore_index=True)


def fixed_windows(requests: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Counts by key in windows that begin with the key's first request and last `seconds` (an INCR with expiry): request_id, seen, allowed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (0.0, 0)
        rows = in_order(batches, "request_id")
        times, seen, i = rows["t"].to_numpy(), np.zeros(len(rows), np.int64), 0
        while i < len(times):
            if n == 0 or times[i] >= start + seconds:
                start, n = float(times[i]), 0
            end = max(i + 1, int(np.searchsorted(times, start + seconds, "left")))
            seen[i:end] = np.arange(n + 1, n + 1 + end - i)
            n, i = n + end - i, end
        yield pd.DataFrame({"request_id": rows["request_id"], "seen": seen, "allowed": seen <= limit})
        keep(state, (start, n), start + seconds)

    keyed = requests.select("key", "request_id", "ts", F.col("ts").cast("double").alias("t"))
    return keyed.groupBy("key").applyInPandasWithState(step, "request_id long, seen long, allowed boolean", "start double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def sliding_windows(requests: DataFrame, seconds: int, limit: int, late: int = 600) -> DataFrame:
    """request_id, seen, allowed: requests of the key in the trailing window, both ends included; refused ones count. The state holds the times of one window, and of the `late` seconds before it for requests that come late."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = np.array(state.get[0] if state.exists else [], float)
        rows = in_order(batches, "request_id")
        times = rows["t"].to_numpy()
        known = np.searchsorted(before, times, "right") - np.searchsorted(before, times - seconds, "left")
        seen = known + np.arange(1, len(times) + 1) - np.searchsorted(times, times - seconds, "left")
        yield pd.DataFrame({"request_id": rows["request_id"], "seen": seen, "allowed": seen <= limit})
        both = np.sort(np.concatenate([before, times]))
        both = both[both >= both[-1] - seconds - late]
        keep(state, (both.tolist(),), float(both[-1]) + seconds)

    keyed = requests.select("key", "request_id", "ts", F.col("ts").cast("double").alias("t"))
    return keyed.groupBy("key").applyInPandasWithState(step, "request_id long, seen long, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def lockout(attempts: DataFrame, failures: int = 5, window: int = 900, lock: int = 900) -> DataFrame:
    """attempt_id, outcome (ok, failed, locked, refused): failures within the window lock the key and clear the list; a success clears both."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until, held = state.get if state.exists else (0.0, [])
        times, out = deque(held), []
        rows = in_order(batches, "attempt_id")
        for t, failed in zip(rows["t"].tolist(), rows["failed"].tolist()):
            if t < until:
                out.append("refused")
            elif not failed:
                until = 0.0
                times.clear()
                out.append("ok")
            else:
                while times and times[0] <= t - window:
                    times.popleft()
                times.append(t)
                out.append("failed")
                if len(times) >= failures:
                    until, out[-1] = t + lock, "locked"
                    times.clear()
        yield pd.DataFrame({"attempt_id": rows["attempt_id"], "outcome": out})
        keep(state, (until, list(times)), max(until, max(times, default=0.0) + window))

    keyed = attempts.select("key", "attempt_id", "ts", F.col("ts").cast("double").alias("t"), "failed")
    return keyed.groupBy("key").applyInPandasWithState(step, "attempt_id long, outcome string", "until double, times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def replay_guard(requests: DataFrame, nonce: str = "nonce") -> DataFrame:
    """The first request of each nonce within the watermark's delay."""
    return requests.dropDuplicatesWithinWatermark([nonce])


def request_counts(requests: DataFrame, every: str = "1 minute") -> DataFrame:
    """Counts of requests by key in tumbling windows of event time."""
    return requests.groupBy(F.window("ts", every), "key").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "key", "n")
