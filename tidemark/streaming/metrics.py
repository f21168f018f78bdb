"""Metrics of requests while a query runs: counters and a latency histogram as observed aggregates, gathered by a listener."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Upper bounds of the histogram, in the unit of the latencies.
BOUNDS = (10.0, 50.0, 100.0)


def aggregates(bounds: tuple[float, ...] = BOUNDS, routes: tuple[tuple[str, str], ...] = ()) -> list[Column]:
    """Counters that add up over batches: requests, sum of latencies, cumulative buckets and errors, over all and for each named route (method, path)."""

    def of(prefix: str, own: Column) -> list[Column]:
        le = [F.count_if(own & (F.col("latency") <= b)).alias(f"{prefix}le_{b:g}") for b in bounds]
        return [F.count_if(own).alias(f"{prefix}n"), F.coalesce(F.sum(F.when(own, F.col("latency"))), F.lit(0.0)).alias(f"{prefix}sum"), F.count_if(own & (F.col("status") >= 500)).alias(f"{prefix}errors"), *le]

    return of("", F.lit(True)) + [c for m, p in routes for c in of(f"{m} {p} ", (F.col("method") == m) & (F.col("path") == p))]


def observed(requests: DataFrame, name: str = "http", bounds: tuple[float, ...] = BOUNDS, routes: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """The requests (method, path, status, latency), counted on their way: no second pass, no shuffle."""
    return requests.observe(name, *aggregates(bounds, routes))


class Totals(StreamingQueryListener):
    """Adds up what each trigger of a query has observed under a name. A query that restarts from its checkpoint reports only its new triggers; a batch that is run again is counted once."""

    def __init__(self, name: str = "http"):
        self.name, self.lock = name, threading.Lock()
        self._batches: dict[str, dict[int, dict]] = defaultdict(dict)
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            with self.lock:
                self._batches[str(event.progress.id)][event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def totals(self) -> dict[str, float]:
        with self.lock:
            out: dict[str, float] = defaultdict(int)
            for batches in self._batches.values():
                for row in batches.values():
                    for k, v in row.items():
                        out[k] += v or 0
            return dict(out)
