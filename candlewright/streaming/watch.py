"""Gaps and order faults of a stream, reported when they are due.

Order is checked as rows arrive, before anything is sorted. Gaps are found in order of time behind the
watermark; a timer on each series' last bar reports it as silent as soon as the watermark is past the
limit, whether or not another bar ever comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from candlewright.streaming.closing import watermarked
from candlewright.streaming.runs import instant, wall_clock
from candlewright.streaming.structure import use_rocksdb

EVENTS = "symbol string, kind string, since long, until long"


class Watch(StatefulProcessor):
    """Rows (at, seq) to events: ``order`` at once, ``gap`` and ``silent`` once the watermark allows."""

    def __init__(self, width: int, limit: int):
        self.width, self.limit = width, limit                # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrived = handle.getValueState("arrived", "at long")
        self.passed = handle.getValueState("passed", "at long, silent boolean")
        self.waiting = handle.getListState("waiting", "at long")

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))            # the first whole millisecond not before it

    def _events(self, key, kind: str, since, until) -> pd.DataFrame:
        return pd.DataFrame({"symbol": key[0], "kind": kind, "since": pd.Series(since, dtype="Int64"),
                             "until": pd.Series(until, dtype="Int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows)).sort_values("seq", kind="stable")["at"].to_numpy(np.int64)
        before = self.arrived.get()
        chain = came if before is None else np.append(np.int64(before[0]), came)
        back = np.flatnonzero(chain[1:] < chain[:-1])
        self.arrived.update((int(came[-1]),))
        self.waiting.appendList([(int(x),) for x in np.unique(came)])
        self._wake(int(came.min()))
        if len(back):
            yield self._events(key, "order", chain[back], chain[back + 1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = np.unique(np.array([r[0] for r in self.waiting.get()], np.int64))
        ready, rest = rows[rows <= now], rows[rows > now]
        last, silent = self.passed.get() or (None, False)
        if len(ready):
            if len(rest):
                self.waiting.put([(int(x),) for x in rest])
                self._wake(int(rest[0]))
            else:
                self.waiting.clear()
            chain = ready if last is None else np.append(np.int64(last), ready[ready > last])
            wide = np.flatnonzero(np.diff(chain) > self.width)
            if len(wide):
                yield self._events(key, "gap", chain[wide], chain[wide + 1])
            if len(chain) > 1 or last is None:
                last, silent = int(chain[-1]), False
        if last is None:
            return
        if not silent and last + self.limit <= now:
            silent = True
            yield self._events(key, "silent", [last], [None])
        elif not silent and len(ready):
            self._wake(last + self.limit)
        self.passed.update((last, silent))

    def close(self) -> None:
        pass


def watch(arrivals: DataFrame, bar_seconds: int, silent_seconds: int = 86_400, time: str = "ts_utc", sequence: str = "seq",
          delay: str = "2 hours", closing: str | None = None) -> DataFrame:
    """(symbol, kind, since, until, seconds) of a stream of bars or ticks.

    ``order``: a row came after one of a later time; since and until are the times of both. ``gap``: two
    neighbours in time are more than ``bar_seconds`` apart. ``silent``: nothing for ``silent_seconds`` after
    since; a gap that ends later is reported as well. Order is that of ``sequence`` within a micro-batch and of
    the micro-batches; rows without a time are left out, and rows of one time are one to the gaps. Rows later
    than the delay are Spark's late rows (``late_rows`` counts them) and take no part, in order neither.
    """
    use_rocksdb(arrivals.sparkSession)
    rows = arrivals.select("symbol", F.col(time).alias("ts_utc"), F.col(sequence).cast("long").alias("seq"))
    rows = watermarked(rows, instant(F.col("ts_utc")), delay, closing).where("event_time IS NOT NULL").select(
        "symbol", "event_time", F.unix_micros("event_time").alias("at"), "seq")
    found = rows.groupBy("symbol").transformWithStateInPandas(
        Watch(bar_seconds * 1_000_000, silent_seconds * 1_000_000), EVENTS, "append", "eventtime")
    return found.select("symbol", "kind", *(wall_clock(F.timestamp_micros(c)).alias(c) for c in ("since", "until")),
                        ((F.col("until") - F.col("since")) / 1e6).alias("seconds"))
