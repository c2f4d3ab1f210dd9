"""Zig-zag and supertrend of a bar stream: the batch rules with their state in the state store.

A series' state is a few numbers. Bars wait in the store until the watermark has passed them, so
rows may come in any order within the delay; then they go through the same kernel as in a batch, in
order of time. Waiting rows are bounded by the delay and one micro-batch. Both parts are versioned
with the query's checkpoint: a run that failed or ended resumes from it, and a lost executor's state
is loaded from there by another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from candlewright.operators.chained import Kernel
from candlewright.operators.structure import supertrend_bars_kernel, zigzag_kernel
from candlewright.schema import PRICES
from candlewright.streaming.closing import watermarked
from candlewright.streaming.runs import instant, wall_clock

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need this state store; another one that the session names is left alone."""
    if spark.conf.get(_PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKSDB)


class InOrder(StatefulProcessor):
    """Feeds each key's rows to a kernel in order of time, once the watermark has passed them.

    Rows have ``at`` (microseconds) and the kernel's inputs as doubles. Of rows of one time the last to
    come counts; rows not after the last one fed are left out, as the batch result they belong to is out.
    """

    def __init__(self, kernel: Kernel, initial: list[float], added: list[str], inputs: list[str]):
        self.kernel, self.initial, self.added, self.inputs = kernel, initial, added, inputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", "at long, state array<double>")
        self.waiting = handle.getListState("waiting", "at long, " + ", ".join(f"{c} double" for c in self.inputs))
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part[["at", *self.inputs]]
            self.waiting.appendList([(int(r[0]), *map(float, r[1:])) for r in part.itertuples(index=False)])
            least = int(part["at"].min())
            first = least if first is None else min(first, least)
        due = self.due.get()
        if first is not None and (due is None or first < due[0]):
            self._wake(first)
        return iter(())

    def _wake(self, at: int) -> None:
        self.due.update((at,))
        self.handle.registerTimer(-(-at // 1000))             # the first whole millisecond not before it

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.DataFrame(list(self.waiting.get()), columns=["at", *self.inputs])
        ready, rest = rows[rows["at"] <= passed], rows[rows["at"] > passed]
        if ready.empty:
            return
        if rest.empty:
            self.waiting.clear()
            self.due.clear()
        else:
            self.waiting.put([(int(r[0]), *map(float, r[1:])) for r in rest.itertuples(index=False)])
            self._wake(int(rest["at"].min()))
        last, state = self.carried.get() or (np.iinfo(np.int64).min, self.initial)
        ready = ready[ready["at"] > last].drop_duplicates("at", keep="last").sort_values("at", ignore_index=True)
        if ready.empty:
            return
        columns, state = self.kernel(ready, list(state))
        self.carried.update((int(ready["at"].iloc[-1]), [float(x) for x in state]))
        yield pd.DataFrame({"symbol": key[0], "at": ready["at"], **{c: pd.Series(columns[c], dtype=object) for c in self.added}})

    def close(self) -> None:
        pass


def _in_order(bars: DataFrame, kernel: Kernel, initial: list[float], added: str, inputs: list[str],
              delay: str, closing: str | None) -> DataFrame:
    use_rocksdb(bars.sparkSession)
    rows = watermarked(bars.select("symbol", "ts_utc", *(F.col(c).cast("double").alias(c) for c in inputs)),
                       instant(F.col("ts_utc")), delay, closing)
    rows = rows.where("event_time IS NOT NULL").withColumn("at", F.unix_micros("event_time"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in inputs})
    fields = T.StructType.fromDDL(added)
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("at", T.LongType()), *fields.fields])
    fed = rows.groupBy("symbol").transformWithStateInPandas(
        InOrder(kernel, initial, fields.names, inputs), schema, "append", "eventtime")
    return fed.select("symbol", wall_clock(F.timestamp_micros("at")).alias("ts_utc"), *fields.names)


def stream_zigzag(bars: DataFrame, pct: float = 0.2, delay: str = "2 hours", closing: str | None = None) -> DataFrame:
    """(symbol, ts_utc, zz_trend, zz_bias) of a bar stream, as ``add_zigzag`` gives them for its table.

    A bar comes out once the watermark has passed it; ``closing`` is the folder of a closing row.
    """
    return _in_order(bars, zigzag_kernel(pct), [0.0] * 6, "zz_trend int, zz_bias int", ["high", "low", "close"], delay, closing)


def stream_supertrend(bars: DataFrame, n: int = 10, factor: float = 3.0, delay: str = "2 hours",
                      closing: str | None = None) -> DataFrame:
    """(symbol, ts_utc, supertrend, st_direction) of a bar stream, as ``add_supertrend`` gives them for its table.

    The range average is carried along, from the first true range on.
    """
    kernel, initial = supertrend_bars_kernel(n, factor)
    return _in_order(bars, kernel, initial, "supertrend double, st_direction int", PRICES[1:], delay, closing)
