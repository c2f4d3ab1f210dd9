"""Running a stream over what is there, and counting what came too late."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def instant(ts: Column) -> Column:
    """UTC wall clock as an instant, as watermarks need; no session zone involved."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), ts))


def wall_clock(ts: Column) -> Column:
    zero = F.lit(0)
    seconds = (F.unix_micros(ts).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return _epoch() + F.make_dt_interval(zero, zero, zero, seconds)


class _LateRows(StreamingQueryListener):
    """State rows refused for coming after the watermark, by run and batch; Spark keeps only the latest reports."""

    def __init__(self):
        self.runs: dict[str, dict[int, int]] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        report = event.progress
        dropped = sum(op.numRowsDroppedByWatermark for op in report.stateOperators)
        self.runs.setdefault(str(report.runId), {})[report.batchId] = dropped

    def onQueryTerminated(self, event):
        self.ended.setdefault(str(event.runId), threading.Event()).set()


_late: dict[str, _LateRows] = {}


def _listener(spark: SparkSession) -> _LateRows:
    app = spark.sparkContext.applicationId
    if app not in _late:
        _late[app] = _LateRows()
        spark.streams.addListener(_late[app])
    return _late[app]


def write_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a later call with the same paths resumes."""
    listener = _listener(rows.sparkSession)
    query = (rows.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    # reports arrive in order, so all are in when the end is
    listener.ended.setdefault(str(query.runId), threading.Event()).wait(60)
    return query


def late_rows(query: StreamingQuery) -> int:
    """State rows that all batches of a run of ``write_available`` refused for coming after the watermark."""
    app = query._jsq.sparkSession().sparkContext().applicationId()
    return sum(_late[app].runs.get(str(query.runId), {}).values())
