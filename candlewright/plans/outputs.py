"""The outputs of a run as one set: all files of it or none, with totals taken while they are written.

``base/run=<id>/`` has ``bars`` (every bar with its signal at each stage), ``signals``, ``trades`` and
``report``. The job that writes ``bars`` counts the signal flow and the run statistics as rows pass, so
these need no pass of their own; the other outputs read what was written. A run counts once its file
``COMMITTED`` is there, which is written last and holds the totals. Readers see committed runs only.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from candlewright.operators import funnel
from candlewright.plans.strategy import Strategy, strategy_report, trades_of
from candlewright.sources import bars as sinks

MARK = "COMMITTED"
OUTPUTS = ("bars", "signals", "trades", "report")


def observed_columns() -> list:
    """Run statistics and the wide signal flow, over all rows."""
    statistics = {"bars": F.count(F.lit(1)), "first_ts": F.min("ts").cast("string"), "last_ts": F.max("ts").cast("string"),
                  "buy": F.count_if(F.col("sig_raw") == "BUY"), "sell": F.count_if(F.col("sig_raw") == "SELL")}
    return [c.alias(k) for k, c in statistics.items()] + funnel.flow_columns()


def write_run(frame: DataFrame, cfg: Strategy, base: str, run: str | None = None) -> str:
    """Write all outputs of a strategy's frame (``run_strategy``); returns the run's id.

    An id that is given may be written once. What a failed run has left is never read, and goes with ``discard``.
    """
    spark = frame.sparkSession
    run = run or uuid.uuid4().hex
    folder = f"{base}/run={run}"
    if _mark(spark, base, run) is not None:
        raise ValueError(f"run {run} is there")
    seen = Observation(f"run-{run}")
    frame.observe(seen, *observed_columns()).write.mode("overwrite").parquet(f"{folder}/bars")
    bars = spark.read.schema(frame.schema).parquet(f"{folder}/bars")
    labelled = bars.where("sig_raw IS NOT NULL").withColumns({
        "we_buy": F.col("sig_raw") == "BUY", "we_sell": F.col("sig_raw") == "SELL"})
    sinks.write_signals(labelled, f"{folder}/signals", "overwrite")
    sinks.write_trades(trades_of(bars), f"{folder}/trades", "overwrite")
    sinks.write_report(strategy_report(bars, cfg), f"{folder}/report", "overwrite")
    _commit(spark, base, run, seen.get)
    return run


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _commit(spark: SparkSession, base: str, run: str, totals: dict[str, Any]) -> None:
    """The mark appears whole or not at all: it is written beside its place and moved there."""
    place, files = _path(spark, f"{base}/run={run}/{MARK}")
    beside, _ = _path(spark, f"{base}/run={run}/_{MARK}")
    out = files.create(beside, True)
    try:
        out.write(bytearray(json.dumps(totals, sort_keys=True).encode()))
    finally:
        out.close()
    if not files.rename(beside, place):
        raise RuntimeError(f"run {run} could not be committed")


def _mark(spark: SparkSession, base: str, run: str) -> dict[str, Any] | None:
    place, files = _path(spark, f"{base}/run={run}/{MARK}")
    if not files.exists(place):
        return None
    return json.loads(spark.read.text(f"{base}/run={run}/{MARK}").first()[0])


def committed_runs(spark: SparkSession, base: str) -> list[str]:
    """Ids of committed runs, the oldest first."""
    folder, files = _path(spark, base)
    if not files.exists(folder):
        return []
    found = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        mark, _ = _path(spark, f"{base}/{name}/{MARK}")
        if name.startswith("run=") and files.exists(mark):
            found.append((files.getFileStatus(mark).getModificationTime(), name.removeprefix("run=")))
    return [run for _, run in sorted(found)]


def discard(spark: SparkSession, base: str) -> list[str]:
    """Remove runs that were never committed; none may be under way. Returns their ids."""
    folder, files = _path(spark, base)
    kept = set(committed_runs(spark, base))
    gone = [name for s in (files.listStatus(folder) if files.exists(folder) else ())
            if (name := s.getPath().getName()).startswith("run=") and name.removeprefix("run=") not in kept]
    for name in gone:
        path, _ = _path(spark, f"{base}/{name}")
        files.delete(path, True)
    return [name.removeprefix("run=") for name in gone]


def run_totals(spark: SparkSession, base: str, run: str) -> dict[str, Any]:
    """What was counted while the run was written."""
    totals = _mark(spark, base, run)
    if totals is None:
        raise ValueError(f"run {run} is not committed")
    return totals


def run_funnel(spark: SparkSession, base: str, run: str) -> DataFrame:
    """The signal flow of a whole run, one row per stage, from the totals alone."""
    totals = run_totals(spark, base, run)
    wide = spark.range(1).select(*(F.lit(totals[c]).cast("long").alias(c) for c in funnel.flow_names()))
    return funnel.flow_rows(wide, ())


def read_output(spark: SparkSession, base: str, run: str, output: str) -> DataFrame:
    """An output of a committed run: bars as stored, signals and trades from CSV, the report from JSON."""
    if output not in OUTPUTS:
        raise ValueError(f"unknown output {output!r}")
    run_totals(spark, base, run)
    path = f"{base}/run={run}/{output}"
    if output == "bars":
        return spark.read.parquet(path)
    if output == "report":
        return sinks.read_report(spark, path)
    return sinks.read_signals(spark, path) if output == "signals" else sinks.read_trades(spark, path)
