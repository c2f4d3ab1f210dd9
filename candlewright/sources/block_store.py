"""Bars stored by block, so that frames over them need no exchange.

A table bucketed by (symbol, block) in which each block also holds the rows its frames look back to.
A window by block finds its rows together as they are stored, whatever the indicator: the shuffle that
cuts a series into blocks is paid once, when bars are stored. Filters on symbols and times
reach the scan. The table is known to the session's catalog by its name, its files lie where it says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.operators.blocks import BLOCK_ROWS, home_rows, with_halo
from candlewright.operators.studies import Study, study_gates

LOOKBACK, BLOCK, BUCKETS = "candlewright.lookback", "candlewright.block_rows", "candlewright.buckets"


def store_blocks(bars: DataFrame, name: str, path: str, lookback: int = 256, buckets: int = 64,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Store indexed bars as table ``name`` at ``path``; frames may look back ``lookback`` rows.

    A bucket takes whole blocks, many of them, so a busy symbol is spread over all buckets. Size ``buckets``
    so that one is some hundred megabytes.
    """
    rows = with_halo(bars, lookback, block_rows)
    # tasks are laid out as buckets are, so each bucket is one file
    (rows.repartition(buckets, "symbol", "_blk").sortWithinPartitions("symbol", "_blk", "bar_no")
     .write.bucketBy(buckets, "symbol", "_blk").sortBy("symbol", "_blk", "bar_no")
     .option("path", path).saveAsTable(name))
    spark = bars.sparkSession
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{LOOKBACK}' = '{lookback}', '{BLOCK}' = '{block_rows}', '{BUCKETS}' = '{buckets}')")
    return spark.table(name)


def _properties(spark: SparkSession, name: str) -> dict[str, int]:
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").where("key LIKE 'candlewright.%'").collect()
    return {r.key: int(r.value) for r in rows}


def stored_bars(spark: SparkSession, name: str) -> DataFrame:
    """The bars of the table, each once."""
    return home_rows(spark.table(name))


def studies_on_blocks(spark: SparkSession, name: str, *studies: Study, gates: bool = True,
                      symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Study columns and gates of stored bars without an exchange; only studies of a fixed lookback can be asked for.

    With symbols only their rows are read. With ``start`` and ``end`` (bar times, inclusive) only bars
    between come out, but the rows that their frames look back to are read as well.
    """
    known = _properties(spark, name)
    deep = [s.name for s in studies if s.lookback > known[LOOKBACK]]
    if deep:
        raise ValueError(f"stored with {known[LOOKBACK]} rows to look back to, too few for {deep}")
    if any(s.smooth or s.nested or s.daily for s in studies):
        raise ValueError("smoothed and daily columns reach beyond a block")
    out = spark.table(name)
    if symbols is not None:
        out = out.where(F.col("symbol").isin(symbols))
    if end is not None:
        out = out.where(F.col("ts_utc") <= F.lit(end).cast("timestamp_ntz"))     # frames never look ahead
    for i in range(max((len(s.steps) for s in studies), default=0)):
        out = out.withColumns({k: v for s in studies if i < len(s.steps) for k, v in s.steps[i].items()})
    out = home_rows(out)
    if start is not None:
        out = out.where(F.col("ts_utc") >= F.lit(start).cast("timestamp_ntz"))
    return study_gates(out, studies) if gates else out
