"""A bar table kept up to date by a tick stream, late ticks included.

Each micro-batch appends its ticks to a store and builds the bars of the slots it touches anew from
that store. Slots are days (or any width the bars divide) and folders of both tables: the ticks are
pruned to the touched ones, and dynamic overwrite replaces these folders of the bar table and no
others. A tick that comes weeks late costs one slot. There is no state and no open window: after
each batch the table equals the batch build over all ticks taken so far.

Both writes replace what a failed attempt of the same batch has left, so a repeat does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from candlewright.functions.columns import DAY_SECONDS
from candlewright.operators.bars import ticks_to_bars
from candlewright.schema import BARS, TICKS

SLOT = T.StructField("slot", T.LongType())
STORED = T.StructType([*TICKS.fields, SLOT, T.StructField("batch", T.LongType())])
KEPT = T.StructType([*BARS.fields, SLOT])


def slot_of(ts: Column | str, slot_seconds: int) -> Column:
    """Number of the slot a time lies in, from the epoch on."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.timestamp_diff("SECOND", epoch, F.date_trunc("second", ts).cast("timestamp_ntz")) / slot_seconds)


def _replace(rows: DataFrame, path: str, *folders: str) -> None:
    (rows.hint("rebalance", *(F.col(c) for c in folders)).sortWithinPartitions(*folders)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path))


def stored_ticks(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(f"{base}/ticks")


def touched_ticks(spark: SparkSession, base: str, batch_id: int) -> DataFrame:
    """All stored ticks of the slots that a batch has ticks in; other folders are not read."""
    touched = stored_ticks(spark, base).where(F.col("batch") == batch_id).select(F.col("slot").alias("_slot")).distinct()
    ticks = stored_ticks(spark, base)
    return ticks.join(touched, ticks["slot"] == touched["_slot"], "left_semi")


def take_batch(ticks: DataFrame, batch_id: int, base: str, seconds: int, zone: str, slot_seconds: int) -> None:
    """Store a batch's ticks and bring the bars of the slots they touch up to date."""
    spark = ticks.sparkSession
    named = ticks.select(*TICKS.fieldNames()).withColumns({"slot": slot_of("ts", slot_seconds), "batch": F.lit(batch_id).cast("long")})
    _replace(named, f"{base}/ticks", "slot", "batch")
    bars = ticks_to_bars(touched_ticks(spark, base, batch_id).drop("slot", "batch"), seconds, zone)
    _replace(bars.withColumn("slot", slot_of("ts_utc", slot_seconds)), f"{base}/bars", "slot")


def maintain_bars(ticks: DataFrame, base: str, seconds: int, zone: str = "UTC", slot_seconds: int = DAY_SECONDS) -> StreamingQuery:
    """Take what the tick stream has and stop; a later call with the same ``base`` goes on.

    ``base`` will hold ``ticks``, ``bars`` and the checkpoint. The bars of a slot are replaced together,
    so the bar width must divide the slot's. Ticks without a time are left out.
    """
    if slot_seconds % seconds:
        raise ValueError(f"slots of {slot_seconds} s can't hold whole bars of {seconds} s")

    def take(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            take_batch(batch.where("ts IS NOT NULL"), batch_id, base, seconds, zone, slot_seconds)

    query = (ticks.writeStream.foreachBatch(take).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def maintained_bars(spark: SparkSession, base: str) -> DataFrame:
    """The bars so far; a filter on ``slot`` prunes folders."""
    return spark.read.schema(KEPT).parquet(f"{base}/bars")
