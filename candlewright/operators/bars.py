"""Ticks to bars and bar rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.functions.columns import bucket_start, calendar_start, local_time


def dedup_ticks(ticks: DataFrame, bucket: Column) -> DataFrame:
    """One row per (symbol, ts, price); the last in file order gives the volume.

    A plain aggregate, so copies of a tick collapse before the shuffle however
    many there are. ``bucket`` rides along in the key for the bar build.
    """
    return (
        ticks.withColumn("bucket", bucket)
        .groupBy("symbol", "bucket", "ts", "price")
        .agg(F.max_by("volume", "seq").alias("volume"), F.max("seq").alias("seq"))
    )


def ticks_to_bars(ticks: DataFrame, seconds: int, zone: str = "UTC") -> DataFrame:
    """OHLCV bars of ``seconds`` width cut inside each UTC day; empty buckets do not appear.

    The first aggregate spreads ticks over the whole (symbol, bucket, ts, price)
    key, the second sends one partial row per bucket and task. Neither puts a
    busy symbol or a busy bucket into a single task.
    """
    order = F.struct("ts", "seq")
    bars = (
        dedup_ticks(ticks, bucket_start("ts", seconds))
        .groupBy("symbol", F.col("bucket").alias("ts_utc"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("volume").alias("volume"),
        )
    )
    return add_local_time(bars, zone)


def add_local_time(bars: DataFrame, zone: str) -> DataFrame:
    """Wall-clock column ``ts`` beside the UTC key, which stays unique at the autumn fold."""
    ts = F.col("ts_utc") if zone == "UTC" else local_time("ts_utc", zone)
    return bars.withColumn("ts", ts).select(
        "symbol", "ts_utc", "ts", "open", "high", "low", "close", "volume")


def _rollup(bars: DataFrame, bucket: Column, name: str) -> DataFrame:
    return bars.groupBy("symbol", bucket.alias(name)).agg(
        F.min_by("open", "ts_utc").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts_utc").alias("close"),
        F.sum("volume").alias("volume"),
    )


def rollup_calendar(bars: DataFrame, unit: str, name: str = "ts_utc") -> DataFrame:
    """Bars to day, week or month bars by UTC calendar."""
    return _rollup(bars, calendar_start("ts_utc", unit), name)


def rollup_htf(bars: DataFrame, seconds: int, name: str = "htf_ts") -> DataFrame:
    """Bars to a higher time frame, cut on the wall clock as charts show it."""
    return _rollup(bars, bucket_start("ts", seconds), name)


def daily_range(bars: DataFrame) -> DataFrame:
    """High and low of every local calendar day that has bars."""
    return bars.groupBy("symbol", F.to_date("ts").alias("trade_date")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"))
