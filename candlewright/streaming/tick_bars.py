"""Incremental tick to bar build as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.sources.ticks import FILE_GLOB, decode_files, to_ticks
from candlewright.streaming.closing import watermarked
from candlewright.streaming.runs import instant, wall_clock

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_records(spark: SparkSession, root: str, volume_type: str = "int32",
                   files_per_batch: int = 1000) -> DataFrame:
    """Decoded files as they come; ``rejects`` of it is the stream of files that could not be used."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE)
             .option("pathGlobFilter", FILE_GLOB).option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", files_per_batch).load(root))
    return decode_files(files, volume_type)


def stream_tick_files(spark: SparkSession, root: str, volume_type: str = "int32",
                      files_per_batch: int = 1000) -> DataFrame:
    return to_ticks(stream_records(spark, root, volume_type, files_per_batch))


def stream_bars(ticks: DataFrame, seconds: int, delay: str = "2 hours", closing: str | None = None) -> DataFrame:
    """Final bars of a tick stream, each emitted once the watermark has passed it.

    The same two aggregates as the batch build. State holds the ticks of the
    windows still open, so it is bounded by the delay, not by the history.
    With ``closing``, the folder of a closing row, a run after ``closing.close`` emits these as well.
    """
    width = f"{seconds} seconds"
    timed = watermarked(ticks, instant(F.col("ts")), delay, closing)
    tick_time = F.unix_micros("event_time").alias("tick_time")
    distinct = timed.groupBy(F.window("event_time", width).alias("w"), "symbol", tick_time, "price").agg(
        F.max_by("volume", "seq").alias("volume"), F.max("seq").alias("seq"))
    order = F.struct(F.col("tick_time"), F.col("seq"))
    bars = (
        distinct.select("symbol", "price", "volume", "seq", "tick_time", F.window_time("w").alias("closing"))
        .groupBy(F.window("closing", width).alias("w"), "symbol").agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", order).alias("close"),
            F.sum("volume").alias("volume"))
    )
    return bars.select("symbol", wall_clock(F.col("w.start")).alias("ts_utc"),
                       "open", "high", "low", "close", "volume")
