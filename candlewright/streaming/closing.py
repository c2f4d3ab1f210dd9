"""Ending a stream: a closing row moves the watermark past everything that is still open.

A stream that may be closed reads a second folder beside its own input. It holds no row until
``close`` writes one with a time far ahead; the next run then emits all windows and waiting rows.
Data that comes after it is late.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewright.session import staging_root
from candlewright.streaming.runs import instant, write_available

#: The time of the closing row; rows of data are earlier than the second.
END, AHEAD = "9000-01-01 00:00:00", "8000-01-01 00:00:00"


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def open_closing(spark: SparkSession, schema: T.StructType, path: str) -> str:
    """The folder of the closing row, as yet without it; done once, before the first run."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return path


def close(spark: SparkSession, schema: T.StructType, time: str, path: str) -> None:
    """Write the closing row; once is enough, and a second one does no harm."""
    row = spark.range(1).select(*(
        (_at(END) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
    row.coalesce(1).write.mode("append").parquet(path)


def watermarked(rows: DataFrame, event_time: Column, delay: str, closing: str | None) -> DataFrame:
    """``rows`` with column ``event_time`` and its watermark; ``closing`` is the folder of the closing row.

    That row is left out behind the watermark, by a condition on the event time, which is not pushed below it.
    """
    if closing is not None:
        rows = rows.unionByName(rows.sparkSession.readStream.schema(rows.schema).parquet(closing))
    rows = rows.withColumn("event_time", event_time).withWatermark("event_time", delay)
    if closing is None:
        return rows
    return rows.where(F.col("event_time") < instant(_at(AHEAD)))


def run_to_end(spark: SparkSession, build: Callable[[str], DataFrame], schema: T.StructType, time: str) -> DataFrame:
    """Run ``build(closing folder)`` over all that is there, close it, and read back everything it emitted.

    ``schema`` and ``time`` are those of the stream's input rows.
    """
    base = f"{staging_root(spark)}/stream-{uuid.uuid4().hex}"
    closing = open_closing(spark, schema, f"{base}/closing")
    rows = build(closing)
    write_available(rows, f"{base}/rows", f"{base}/checkpoint")
    close(spark, schema, time, closing)
    write_available(rows, f"{base}/rows", f"{base}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")
