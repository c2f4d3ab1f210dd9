"""Streams, run over all that is there."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewright.catalog.base import D1, H1, M15, ORDER_TICKS, bars_sql, event_bars, order_bars, query, rounded
from candlewright.catalog.data import BAR
from candlewright.catalog.indicators import JOIN, KEY, R1H, supertrend_sql, zigzag_sql
from candlewright.schema import BARS
from candlewright.session import stage, staging_root
from candlewright.sources.fixtures import event_ticks, order_ticks
from candlewright.streaming.closing import run_to_end
from candlewright.streaming.maintained import maintain_bars, maintained_bars
from candlewright.streaming.structure import stream_supertrend, stream_zigzag
from candlewright.streaming.tick_bars import stream_bars
from candlewright.streaming.watch import watch

#: Rows that ``watch`` takes.
CLOSABLE = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts_utc", T.TimestampNTZType()), T.StructField("seq", T.LongType())])
_ALL_BARS = bars_sql(M15) + " SELECT symbol, ts AS ts_utc, open, high, low, close, volume FROM b"


@query("stream_bars", _ALL_BARS)
def streamed_bars(spark, root):
    """Every bar: those the watermark has passed, and the rest after the closing row."""
    events = spark.read.parquet(f"{root}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(root)
    logical = stream.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"))
    return run_to_end(spark, lambda closing: stream_bars(logical, M15, "2 hours", closing), logical.schema, "ts")


@query("stream_bars_late", _ALL_BARS)
def late_bars(spark, root):
    """Ticks arrive in four parts, the last of them a tenth of all and up to the whole history late."""
    part = F.when(F.col("seq") % 10 == 3, 3).otherwise(F.floor((F.dayofmonth("ts") - 1) / 11))
    ticks = event_ticks(spark, root).withColumn("part", part)
    base = f"{staging_root(spark)}/maintained-{uuid.uuid4().hex}"
    ticks.repartition("part").write.partitionBy("part").parquet(f"{base}/arriving")
    stream = (spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/arriving"))
    maintain_bars(stream, base, M15, slot_seconds=7 * 86_400)
    return maintained_bars(spark, base).select(*BAR)


def _bar_stream(spark, root, seconds):
    """The stored bars as a stream, in several micro-batches in any order, and the delay that allows for that."""
    stored = stage(event_bars(spark, root, seconds).select(*BARS.fieldNames()).repartition(3, "ts_utc"), "bar-stream")
    folder = stored.inputFiles()[0].rsplit("/", 1)[0]
    days = stored.agg(F.date_diff(F.max("ts_utc"), F.min("ts_utc"))).first()[0] or 0
    return spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(folder), f"{days + 2} days"


@query("stream_pivot", f"{R1H}, {zigzag_sql('i', '0.3::DOUBLE')} SELECT {KEY} t::BIGINT AS zz_trend, bias::BIGINT AS zz_bias{JOIN}")
def streamed_zigzag(spark, root):
    bars, delay = _bar_stream(spark, root, H1)
    got = run_to_end(spark, lambda closing: stream_zigzag(bars, 30.0, delay, closing), bars.schema, "ts_utc")
    return got.select("symbol", "ts_utc", *(F.col(c).cast("long").alias(c) for c in ("zz_trend", "zz_bias")))


@query("stream_supertrend", f"{supertrend_sql()} SELECT {KEY} round(line, 6) + 0.0 AS supertrend, d::BIGINT AS st_direction FROM k")
def streamed_supertrend(spark, root):
    bars, delay = _bar_stream(spark, root, H1)
    got = run_to_end(spark, lambda closing: stream_supertrend(bars, 10, 3.0, delay, closing), bars.schema, "ts_utc")
    return got.select("symbol", "ts_utc", rounded("supertrend").alias("supertrend"), F.col("st_direction").cast("long").alias("st_direction"))


def _arriving(spark, rows, sequence, parts=3):
    """Rows as a stream of files that arrive one after the other, in order of ``sequence``."""
    folder = f"{staging_root(spark)}/arriving-{uuid.uuid4().hex}"
    edges = rows.approxQuantile(sequence, [i / parts for i in range(1, parts)], 0.01)
    low = None
    for high in [*edges, None]:
        part = rows if low is None else rows.where(F.col(sequence) > low)
        part = part if high is None else part.where(F.col(sequence) <= high)
        part.coalesce(1).write.mode("append").parquet(folder)
        low = high
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("stream_gaps", f"""{bars_sql(D1, ORDER_TICKS)}, z AS (SELECT symbol, epoch(ts) - epoch(pts) AS diff FROM i)
  SELECT symbol, count(*) FILTER (diff > 86400) AS large_gaps, count(*) FILTER (diff > 3600 AND diff <= 86400) AS regular_gaps,
  max(diff) + 0.0 AS max_gap_seconds, 1::BIGINT AS silent FROM z GROUP BY 1""")
def streamed_gaps(spark, root):
    """Gaps of the day bars as they come; each series is silent once, at its end."""
    bars = order_bars(spark, root).select("symbol", "ts_utc", F.col("bar_no").alias("seq"))
    years = bars.agg(F.date_diff(F.max("ts_utc"), F.min("ts_utc"))).first()[0] or 0
    stream = _arriving(spark, bars, "seq")
    got = run_to_end(spark, lambda closing: watch(stream, 3600, 400 * 86_400, delay=f"{years + 2} days", closing=closing), CLOSABLE, "ts_utc")
    wide, large = F.col("kind") == "gap", F.col("seconds") > 86_400
    return got.groupBy("symbol").agg(
        F.count_if(wide & large).alias("large_gaps"), F.count_if(wide & ~large).alias("regular_gaps"),
        F.max(F.when(wide, F.col("seconds"))).alias("max_gap_seconds"), F.count_if(F.col("kind") == "silent").alias("silent"))


@query("stream_time_order", """WITH s AS (SELECT o_orderpriority AS symbol, o_orderkey,
  o_orderdate < lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS back FROM orders)
  SELECT symbol, count(*) AS count FROM s WHERE back GROUP BY 1""")
def streamed_order_faults(spark, root):
    """Orders come in order of their keys, which is not that of their dates."""
    arrivals = order_ticks(spark, root).select("symbol", F.col("ts").alias("ts_utc"), "seq")
    stream = _arriving(spark, arrivals, "seq")
    got = run_to_end(spark, lambda closing: watch(stream, 3600, delay="100000 days", closing=closing), CLOSABLE, "ts_utc")
    return got.where("kind = 'order'").groupBy("symbol").agg(F.count(F.lit(1)).alias("count"))
