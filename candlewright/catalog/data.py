"""Ticks, bars, coverage and time."""

import lzma
import struct
import uuid

import pandas as pd
from pyspark.sql import functions as F

from candlewright.catalog.base import (
    D1, EVENT_TICKS, H1, H4, M15, ORDER_TICKS, bars_sql, event_bars, order_bars, query)
from candlewright.functions.columns import bucket_start, local_time
from candlewright.operators.bars import (
    daily_range, dedup_ticks, rollup_calendar, rollup_htf, ticks_to_bars)
from candlewright.operators.htf import attach_asof
from candlewright.sources.coverage import coverage, delta_hours, missing_hours
from candlewright.sources.fixtures import event_ticks, order_ticks
from candlewright.session import staging_root
from candlewright.sources.ledger import take_new, taken_ticks
from candlewright.sources.tick_source import apart, tick_stream, tick_table, write_tick_files
from candlewright.sources.ticks import decode_files, divisor, path_keys, rejects, to_ticks
from candlewright.streaming.runs import write_available

BAR = ["symbol", "ts_utc", "open", "high", "low", "close", "volume"]


@query("bars_15m", bars_sql(M15) + " SELECT symbol, ts AS ts_utc, open, high, low, close, volume FROM b")
def bars_15m(spark, root):
    return ticks_to_bars(event_ticks(spark, root), M15).select(*BAR)


@query("bars_1h", bars_sql(H1) + " SELECT symbol, ts AS ts_utc, open, high, low, close, volume FROM b")
def bars_1h(spark, root):
    return ticks_to_bars(event_ticks(spark, root), H1).select(*BAR)


@query("bars_from_orders", bars_sql(D1, ORDER_TICKS)
       + " SELECT symbol, ts AS ts_utc, open, high, low, close, volume FROM b")
def bars_from_orders(spark, root):
    return ticks_to_bars(order_ticks(spark, root), D1).select(*BAR)


@query("tick_dedup", """SELECT o_orderpriority AS symbol, o_orderdate AS ts, floor(o_totalprice / 100000) AS price,
  arg_max(o_totalprice, o_orderkey) AS volume, max(o_orderkey) AS seq FROM orders GROUP BY 1, 2, 3""")
def tick_dedup(spark, root):
    ticks = order_ticks(spark, root).withColumns({
        "volume": F.col("price"), "price": F.floor(F.col("price") / 100_000).cast("double")})
    return dedup_ticks(ticks, bucket_start("ts", D1)).drop("bucket")


@query("price_scaling", """SELECT event_id, CAST(value * 100 AS BIGINT) AS raw,
  CAST(value * 100 AS BIGINT) / CASE WHEN event_type IN ('view', 'click') THEN 1000.0 ELSE 100000.0 END AS price
  FROM events""")
def price_scaling(spark, root):
    raw = F.round(F.col("price") * 100).cast("long")
    table = {"view": 1000.0, "click": 1000.0}
    return event_ticks(spark, root).select(
        F.col("seq").alias("event_id"), raw.alias("raw"), (raw / divisor("symbol", table)).alias("price"))


@query("path_keys", """SELECT event_id, upper(event_type) AS symbol, date_trunc('hour', ts) AS hour_ts FROM events""")
def tick_path_keys(spark, root):
    ticks = event_ticks(spark, root)
    path = F.concat(F.lit("file:/raw/"), "symbol", F.lit("/"), F.date_format("ts", "yyyy/MM/dd/HH"), F.lit("h_ticks.bi5"))
    return ticks.withColumn("path", path).select(F.col("seq").alias("event_id"), *(
        c.alias(k) for k, c in path_keys().items()))


def _packed(batches):
    """Events as tick files: one per instrument-hour and batch."""
    for pdf in batches:
        files = {}
        for path, *record in zip(pdf["path"], pdf["ms"], pdf["bid"] + 2, pdf["bid"], pdf["ask_vol"]):
            files.setdefault(path, bytearray()).extend(struct.pack(">Iiiii", *record, 0))
        content = [lzma.compress(bytes(c), format=lzma.FORMAT_ALONE, preset=0) for c in files.values()]
        yield pd.DataFrame({"path": list(files), "content": content})


@query("tick_files", """SELECT upper(event_type) AS symbol, date_trunc('hour', ts) + to_milliseconds(
  (minute(ts) * 60000 + floor(epoch_us(ts) % 60000000 / 1000))::BIGINT) AS ts, CAST(round(value * 100) AS BIGINT) / 100000.0::DOUBLE AS price,
  CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS volume FROM events""")
def tick_files(spark, root):
    path = F.concat(F.lit("file:/raw/"), "symbol", F.lit("/"), F.date_format("ts", "yyyy/MM/dd/HH"), F.lit("h_ticks.bi5"))
    ms = F.timestamp_diff("MILLISECOND", bucket_start("ts", H1), F.col("ts"))
    files = event_ticks(spark, root).select(
        path.alias("path"), ms.alias("ms"), F.round(F.col("price") * 100).cast("long").alias("bid"),
        F.col("volume").cast("long").alias("ask_vol"),
    ).mapInPandas(_packed, "path string, content binary")
    return to_ticks(decode_files(files)).drop("seq")


@query("tick_rejects", """WITH h AS (SELECT DISTINCT event_type AS symbol, date_trunc('hour', ts) AS hour FROM events)
  SELECT CASE WHEN hour(hour) % 6 = 1 THEN 'file:/raw/' || symbol || '/' || strftime(hour, '%Y/%m/%d/%H') || 'h_ticks.bi5'
    ELSE 'file:/raw/' || symbol || '/' || strftime(hour, '%Y-%m-%d-%H') || '_ticks.bi5' END AS path,
    CASE WHEN hour(hour) % 6 = 1 THEN 'LZMAError' ELSE 'unexpected path' END AS reason FROM h WHERE hour(hour) % 6 IN (1, 4)""")
def tick_rejects(spark, root):
    """Damaged files in hours 1, 7, 13, 19 and misnamed ones in 4, 10, 16, 22; the other hours give ticks."""
    hour = F.hour("ts") % 6
    head = F.concat(F.lit("file:/raw/"), "symbol", F.lit("/"))
    path = F.when(hour == 4, F.concat(head, F.date_format("ts", "yyyy-MM-dd-HH"), F.lit("_ticks.bi5"))).otherwise(
        F.concat(head, F.date_format("ts", "yyyy/MM/dd/HH"), F.lit("h_ticks.bi5")))
    files = event_ticks(spark, root).select(
        path.alias("path"), F.timestamp_diff("MILLISECOND", bucket_start("ts", H1), F.col("ts")).alias("ms"),
        F.round(F.col("price") * 100).cast("long").alias("bid"), F.col("volume").cast("long").alias("ask_vol"),
    ).mapInPandas(_packed, "path string, content binary")
    damaged = F.pmod(F.regexp_extract("path", r"/(\d{2})h_ticks", 1).try_cast("int"), F.lit(6)) == 1
    files = files.withColumn("content", F.when(damaged, F.lit("damaged").cast("binary")).otherwise(F.col("content")))
    return rejects(decode_files(files)).select("path", F.split_part("error", F.lit(":"), F.lit(1)).alias("reason")).distinct()


#: Events as they come back from tick files: whole milliseconds, prices in hundred-thousandths.
FILED = """SELECT upper(event_type) AS symbol, date_trunc('hour', ts) + to_milliseconds(
  (minute(ts) * 60000 + floor(epoch_us(ts) % 60000000 / 1000))::BIGINT) AS ts, CAST(round(value * 100) AS BIGINT) / 100000.0::DOUBLE AS price,
  CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS DOUBLE) AS volume FROM events"""


def _filed(spark, root):
    """A folder with the events as tick files."""
    folder = f"{staging_root(spark)}/tick-files-{uuid.uuid4().hex}"
    write_tick_files(event_ticks(spark, root).withColumn("price", F.round(F.col("price") * 100) / 100_000), folder)
    return folder


@query("tick_source", f"WITH t AS ({FILED}) SELECT * FROM t WHERE symbol IN ('CLICK', 'VIEW') AND ts >= '2024-01-09 06:30:00' AND ts < '2024-01-11'")
def tick_source(spark, root):
    """Two symbols and less than two days: files of other symbols and hours are not opened."""
    ticks = apart(tick_table(spark, _filed(spark, root))).ticks
    return ticks.where("symbol IN ('CLICK', 'VIEW') AND ts >= TIMESTAMP_NTZ '2024-01-09 06:30:00' AND ts < TIMESTAMP_NTZ '2024-01-11 00:00:00'").select(
        "symbol", "ts", "price", "volume")


@query("tick_source_stream", FILED)
def tick_source_stream(spark, root):
    """The same source as a stream, over all files."""
    folder = _filed(spark, root)
    ticks = apart(tick_stream(spark, folder, settleSeconds="0")).ticks.select("symbol", "ts", "price", "volume")
    base = f"{staging_root(spark)}/stream-{uuid.uuid4().hex}"
    write_available(ticks, f"{base}/ticks", f"{base}/checkpoint")
    return spark.read.schema(ticks.schema).parquet(f"{base}/ticks")


@query("ledger_runs", f"""WITH t AS ({FILED}), f AS (SELECT symbol, date_trunc('hour', ts) AS hour, count(*) AS n FROM t GROUP BY ALL),
  r AS (SELECT 1 AS run_no, count(*) AS files, sum(n) AS ticks FROM f WHERE symbol <> 'VIEW'
    UNION ALL SELECT 2, count(*), sum(n) FROM f WHERE symbol = 'VIEW'
    UNION ALL SELECT 3, 0, 0
    UNION ALL SELECT 3, count(*), sum(n) FROM f WHERE symbol = 'CLICK')
  SELECT run_no::BIGINT AS run_no, files::BIGINT AS files, 0::BIGINT AS rejected, ticks::BIGINT AS ticks FROM r""")
def ledger_runs(spark, root):
    """Four runs: all but one symbol, that symbol, nothing new (which gives no number away), and a symbol whose files changed."""
    base, folder = f"{staging_root(spark)}/ledger-{uuid.uuid4().hex}", _filed(spark, root)
    ticks = apart(tick_table(spark, folder)).ticks
    names = [r.symbol for r in ticks.where("symbol <> 'VIEW'").select("symbol").distinct().collect()]
    runs = [take_new(spark, folder, base, symbols=names), take_new(spark, folder, base), take_new(spark, folder, base)]
    write_tick_files(ticks.where("symbol = 'CLICK'").withColumn("price", F.col("price") + 1), folder)
    runs.append(take_new(spark, folder, base))
    return spark.createDataFrame(runs, "run_no long, run string, files long, rejected long, ticks long").drop("run")


@query("ledger_ticks", FILED + " WHERE event_type <> 'view' UNION ALL "
       + FILED.replace("AS BIGINT) / 100000", "AS BIGINT) + 50000) / 100000").replace("CAST(round", "(CAST(round") + " WHERE event_type = 'view'")
def ledger_ticks(spark, root):
    """Ticks of two runs, the second after one symbol's files were replaced: each file counts once, as it is now."""
    base, folder = f"{staging_root(spark)}/ledger-{uuid.uuid4().hex}", _filed(spark, root)
    take_new(spark, folder, base)
    ticks = apart(tick_table(spark, folder)).ticks.where("symbol = 'VIEW'")
    write_tick_files(ticks.withColumn("price", F.col("price") + 0.5), folder)
    take_new(spark, folder, base)
    return taken_ticks(spark, base).select("symbol", "ts", "price", "volume")


def _hours(spark, root):
    """Hours with events as present hours."""
    return event_ticks(spark, root).select("symbol", bucket_start("ts", H1).alias("hour_ts")).distinct()


HOURS = "h AS (SELECT DISTINCT event_type AS symbol, date_trunc('hour', ts) AS hour_ts FROM events)"


@query("coverage", f"WITH {HOURS} SELECT symbol, min(hour_ts) AS first_hour, max(hour_ts) AS last_hour, count(*) AS hours FROM h GROUP BY 1")
def hour_coverage(spark, root):
    return coverage(_hours(spark, root))


@query("missing_hours", f"""WITH {HOURS}, grid AS (SELECT symbol, unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00',
  TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS hour_ts FROM (SELECT DISTINCT symbol FROM h))
  SELECT symbol, hour_ts FROM grid ANTI JOIN h USING (symbol, hour_ts)""")
def hours_missing(spark, root):
    return missing_hours(_hours(spark, root), "2024-01-01 00:00:00", "2024-01-31 23:00:00")


@query("delta_hours", f"""WITH {HOURS}, s AS (SELECT symbol, max(hour_ts) + INTERVAL 1 HOUR AS a,
  TIMESTAMP '2024-02-03 16:00:00' AS z FROM h GROUP BY 1)
  SELECT symbol, false AS refused, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS hour_ts FROM s WHERE a < z""")
def hours_to_fetch(spark, root):
    return delta_hours(_hours(spark, root), "2024-02-03 17:25:00")


@query("local_time", """SELECT o_orderkey, timezone('Europe/Berlin', timezone('UTC', o_orderdate
  + to_hours(CAST(o_orderkey % 24 AS INTEGER)))) AS local_ts FROM orders""")
def berlin_time(spark, root):
    zero = F.lit(0)
    hours = F.make_dt_interval(zero, (F.col("seq") % 24).cast("int"))
    return order_ticks(spark, root).select(
        F.col("seq").alias("o_orderkey"), local_time(F.col("ts") + hours, "Europe/Berlin").alias("local_ts"))


def _rollup_sql(bucket: str, name: str) -> str:
    return (f" SELECT symbol, {bucket} AS {name}, first(open ORDER BY ts) AS open, max(high) AS high, "
            "min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume FROM b GROUP BY 1, 2")


@query("bars_htf", bars_sql(M15) + _rollup_sql("time_bucket(INTERVAL '14400 seconds', ts)", "htf_ts"))
def bars_4h(spark, root):
    return rollup_htf(event_bars(spark, root), H4)


@query("bars_day", bars_sql(M15) + _rollup_sql("date_trunc('day', ts)::TIMESTAMP", "ts_utc"))
def bars_day(spark, root):
    return rollup_calendar(event_bars(spark, root), "day")


@query("bars_week", bars_sql(D1, ORDER_TICKS) + _rollup_sql("date_trunc('week', ts)::TIMESTAMP", "ts_utc"))
def bars_week(spark, root):
    return rollup_calendar(order_bars(spark, root), "week")


@query("bars_month", bars_sql(D1, ORDER_TICKS) + _rollup_sql("date_trunc('month', ts)::TIMESTAMP", "ts_utc"))
def bars_month(spark, root):
    return rollup_calendar(order_bars(spark, root), "month")


@query("daily_range", bars_sql(M15) + " SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS trade_date, max(high) AS high, min(low) AS low FROM b GROUP BY 1, 2")
def day_range(spark, root):
    return daily_range(event_bars(spark, root)).withColumn("trade_date", F.col("trade_date").cast("timestamp_ntz"))


@query("bar_index", bars_sql(M15) + """ SELECT symbol, ts AS ts_utc, n AS bar_no, pts AS prev_ts_utc,
  ph AS prev_high, pl AS prev_low, pc AS prev_close FROM i""")
def bar_index(spark, root):
    return event_bars(spark, root).select(
        "symbol", "ts_utc", "bar_no", "prev_ts_utc", "prev_high", "prev_low", "prev_close")


@query("asof_attach", bars_sql(M15) + """, s AS (SELECT symbol, max(ts) AS ts, last(close ORDER BY ts) AS last_close
  FROM b GROUP BY symbol, time_bucket(INTERVAL '4 hours', ts))
  SELECT i.symbol, i.ts AS ts_utc, s.last_close FROM i ASOF LEFT JOIN s ON i.symbol = s.symbol AND i.ts >= s.ts""")
def asof_attach(spark, root):
    bars = event_bars(spark, root)
    sparse = bars.groupBy("symbol", bucket_start("ts_utc", H4)).agg(
        F.max("ts_utc").alias("ts_utc"), F.max_by("close", "ts_utc").alias("last_close"))
    return attach_asof(bars.select("symbol", "ts_utc"), sparse, ["last_close"])
