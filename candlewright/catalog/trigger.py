"""Candles, trigger, sessions and the reports on them."""

from pyspark.sql import functions as F

from candlewright.catalog.base import H4, M15, bars_sql, event_bars, query, rounded, trigger_sql
from candlewright.operators import funnel
from candlewright.operators.candles import add_bias, add_reversals, add_trigger, candle_type, signal_label
from candlewright.operators.htf import add_completed_bias, attach_own, htf_bars
from candlewright.operators.sessions import Session, annotate_session, between, in_session, in_zone_session
from candlewright.sources.fixtures import event_ticks

G = f"{bars_sql(M15)}, {trigger_sql(H4)} "
KEY = "SELECT symbol, ts AS ts_utc, "


def triggered(spark, root):
    return add_trigger(event_bars(spark, root), H4)


@query("candles", G + KEY + "candle_type FROM g")
def candles(spark, root):
    return event_bars(spark, root).select("symbol", "ts_utc", candle_type().alias("candle_type"))


@query("reversals", G + KEY + "rev_up, rev_down FROM g")
def reversals(spark, root):
    return add_reversals(event_bars(spark, root)).select("symbol", "ts_utc", "rev_up", "rev_down")


@query("htf_bias", G + KEY + "htf_bull, htf_bear FROM g")
def htf_bias(spark, root):
    return add_bias(event_bars(spark, root), H4).select("symbol", "ts_utc", "htf_bull", "htf_bear")


@query("htf_ffill", G + KEY + "htf_bull, htf_bear FROM g")
def htf_ffill(spark, root):
    bars = event_bars(spark, root)
    htf = htf_bars(bars, H4).withColumns({
        "htf_bull": F.col("close") > F.col("open"), "htf_bear": F.col("close") < F.col("open")})
    return attach_own(bars, htf, H4, ["htf_bull", "htf_bear"]).fillna(False).select(
        "symbol", "ts_utc", "htf_bull", "htf_bear")


@query("htf_completed", G + """, hp AS (SELECT symbol, htf_ts, lag(hc > ho) OVER w AS bull, lag(hc < ho) OVER w AS bear
  FROM hb WINDOW w AS (PARTITION BY symbol ORDER BY htf_ts))
  SELECT g.symbol, g.ts AS ts_utc, coalesce(bull, false) AS htf_bull, coalesce(bear, false) AS htf_bear
  FROM g JOIN hp USING (symbol, htf_ts)""")
def htf_completed(spark, root):
    return add_completed_bias(event_bars(spark, root), H4).select("symbol", "ts_utc", "htf_bull", "htf_bear")


@query("trigger", G + KEY + "candle_type, we_buy, we_sell FROM g")
def trigger(spark, root):
    return triggered(spark, root).select("symbol", "ts_utc", "candle_type", "we_buy", "we_sell")


@query("signal_labels", G + KEY + "sig AS signal FROM g WHERE sig IS NOT NULL")
def signal_labels(spark, root):
    return triggered(spark, root).select("symbol", "ts_utc", signal_label().alias("signal")).where("signal IS NOT NULL")


@query("trigger_counts", G + """SELECT symbol, count(*) AS total_bars, min(ts) AS first_ts, max(ts) AS last_ts,
  count(*) FILTER (we_buy) AS buy, count(*) FILTER (we_sell) AS sell,
  count(*) FILTER (we_buy) + count(*) FILTER (we_sell) AS total FROM g GROUP BY 1""")
def trigger_counts(spark, root):
    return funnel.run_statistics(triggered(spark, root))


def _pct(part: str, whole: str, name: str) -> str:
    return f"round(CASE WHEN {whole} = 0 THEN 0 ELSE {part} * 100.0::DOUBLE / {whole} END, 6) + 0.0 AS {name}"


def _round_shares(df):
    return df.select(*(rounded(c).alias(c) if c.endswith(("_pct", "_rate")) else c for c in df.columns))


_B, _S = "count(*) FILTER (we_buy)", "count(*) FILTER (we_sell)"


@query("signal_analysis", G + f"""SELECT symbol, count(*) AS total_bars, {_B} AS buy, {_pct(_B, 'count(*)', 'buy_pct')},
  {_S} AS sell, {_pct(_S, 'count(*)', 'sell_pct')}, {_B} + {_S} AS total,
  {_pct(f'({_B} + {_S})', 'count(*)', 'total_pct')} FROM g GROUP BY 1""")
def signal_analysis(spark, root):
    return _round_shares(funnel.signal_analysis(triggered(spark, root)))


_KINDS = ", ".join(
    f"count(*) FILTER (candle_type = {code}) AS {name}, "
    + _pct(f"count(*) FILTER (candle_type = {code})", "count(candle_type)", f"{name}_pct")
    for name, code in (("inside", 1), ("up", 2), ("down", -2), ("outside", 3)))


@query("candle_distribution", G + f"""SELECT symbol, count(*) AS total_bars, count(candle_type) AS classified,
  count(*) - count(candle_type) AS unclassified, {_pct('count(candle_type)', 'count(*)', 'classification_rate')},
  {_KINDS} FROM g GROUP BY 1""")
def candle_distribution(spark, root):
    bars = event_bars(spark, root).withColumn("candle_type", candle_type())
    return _round_shares(funnel.candle_distribution(bars))


_HTF = ", ".join(f"{e} AS {n}, " + _pct(e, "count(*)", f"{n}_pct") for n, e in (
    ("bull", "count(*) FILTER (htf_bull)"), ("bear", "count(*) FILTER (htf_bear)"),
    ("neutral", "count(*) FILTER (NOT htf_bull AND NOT htf_bear)")))


@query("htf_distribution", G + f"SELECT symbol, {_HTF} FROM g GROUP BY 1")
def htf_distribution(spark, root):
    return _round_shares(funnel.htf_distribution(add_bias(event_bars(spark, root), H4)))


_REV = ", ".join(
    f"count(*) FILTER ({p}) AS {p}_count, count(*) FILTER ({s}) AS {p}_converted, "
    + _pct(f"count(*) FILTER ({s})", f"count(*) FILTER ({p})", f"{p}_rate")
    for p, s in (("rev_up", "we_buy"), ("rev_down", "we_sell")))


@query("reversal_conversion", G + f"SELECT symbol, {_REV} FROM g GROUP BY 1")
def reversal_conversion(spark, root):
    return _round_shares(funnel.reversal_conversion(triggered(spark, root)))


@query("samples_topn", G + """SELECT symbol, sig AS signal, row_number() OVER (PARTITION BY symbol, sig ORDER BY ts) AS sample_no,
  ts AS ts_utc, open, high, low, close, volume, candle_type FROM g WHERE sig IS NOT NULL QUALIFY sample_no <= 5""")
def samples_topn(spark, root):
    df = triggered(spark, root).withColumn("signal", signal_label())
    return funnel.sample_signals(df, 5).select(
        "symbol", "signal", "sample_no", "ts_utc", "open", "high", "low", "close", "volume", "candle_type")


_MIN = "(hour(ts) * 60 + minute(ts))"


@query("session_filter", f"SELECT event_id, event_type AS symbol FROM events WHERE {_MIN} >= 510 AND {_MIN} < 1230")
def session_filter(spark, root):
    return event_ticks(spark, root).where(in_session(Session.at("08:30", "20:30"))).select(
        F.col("seq").alias("event_id"), "symbol")


_NY = "timezone('America/New_York', timezone('UTC', ts))"


@query("zone_session", f"""SELECT event_id FROM (SELECT event_id, hour({_NY}) * 60 + minute({_NY}) AS m FROM events)
  WHERE m >= 1350 OR m < 390""")
def zone_session(spark, root):
    return event_ticks(spark, root).where(
        in_zone_session(Session.at("22:30", "06:30"), "America/New_York", "ts")).select(F.col("seq").alias("event_id"))


@query("session_annotation", f"""SELECT event_id, {_MIN} >= 510 AND {_MIN} < 1230 AS in_trading_hours,
  hour(ts) AS hour, minute(ts) AS minute, '08:30' AS session_start, '20:30' AS session_end,
  'intraday' AS session_type FROM events""")
def session_annotation(spark, root):
    df = annotate_session(event_ticks(spark, root), Session())
    return df.select(F.col("seq").alias("event_id"), "in_trading_hours", F.col("hour").cast("long").alias("hour"),
                     F.col("minute").cast("long").alias("minute"), "session_start", "session_end", "session_type")


@query("date_range", bars_sql(M15) + """ SELECT symbol, ts AS ts_utc, close FROM b
  WHERE ts BETWEEN TIMESTAMP '2024-01-08 01:00:00' AND TIMESTAMP '2024-01-22 16:00:00'""")
def date_range(spark, root):
    return event_bars(spark, root).where(between("2024-01-08 01:00:00", "2024-01-22 16:00:00")).select(
        "symbol", "ts_utc", "close")
