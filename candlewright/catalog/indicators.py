"""Indicators and gates."""

from pyspark.sql import functions as F

from candlewright.catalog.base import (
    D1, H1, H4, M15, ORDER_TICKS, bars_sql, event_bars, gate_sql, order_bars, query, r6, show, smooth_sql)
from candlewright.functions.columns import all_gates
from candlewright.operators import studies as st
from candlewright.operators.htf import attach_completed, htf_bars
from candlewright.operators.risk import add_annual_range, add_monthly_range
from candlewright.operators.structure import add_supertrend, add_zigzag, pivot_gate
from candlewright.session import stage

I15 = bars_sql(M15)
R1H = bars_sql(H1, recursive=True)
KEY = "symbol, ts AS ts_utc, "
JOIN = " FROM i JOIN r USING (symbol, n)"


def gate(study_df, name, *values, places=6):
    """Key, value columns and both gate sides of a study."""
    out = show(study_df, "symbol", "ts_utc", F.col(f"{name}_long").alias("long"),
               F.col(f"{name}_short").alias("short"), places=places, **{v: v for v in values})
    return out


def win(rows: int, order: str = "n") -> str:
    return f"(PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def over(fn: str, rows: int) -> str:
    return f"{fn} OVER {win(rows)}"


def sma_sql(x: str, rows: int) -> str:
    """Mean of full frames of non-NULL values only."""
    return f"CASE WHEN {over(f'count({x})', rows)} = {rows} THEN {over(f'avg({x})', rows)} END"


# --- ranges -------------------------------------------------------------------

@query("true_range", I15 + f" SELECT {KEY} {r6('tr', 'tr')} FROM i")
def true_range(spark, root):
    return show(event_bars(spark, root), "symbol", "ts_utc", tr=st.true_range())


@query("annual_range", bars_sql(D1, ORDER_TICKS) + f""" SELECT symbol, ts AS ts_utc, CASE WHEN {over('count(*)', 1)} > 0 AND
  count(*) OVER p >= 20 THEN round(max(high) OVER p - min(low) OVER p, 6) + 0.0 END AS annual_range
  FROM i WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)""")
def annual_range(spark, root):
    return show(add_annual_range(order_bars(spark, root)), "symbol", "ts_utc", annual_range="annual_range")


@query("annual_range_intraday", I15 + """, dd AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS h, min(low) AS l FROM b GROUP BY 1, 2),
  dr AS (SELECT symbol, day, CASE WHEN count(*) OVER p >= 20 THEN max(h) OVER p - min(l) OVER p END AS rng
  FROM dd WINDOW p AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))
  SELECT symbol, ts AS ts_utc, round(rng, 6) + 0.0 AS annual_range FROM i JOIN dr USING (symbol) WHERE CAST(ts AS DATE) = day""")
def annual_range_intraday(spark, root):
    return show(add_annual_range(event_bars(spark, root)), "symbol", "ts_utc", annual_range="annual_range")


@query("monthly_range", bars_sql(D1, ORDER_TICKS) + """, dd AS (SELECT symbol, date_trunc('month', ts) AS month, max(high) AS h, min(low) AS l FROM b GROUP BY 1, 2),
  dr AS (SELECT symbol, month, CASE WHEN count(*) OVER p = 12 THEN max(h) OVER p - min(l) OVER p END AS rng
  FROM dd WINDOW p AS (PARTITION BY symbol ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
  SELECT symbol, ts AS ts_utc, round(rng, 6) + 0.0 AS annual_range FROM i JOIN dr USING (symbol) WHERE date_trunc('month', ts) = month""")
def monthly_range(spark, root):
    return show(add_monthly_range(order_bars(spark, root)), "symbol", "ts_utc", annual_range="annual_range")


# --- smoothing ------------------------------------------------------------------

@query("atr", f"{R1H}, {smooth_sql('r', 'i', {'atr': ('tr', 1 / 14)})} SELECT {KEY} {r6('atr', 'atr')}{JOIN}")
def atr(spark, root):
    return show(st.run_studies(event_bars(spark, root, H1), st.atr(14), gates=False), "symbol", "ts_utc", atr="atr")


@query("ema", f"{R1H}, {smooth_sql('r', 'i', {'ema': ('close', 2 / 26)})} SELECT {KEY} {r6('ema', 'ema')}{JOIN}")
def ema(spark, root):
    return show(st.run_studies(event_bars(spark, root, H1), st.ema(25), gates=False), "symbol", "ts_utc", ema="ema")


#: Bars without prices: single ones, the first, and a run.
HOLES = "n % 5 = 2 OR n BETWEEN 20 AND 23 OR n = 0"


def _gap_sql(x: str, a: str) -> str:
    """Recursive CTE ``r(symbol, n, y, w)``: smoothing that carries NULLs, ``w`` the weight the value has left."""
    return f"""x AS MATERIALIZED (SELECT symbol, n, CASE WHEN {HOLES} THEN NULL ELSE {x} END AS x FROM i),
  r AS (SELECT symbol, n, x AS y, 1.0::DOUBLE AS w FROM x WHERE n = 0 UNION ALL SELECT s.symbol, s.n,
    CASE WHEN s.x IS NULL THEN r.y WHEN r.y IS NULL THEN s.x ELSE (r.w * (1 - {a}) * r.y + {a} * s.x) / (r.w * (1 - {a}) + {a}) END,
    CASE WHEN s.x IS NULL THEN r.w * (1 - {a}) ELSE 1 END FROM r JOIN x s ON s.symbol = r.symbol AND s.n = r.n + 1)"""


def _holed(spark, root):
    hole = F.expr(HOLES.replace("n ", "bar_no "))
    bars = event_bars(spark, root, H1)
    return bars.withColumns({c: F.when(~hole, F.col(c)) for c in ("open", "high", "low", "close")})


@query("ema_nulls", f"{R1H}, {_gap_sql('close', '(2.0::DOUBLE / 26)')} SELECT {KEY} {r6('y', 'ema')}{JOIN}")
def ema_nulls(spark, root):
    return show(st.run_studies(_holed(spark, root), st.ema(25), gates=False), "symbol", "ts_utc", ema="ema")


@query("atr_nulls", f"{R1H}, {_gap_sql('tr', '(1.0::DOUBLE / 14)')} SELECT {KEY} {r6('y', 'atr')}{JOIN}")
def atr_nulls(spark, root):
    return show(st.run_studies(_holed(spark, root), st.atr(14), gates=False), "symbol", "ts_utc", atr="atr")


@query("atr_sma_seed", f"""{R1H}, seeded AS MATERIALIZED (SELECT symbol, n, tr, {sma_sql('tr', 14)} AS first14 FROM i),
  r AS (SELECT symbol, n, first14 AS atr FROM seeded WHERE n = 13 UNION ALL
  SELECT s.symbol, s.n, r.atr * (13.0 / 14) + s.tr / 14 FROM r JOIN seeded s ON s.symbol = r.symbol AND s.n = r.n + 1)
  SELECT {KEY} {r6('r.atr', 'atr')} FROM i LEFT JOIN r USING (symbol, n)""")
def atr_sma_seed(spark, root):
    return show(st.run_studies(event_bars(spark, root, H1), st.atr(14, "sma"), gates=False),
                "symbol", "ts_utc", atr="atr")


GAIN = {"g": ("greatest(coalesce(close - pc, 0), 0)", 1 / 14), "l": ("greatest(coalesce(pc - close, 0), 0)", 1 / 14)}
RSI = "CASE WHEN n < 13 OR l = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE - 100.0::DOUBLE / (1 + g / l) END"


@query("rsi", f"{R1H}, {smooth_sql('r', 'i', GAIN)} SELECT {KEY} {r6(RSI, 'rsi')}{JOIN}")
def rsi(spark, root):
    return show(st.run_studies(event_bars(spark, root, H1), st.rsi(14), gates=False), "symbol", "ts_utc", rsi="rsi")


@query("gate_rsi", f"{R1H}, {smooth_sql('r', 'i', GAIN)} SELECT {KEY} {r6(RSI, 'rsi')}, {gate_sql(f'{RSI} < 60', f'{RSI} > 40')}{JOIN}")
def gate_rsi(spark, root):
    return gate(st.run_studies(event_bars(spark, root, H1), st.rsi(14, 60, 40)), "rsi", "rsi")


# --- moving averages --------------------------------------------------------------

def _wma(x: str, n: int) -> str:
    terms = " + ".join(f"{n - k} * lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY n)" for k in range(n))
    return f"(({terms}) / {n * (n + 1) / 2!r})"


def _ma_query(kind: str, sql_from: str, n: int = 16):
    """Registers value and slope gate of one moving average."""
    @query(f"gate_ma_{kind.lower()}", f"{sql_from} SELECT {KEY} {r6('ma', 'ma')}, "
           + gate_sql("ma > lag(ma, 10) OVER (PARTITION BY symbol ORDER BY n)",
                      "ma < lag(ma, 10) OVER (PARTITION BY symbol ORDER BY n)") + " FROM m")
    def run(spark, root):
        study = st.ma_slope_gate(10, base=st.moving_average(kind, n))
        bars = event_bars(spark, root, H1 if kind == "EMA" else M15)
        return gate(st.run_studies(bars, study), "ma_slope", "ma")
    return run


_ma_query("SMA", I15 + f", m AS (SELECT *, {sma_sql('close', 16)} AS ma FROM i)")
_ma_query("WMA", I15 + f", m AS (SELECT *, {_wma('close', 16)} AS ma FROM i)")
_ma_query("HMA", I15 + f", m0 AS (SELECT *, 2 * {_wma('close', 8)} - {_wma('close', 16)} AS raw FROM i), "
          f"m AS (SELECT *, {_wma('raw', 4)} AS ma FROM m0)")
_ma_query("EMA", f"{R1H}, {smooth_sql('r', 'i', {'ma': ('close', 2 / 17)})}, m AS (SELECT * {JOIN})")


@query("gate_ma_htf", bars_sql(M15) + f""", hb AS (SELECT symbol, time_bucket(INTERVAL '14400 seconds', ts) AS hts, last(close ORDER BY ts) AS close FROM b GROUP BY 1, 2),
  hn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hts) - 1 AS n FROM hb),
  hm AS (SELECT symbol, hts, {sma_sql('close', 5)} AS ma FROM hn),
  hp AS (SELECT symbol, hts, lag(ma) OVER (PARTITION BY symbol ORDER BY hts) AS ma FROM hm),
  m AS (SELECT i.*, hp.ma FROM i JOIN hp ON hp.symbol = i.symbol AND hp.hts = time_bucket(INTERVAL '14400 seconds', i.ts))
  SELECT {KEY} {r6('ma', 'ma')}, {gate_sql('ma > lag(ma, 10) OVER (PARTITION BY symbol ORDER BY n)', 'ma < lag(ma, 10) OVER (PARTITION BY symbol ORDER BY n)')} FROM m""")
def gate_ma_htf(spark, root):
    bars = event_bars(spark, root)
    htf = st.run_studies(htf_bars(bars, H4), st.moving_average("SMA", 5), gates=False)
    joined = attach_completed(bars, htf, H4, ["ma"])
    return gate(st.run_studies(joined, st.ma_slope_gate(10)), "ma_slope", "ma")


# --- recurrent gates ----------------------------------------------------------------

def _macd_cte(source: str, name: str = "r") -> str:
    """fast, slow and signal in one recursion."""
    f, s, g = 2 / 13, 2 / 27, 2 / 10
    fast, slow = f"((1 - {f!r}) * r.f + {f!r} * s.close)", f"((1 - {s!r}) * r.s + {s!r} * s.close)"
    return f"""{name} AS (SELECT symbol, n, close AS f, close AS s, 0.0::DOUBLE AS g FROM {source} WHERE n = 0 UNION ALL
  SELECT s.symbol, s.n, {fast}, {slow}, (1 - {g!r}) * r.g + {g!r} * ({fast} - {slow})
  FROM {name} r JOIN {source} s ON s.symbol = r.symbol AND s.n = r.n + 1)"""


_SLOPE = f"""(hist - lag(hist, 3) OVER (PARTITION BY symbol ORDER BY n)) / nullif(CASE WHEN {over('count(hist)', 50)} = 50
  THEN {over('stddev_pop(hist)', 50)} END, 0)"""


@query("gate_macd", f"{R1H}, {_macd_cte('i')}, m AS (SELECT *, f - s - g AS hist{JOIN}) SELECT {KEY} {r6('hist', 'macd_hist')}, "
       + gate_sql("hist > 0", "hist < 0") + " FROM m")
def gate_macd(spark, root):
    return gate(st.run_studies(event_bars(spark, root, H1), st.macd_values(), st.macd_gate()), "macd", "macd_hist")


@query("gate_macd_strict", f"""{R1H}, {_macd_cte('i')}, m AS (SELECT *, f - s - g AS hist{JOIN}), k AS (SELECT *, {_SLOPE} AS slope FROM m)
  SELECT {KEY} {r6('slope', 'macd_slope')}, {gate_sql('hist > 0 AND slope > 0', 'hist < 0 AND slope < 0')} FROM k""")
def gate_macd_strict(spark, root):
    df = st.run_studies(event_bars(spark, root, H1), st.macd_values(), st.macd_gate("strict"))
    return gate(df, "macd", "macd_slope")


@query("gate_macd_htf", f"""{bars_sql(H1, recursive=True)}, hb AS (SELECT symbol, time_bucket(INTERVAL '14400 seconds', ts) AS hts, last(close ORDER BY ts) AS close FROM b GROUP BY 1, 2),
  hn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hts) - 1 AS n FROM hb), {_macd_cte('hn')},
  hp AS (SELECT symbol, hts, lag(f - s - g) OVER (PARTITION BY symbol ORDER BY hts) AS hist FROM hn JOIN r USING (symbol, n)),
  m AS (SELECT i.*, hp.hist FROM i JOIN hp ON hp.symbol = i.symbol AND hp.hts = time_bucket(INTERVAL '14400 seconds', i.ts)),
  k AS (SELECT *, {_SLOPE} AS slope FROM m)
  SELECT {KEY} {r6('hist', 'macd_hist')}, {r6('slope', 'macd_slope')}, {gate_sql('slope > 0', 'slope < 0')} FROM k""")
def gate_macd_htf(spark, root):
    bars = event_bars(spark, root, H1)
    htf = st.run_studies(htf_bars(bars, H4), st.macd_values(), gates=False)
    joined = attach_completed(bars, htf, H4, ["macd_hist"])
    return gate(st.run_studies(joined, st.macd_gate("slope")), "macd", "macd_hist", "macd_slope")


_DM = {"p": ("CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END", 0.1),
       "m": ("CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END", 0.1), "t": ("tr", 0.1)}
_DX = "100 * coalesce(abs(p - m) / nullif(p + m, 0), 0)"


@query("gate_adx", f"""{R1H}, {smooth_sql('q', 'i', _DM)}, dx AS MATERIALIZED (SELECT symbol, n, {_DX} AS dx FROM q),
  {smooth_sql('r', 'dx', {'adx': ('dx', 1 / 14)})} SELECT {KEY} {r6('adx', 'adx')}, {gate_sql('adx > 18', 'adx > 18')}{JOIN}""")
def gate_adx(spark, root):
    return gate(st.run_studies(event_bars(spark, root, H1), st.adx()), "adx", "adx")


@query("gate_volume", f"""{R1H}, {smooth_sql('r', 'i', {'a': ('tr', 1 / 14)})},
  m AS (SELECT *, volume / greatest(a, 1e-10::DOUBLE) AS v{JOIN}), k AS (SELECT *, {sma_sql('v', 20)} AS vm FROM m)
  SELECT {KEY} {r6('v', 'vol_norm', 4)}, {gate_sql('v > vm', 'v > vm')} FROM k""")
def gate_volume(spark, root):
    return gate(st.run_studies(event_bars(spark, root, H1), st.volume()), "vol", "vol_norm", places=4)


@query("gate_keltner", f"""{R1H}, {smooth_sql('r', 'i', {'e': ('close', 2 / 21), 'a': ('tr', 0.1)})}
  SELECT {KEY} {r6('e + a * 1.5::DOUBLE', 'kc_upper')}, {r6('e - a * 1.5::DOUBLE', 'kc_lower')}, {gate_sql('close < e + a * 1.5::DOUBLE', 'close > e - a * 1.5::DOUBLE')}{JOIN}""")
def gate_keltner(spark, root):
    return gate(st.run_studies(event_bars(spark, root, H1), st.keltner()), "kc", "kc_upper", "kc_lower")


# --- fixed-lookback gates -------------------------------------------------------------

@query("gate_vwap", I15 + f""", m AS (SELECT *, sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap
  FROM i WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts))
  SELECT {KEY} {r6('vwap', 'vwap')}, {gate_sql('close > vwap * 1.001::DOUBLE', 'close < vwap * 0.999::DOUBLE')} FROM m""")
def gate_vwap(spark, root):
    return gate(st.run_studies(event_bars(spark, root), st.vwap(0.1)), "vwap", "vwap")


_SPAN = f"({over('max(high)', 14)} - {over('min(low)', 14)})"


@query("gate_choppiness", I15 + f""", m AS (SELECT *, CASE WHEN {over('count(*)', 14)} = 14 THEN CASE WHEN {_SPAN} > 0 THEN
  100 * log10({over('sum(tr)', 14)} / {_SPAN}) / log10(14) ELSE 100 END END AS chop FROM i)
  SELECT {KEY} {r6('chop', 'chop')}, {gate_sql('chop < 61.8::DOUBLE', 'chop < 61.8::DOUBLE')} FROM m""")
def gate_choppiness(spark, root):
    return gate(st.run_studies(event_bars(spark, root), st.choppiness()), "chop", "chop")


@query("gate_roc", I15 + f""", m AS (SELECT *, (close - lag(close, 14) OVER w) / nullif(lag(close, 14) OVER w, 0) * 100 AS roc FROM i
  WINDOW w AS (PARTITION BY symbol ORDER BY n)) SELECT {KEY} {r6('roc', 'roc')}, {gate_sql('roc > 0.1::DOUBLE', 'roc < -0.1::DOUBLE')} FROM m""")
def gate_roc(spark, root):
    return gate(st.run_studies(event_bars(spark, root), st.roc()), "roc", "roc")


@query("gate_bbw", I15 + f""", m AS (SELECT *, CASE WHEN {over('count(*)', 14)} = 14 THEN 4 * {over('stddev_pop(close)', 14)} / {over('avg(close)', 14)} END AS bbw FROM i),
  k AS (SELECT *, {sma_sql('bbw', 30)} AS bm FROM m) SELECT {KEY} {r6('bbw', 'bbw')}, {gate_sql('bbw > bm * 0.5::DOUBLE', 'bbw > bm * 0.5::DOUBLE')} FROM k""")
def gate_bbw(spark, root):
    return gate(st.run_studies(event_bars(spark, root), st.bollinger_width()), "bbw", "bbw")


@query("gate_dpo", I15 + f""", m AS (SELECT *, close - {sma_sql('close', 20)} AS raw FROM i), k AS (SELECT *, {sma_sql('raw', 3)} / nullif(close, 0) * 100 AS dpo FROM m)
  SELECT {KEY} {r6('dpo', 'dpo')}, {gate_sql('dpo < 0 AND dpo > -20', 'dpo > 0 AND dpo < 20')} FROM k""")
def gate_dpo(spark, root):
    return gate(st.run_studies(event_bars(spark, root), st.dpo(threshold=20.0)), "dpo", "dpo")


@query("gate_cci", I15 + f""", m AS (SELECT *, {sma_sql('close', 20)} AS mean, {over('list(close)', 20)} AS xs FROM i),
  k AS (SELECT *, (close - mean) / nullif(0.015::DOUBLE * list_avg(list_transform(xs, lambda x: abs(x - mean))), 0) AS cci FROM m)
  SELECT {KEY} {r6('cci', 'cci')}, {gate_sql('cci < 100', 'cci > -100')} FROM k""")
def gate_cci(spark, root):
    return gate(st.run_studies(event_bars(spark, root), st.cci()), "cci", "cci")


_FIT = f"({over('regr_intercept(close, n)', 10)} + {over('regr_slope(close, n)', 10)} * n)"


@query("gate_angle", I15 + f""", m AS (SELECT *, CASE WHEN {over('count(*)', 10)} = 10 THEN {_FIT} END AS fit,
  CASE WHEN {over('count(*)', 10)} = 10 THEN {over('stddev_pop(close)', 10)} END AS sd FROM i),
  k AS (SELECT *, atan((fit - lag(fit, 10) OVER (PARTITION BY symbol ORDER BY n)) / greatest(sd, close * 0.0001::DOUBLE)) AS angle FROM m)
  SELECT {KEY} {r6('angle', 'angle')}, {gate_sql('angle > 0.15::DOUBLE', 'angle < -0.15::DOUBLE')} FROM k""")
def gate_angle(spark, root):
    return gate(st.run_studies(event_bars(spark, root), st.local_angle()), "angle", "angle")


# --- state machines ---------------------------------------------------------------------

_UP = "CASE WHEN s.bu < r.u OR r.c > r.u THEN s.bu ELSE r.u END"
_LO = "CASE WHEN s.bl > r.l OR r.c < r.l THEN s.bl ELSE r.l END"


def supertrend_sql() -> str:
    """``k``: hourly bars with the active line and direction ``d``."""
    return f"""{R1H}, {smooth_sql('a', 'i', {'atr': ('tr', 0.1)})},
  s0 AS MATERIALIZED (SELECT symbol, n, close, (high + low) / 2 + 3 * atr AS bu, (high + low) / 2 - 3 * atr AS bl FROM i JOIN a USING (symbol, n)),
  r AS (SELECT symbol, n, bu AS u, bl AS l, close AS c, 1 AS d FROM s0 WHERE n = 0 UNION ALL
  SELECT s.symbol, s.n, {_UP}, {_LO}, s.close, CASE WHEN r.d = 1 THEN CASE WHEN s.close > {_UP} THEN -1 ELSE 1 END
    ELSE CASE WHEN s.close < {_LO} THEN 1 ELSE -1 END END
  FROM r JOIN s0 s ON s.symbol = r.symbol AND s.n = r.n + 1),
  k AS (SELECT *, CASE WHEN d = 1 THEN u ELSE l END AS line{JOIN})"""


@query("gate_supertrend", f"""{supertrend_sql()}
  SELECT {KEY} {r6('line', 'supertrend')}, d::BIGINT AS st_direction, {gate_sql('close > line', 'close < line')} FROM k""")
def gate_supertrend(spark, root):
    df = add_supertrend(event_bars(spark, root, H1), 10, 3.0)
    return show(df, "symbol", "ts_utc", F.col("st_direction").cast("long").alias("st_direction"),
                F.col("supt_long").alias("long"), F.col("supt_short").alias("short"), supertrend="supertrend")


@query("gate_supertrend_sma", f"""{R1H}, seeded AS MATERIALIZED (SELECT symbol, n, high, low, close, tr, {sma_sql('tr', 10)} AS first10 FROM i),
  a AS (SELECT symbol, n, first10 AS atr FROM seeded WHERE n = 9 UNION ALL
    SELECT s.symbol, s.n, r.atr * 0.9::DOUBLE + s.tr / 10 FROM a r JOIN seeded s ON s.symbol = r.symbol AND s.n = r.n + 1),
  s0 AS MATERIALIZED (SELECT symbol, n, close, (high + low) / 2 + 3 * atr AS bu, (high + low) / 2 - 3 * atr AS bl FROM i JOIN a USING (symbol, n)),
  r AS (SELECT symbol, n, bu AS u, bl AS l, close AS c, 1 AS d FROM s0 WHERE n = 9 UNION ALL
  SELECT s.symbol, s.n, {_UP}, {_LO}, s.close, CASE WHEN r.d = 1 THEN CASE WHEN s.close > {_UP} THEN -1 ELSE 1 END
    ELSE CASE WHEN s.close < {_LO} THEN 1 ELSE -1 END END
  FROM r JOIN s0 s ON s.symbol = r.symbol AND s.n = r.n + 1),
  k AS (SELECT *, CASE WHEN d = 1 THEN u ELSE l END AS line FROM i LEFT JOIN r USING (symbol, n))
  SELECT {KEY} {r6('line', 'supertrend')}, d::BIGINT AS st_direction, {gate_sql('close > line', 'close < line')} FROM k""")
def gate_supertrend_sma(spark, root):
    df = add_supertrend(event_bars(spark, root, H1), 10, 3.0, seed="sma", block_rows=64)
    return show(df, "symbol", "ts_utc", F.col("st_direction").cast("long").alias("st_direction"),
                F.col("supt_long").alias("long"), F.col("supt_short").alias("short"), supertrend="supertrend")


def zigzag_sql(source: str, p: str) -> str:
    """One row per bar: trend ``t``, leg extremes, last extremes and ``bias``."""
    down = f"(r.t = 1 AND NOT s.high > r.h AND s.low < r.h - s.close * {p})"
    up = f"(r.t = -1 AND NOT s.low < r.l AND s.high > r.l + s.close * {p})"
    at_once = f"low < high - close * {p}"
    return f"""r AS (SELECT symbol, n, high AS h, low AS l, CASE WHEN {at_once} THEN -1 ELSE 1 END AS t,
    CASE WHEN {at_once} THEN high ELSE 0 END AS lh, 0.0::DOUBLE AS ll, 0 AS bias FROM {source} WHERE n = 0
  UNION ALL SELECT s.symbol, s.n,
    CASE WHEN r.t = 1 AND s.high > r.h THEN s.high WHEN {up} THEN s.high ELSE r.h END,
    CASE WHEN r.t = -1 AND s.low < r.l THEN s.low WHEN {down} THEN s.low ELSE r.l END,
    CASE WHEN {down} THEN -1 WHEN {up} THEN 1 ELSE r.t END,
    CASE WHEN {down} THEN r.h ELSE r.lh END, CASE WHEN {up} THEN r.l ELSE r.ll END,
    CASE WHEN {down} THEN CASE WHEN r.ll > 0 THEN sign(s.low - r.ll) ELSE 0 END
         WHEN {up} THEN CASE WHEN r.lh > 0 THEN sign(s.high - r.lh) ELSE 0 END ELSE r.bias END
  FROM r JOIN {source} s ON s.symbol = r.symbol AND s.n = r.n + 1)"""


def _pivot(df):
    return df.select("symbol", "ts_utc", *(F.col(c).cast("long").alias(c) for c in ("zz_trend", "zz_bias")),
                     F.col("pivot_long").alias("long"), F.col("pivot_short").alias("short"))


@query("gate_pivot", f"{R1H}, {zigzag_sql('i', '0.3::DOUBLE')} SELECT {KEY} t::BIGINT AS zz_trend, bias::BIGINT AS zz_bias, {gate_sql('bias = 1', 'bias = -1')}{JOIN}")
def gate_pivot(spark, root):
    return _pivot(st.run_studies(add_zigzag(event_bars(spark, root, H1), 30.0), pivot_gate()))


@query("gate_pivot_htf", f"""{R1H}, hb AS (SELECT symbol, time_bucket(INTERVAL '14400 seconds', ts) AS hts, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close FROM b GROUP BY 1, 2),
  hn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hts) - 1 AS n FROM hb), {zigzag_sql('hn', '0.1::DOUBLE')},
  hp AS (SELECT symbol, hts, lag(t) OVER w AS t, lag(bias) OVER w AS bias FROM hn JOIN r USING (symbol, n) WINDOW w AS (PARTITION BY symbol ORDER BY hts))
  SELECT i.symbol, i.ts AS ts_utc, t::BIGINT AS zz_trend, bias::BIGINT AS zz_bias, {gate_sql('bias = 1', 'bias = -1')}
  FROM i JOIN hp ON hp.symbol = i.symbol AND hp.hts = time_bucket(INTERVAL '14400 seconds', i.ts)""")
def gate_pivot_htf(spark, root):
    bars = event_bars(spark, root, H1)
    htf = add_zigzag(stage(htf_bars(bars, H4), "htf"), 10.0)
    return _pivot(st.run_studies(attach_completed(bars, htf, H4, ["zz_trend", "zz_bias"]), pivot_gate()))


# --- triggers and conjunction ---------------------------------------------------------------

@query("edge_trigger", I15 + f""", m AS (SELECT *, greatest(close - 20, 0) AS a, CASE WHEN volume > 90 THEN volume ELSE 0 END AS z FROM i),
  k AS (SELECT *, lag(a) OVER (PARTITION BY symbol ORDER BY n) AS pa, lag(z) OVER (PARTITION BY symbol ORDER BY n) AS pz FROM m)
  SELECT {KEY} coalesce(a > 0 AND pa = 0, false) OR coalesce(z > 0 AND pz = 0, false) AS fires FROM k""")
def edge_trigger(spark, root):
    df = event_bars(spark, root).withColumns({
        "a": F.greatest(F.col("close") - 20, F.lit(0.0)),
        "z": F.when(F.col("volume") > 90, F.col("volume")).otherwise(0.0)})
    return st.run_studies(df, st.edge_trigger("a", "z", "fires"), gates=False).select("symbol", "ts_utc", "fires")


@query("gate_conjunction", I15 + f""", m AS (SELECT *, {sma_sql('close', 16)} AS ma, (close - lag(close, 14) OVER (PARTITION BY symbol ORDER BY n)) / nullif(lag(close, 14) OVER (PARTITION BY symbol ORDER BY n), 0) * 100 AS roc,
  CASE WHEN {over('count(*)', 14)} = 14 THEN CASE WHEN {_SPAN} > 0 THEN 100 * log10({over('sum(tr)', 14)} / {_SPAN}) / log10(14) ELSE 100 END END AS chop FROM i),
  k AS (SELECT *, lag(ma, 10) OVER (PARTITION BY symbol ORDER BY n) AS mb FROM m)
  SELECT {KEY} {gate_sql('ma > mb AND roc > 0.1::DOUBLE AND chop < 61.8::DOUBLE', 'ma < mb AND roc < -0.1::DOUBLE AND chop < 61.8::DOUBLE')} FROM k""")
def gate_conjunction(spark, root):
    chosen = [st.ma_slope_gate(10, base=st.moving_average("SMA", 16)), st.roc(), st.choppiness()]
    df = st.run_studies(event_bars(spark, root), *chosen)
    return df.select("symbol", "ts_utc", *(
        all_gates([F.col(f"{s.name}_{side}") for s in chosen]).alias(side) for side in ("long", "short")))


@query("all_gates", None)
def every_gate(spark, root):
    """All smoothing and lookback gates together: one scan each for the shared parts."""
    chosen = [st.macd_values(), st.macd_gate(), st.ma_slope_gate(10, base=st.moving_average("EMA", 25)), st.vwap(),
              st.choppiness(), st.adx(), st.roc(), st.volume(), st.bollinger_width(), st.keltner(), st.rsi(),
              st.dpo(), st.cci(), st.local_angle()]
    df = st.run_studies(event_bars(spark, root), *chosen)
    gated = [s for s in chosen if s.long is not None]
    return df.select("symbol", "ts_utc", *(f"{s.name}_{side}" for s in gated for side in ("long", "short")), *(
        all_gates([F.col(f"{s.name}_{side}") for s in gated]).alias(f"all_{side}") for side in ("long", "short")))
