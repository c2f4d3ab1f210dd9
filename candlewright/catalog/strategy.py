"""Pricing, risk limit, funnel and trade reports."""

from pyspark.sql import functions as F

from candlewright.catalog.base import (
    H1, H4, bars_sql, event_bars, query, r6, rounded, show, smooth_sql, trigger_sql)
from candlewright.functions.text import alert_text
from candlewright.operators import funnel
from candlewright.operators.risk import RiskRules
from candlewright.plans.strategy import Strategy, indicator_report, run_strategy, strategy_report, trades_of
from candlewright.plans.strategy import strategy_inputs

#: Tight enough that some signals are limited: daily ranges exist from day 21 on.
CLAMP = Strategy(htf_seconds=H4, rules=RiskRules(limit=0.3, allow_exceed=True))
REJECT = Strategy(htf_seconds=H4, rules=RiskRules(limit=0.3))
TP_MULT = Strategy(htf_seconds=H4, rules=RiskRules(sl_mult=1.4, tp_mult=3.5, limit=0.3, allow_exceed=True))
SLICED = Strategy(htf_seconds=H4, start="2024-01-08 01:00:00", end="2024-01-22 16:00:00")

SMOOTHED = {"atr": ("tr", 1 / 14), "g": ("greatest(coalesce(close - pc, 0), 0)", 1 / 14),
            "l": ("greatest(coalesce(pc - close, 0), 0)", 1 / 14)}


def strategy_sql(limit: str = "0.3::DOUBLE", allow: bool = True, tp: str = "2.8::DOUBLE", ranged: bool = True,
                 reward: str = "2.0::DOUBLE") -> str:
    """CTEs ending in ``f``: one row per bar with stage signals and pricing."""
    over = f"coalesce(share > {limit}, false)" if ranged else "false"
    clamped = f"close - sgn * {limit} * rng"
    sl = f"CASE WHEN {over} THEN {clamped} ELSE raw_sl END" if allow else f"CASE WHEN NOT {over} THEN raw_sl END"
    target = f"CASE WHEN {over} THEN close + sgn * abs(close - ({clamped})) * {reward} ELSE close + sgn * atr * {tp} END"
    if not allow:
        target = f"CASE WHEN NOT {over} THEN close + sgn * atr * {tp} END"
    return f"""{bars_sql(H1, recursive=True)}, {smooth_sql('r', 'i', SMOOTHED)}, {trigger_sql(H4)},
dd AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS dh, min(low) AS dl FROM b GROUP BY 1, 2),
dr AS (SELECT symbol, day, CASE WHEN count(*) OVER p >= 20 THEN max(dh) OVER p - min(dl) OVER p END AS rng
  FROM dd WINDOW p AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
f0 AS (SELECT g.*, r.atr, CASE WHEN g.n < 13 OR r.l = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE - 100.0::DOUBLE / (1 + r.g / r.l) END AS rsi, dr.rng,
  CASE WHEN hour(g.ts) * 60 + minute(g.ts) BETWEEN 510 AND 1229 THEN sig END AS sig_time
  FROM g JOIN r USING (symbol, n) JOIN dr ON dr.symbol = g.symbol AND dr.day = CAST(g.ts AS DATE)),
f1 AS (SELECT *, CASE WHEN sig_time = 'BUY' AND rsi < 70 THEN 'BUY' WHEN sig_time = 'SELL' AND rsi > 30 THEN 'SELL' END AS sig_rsi FROM f0),
f2 AS (SELECT *, CASE WHEN sig_rsi = 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn, atr * 1.4::DOUBLE AS dist FROM f1),
f3 AS (SELECT *, CASE WHEN sig_rsi IS NOT NULL AND atr > 0 THEN close - sgn * dist END AS raw_sl FROM f2),
f4 AS (SELECT *, CASE WHEN rng > 0 THEN abs(close - raw_sl) / rng END AS share FROM f3),
f AS MATERIALIZED (SELECT *, {sl} AS sl, CASE WHEN raw_sl IS NOT NULL THEN {target} END AS tp,
  raw_sl IS NOT NULL AND {'true' if allow else f'NOT {over}'} AS approved,
  {f'raw_sl IS NOT NULL AND {over}' if allow else 'false'} AS adjusted,
  CASE WHEN raw_sl IS NOT NULL AND {'true' if allow else f'NOT {over}'} THEN sig_rsi END AS sig_risk FROM f4)"""


def bars(spark, root):
    return event_bars(spark, root, H1)


PRICED = f"""symbol, ts AS ts_utc, sig_rsi AS signal, approved, adjusted, {r6('raw_sl', 'raw_sl', 4)},
  {r6('share', 'risk_share', 5)}, {r6('sl', 'sl', 4)}, {r6('tp', 'tp', 4)} FROM f WHERE sig_rsi IS NOT NULL"""


def _priced(df):
    return df.where(F.col("sig_rsi").isNotNull()).select(
        "symbol", "ts_utc", F.col("sig_rsi").alias("signal"), "approved", "adjusted",
        rounded("raw_sl", 4).alias("raw_sl"), rounded("risk_share", 5).alias("risk_share"),
        rounded("sl", 4).alias("sl"), rounded("tp", 4).alias("tp"))


@query("sl_tp", strategy_sql(ranged=False) + """ SELECT symbol, ts AS ts_utc, sig_rsi AS signal, close AS entry,
  round(sl, 4) + 0.0 AS sl, round(tp, 4) + 0.0 AS tp FROM f WHERE sig_rsi IS NOT NULL""")
def sl_tp(spark, root):
    cfg = Strategy(htf_seconds=H4, rules=RiskRules(limit_enabled=False))
    df = run_strategy(bars(spark, root), cfg).where(F.col("sig_rsi").isNotNull())
    return show(df, "symbol", "ts_utc", F.col("sig_rsi").alias("signal"), "entry", places=4, sl="sl", tp="tp")


@query("sl_tp_own_multiplier", strategy_sql(tp="3.5::DOUBLE", reward="2.5::DOUBLE") + """ SELECT symbol, ts AS ts_utc, sig_rsi AS signal, close AS entry,
  round(sl, 4) + 0.0 AS sl, round(tp, 4) + 0.0 AS tp FROM f WHERE sig_rsi IS NOT NULL""")
def sl_tp_own_multiplier(spark, root):
    df = run_strategy(bars(spark, root), TP_MULT).where(F.col("sig_rsi").isNotNull())
    return show(df, "symbol", "ts_utc", F.col("sig_rsi").alias("signal"), "entry", places=4, sl="sl", tp="tp")


@query("risk_clamp", strategy_sql() + " SELECT " + PRICED)
def risk_clamp(spark, root):
    return _priced(run_strategy(bars(spark, root), CLAMP))


@query("risk_check", strategy_sql(allow=False) + " SELECT " + PRICED)
def risk_check(spark, root):
    return _priced(run_strategy(bars(spark, root), REJECT))


_SHARE = "format('{:.2f}', share * 100)"


@query("risk_comments", strategy_sql() + f""" SELECT symbol, ts AS ts_utc, CASE WHEN share IS NULL THEN 'History insufficient for range calc'
  WHEN share > 0.3::DOUBLE THEN 'SL Adjusted: ' || {_SHARE} || '% -> 30.00%' ELSE 'Risk: ' || {_SHARE} || '% (Limit: 30.00%)' END AS comment
  FROM f WHERE raw_sl IS NOT NULL""")
def risk_comments(spark, root):
    return run_strategy(bars(spark, root), CLAMP).where(F.col("comment").isNotNull()).select("symbol", "ts_utc", "comment")


@query("trades", strategy_sql() + """ SELECT symbol, ts AS ts_utc, sig_risk AS signal, round_even(close, 2) AS entry, round_even(sl, 2) AS sl,
  round_even(tp, 2) AS tp, round_even(abs(close - sl), 2) AS sl_distance, round_even(abs(close - tp), 2) AS tp_distance FROM f WHERE approved""")
def trades(spark, root):
    return trades_of(run_strategy(bars(spark, root), CLAMP), "ts_utc").drop("ts", "comment")


_STAGES = [("raw", "sig"), ("time", "sig_time"), ("rsi", "sig_rsi"), ("risk", "sig_risk")]


def funnel_sql() -> str:
    """One branch per stage, each comparing with the stage before."""
    parts = []
    for k, (name, col) in enumerate(_STAGES):
        before = _STAGES[max(k - 1, 0)][1]
        adj = "count(*) FILTER (adjusted AND sig_risk = '{}')" if name == "risk" else "0::BIGINT"
        parts.append(f"""SELECT symbol, {k + 1} AS step, '{name}' AS stage, count(*) FILTER ({col} = 'BUY') AS buy, count(*) FILTER ({col} = 'SELL') AS sell,
  count({col}) AS total, count(*) FILTER ({before} = 'BUY') - count(*) FILTER ({col} = 'BUY') AS rejected_buy,
  count(*) FILTER ({before} = 'SELL') - count(*) FILTER ({col} = 'SELL') AS rejected_sell, count({before}) - count({col}) AS rejected_total,
  {adj.format('BUY')} AS adjusted_buy, {adj.format('SELL')} AS adjusted_sell,
  coalesce(round_even((count({before}) - count({col}))::DOUBLE / nullif(count({before}), 0) * 100, 2), 0) AS rejection_pct,
  coalesce(round_even((count(sig) - count({col}))::DOUBLE / nullif(count(sig), 0) * 100, 2), 0) AS overall_rejection_pct FROM f GROUP BY symbol""")
    return " UNION ALL ".join(parts)


@query("funnel", f"{strategy_sql(allow=False)} {funnel_sql()}")
def signal_funnel(spark, root):
    return funnel.signal_funnel(run_strategy(bars(spark, root), REJECT))


TR = """, tr AS (SELECT symbol, sig_risk AS signal, round_even(abs(close - sl), 2) AS sld, round_even(abs(close - tp), 2) AS tpd FROM f WHERE approved)"""


@query("distance_stats", strategy_sql() + TR + """ SELECT symbol, count(*) AS total_trades, count(*) FILTER (signal = 'BUY') AS buy_trades,
  count(*) FILTER (signal = 'SELL') AS sell_trades, round(avg(sld), 4) + 0.0 AS avg_sl_distance, round(avg(tpd), 4) + 0.0 AS avg_tp_distance,
  max(sld) AS max_sl_distance, min(sld) AS min_sl_distance FROM tr GROUP BY 1""")
def distance_stats(spark, root):
    stats = funnel.distance_stats(trades_of(run_strategy(bars(spark, root), CLAMP)))
    return stats.withColumns({c: rounded(c, 4) for c in ("avg_sl_distance", "avg_tp_distance")})


@query("expectancy", strategy_sql() + TR + """, a AS (SELECT symbol, avg(sld) AS sl, count(*) AS n FROM tr GROUP BY 1),
  w AS (SELECT unnest([0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE]) AS win_rate)
  SELECT symbol, win_rate, round_even(win_rate * 2 - (1 - win_rate), 3) AS expected_r, round_even((win_rate * 2 - (1 - win_rate)) * sl, 2) AS expected_points,
  round_even((win_rate * 2 - (1 - win_rate)) * n, 2) AS total_r, round_even(1.0::DOUBLE / 3, 3) AS breakeven_win_rate FROM a, w""")
def expectancy(spark, root):
    return funnel.expectancy(funnel.distance_stats(trades_of(run_strategy(bars(spark, root), CLAMP))), 2.0)


_LEAD = "CASE WHEN sig_risk = 'BUY' THEN '\U0001F7E2 BUY' ELSE '\U0001F534 SELL' END"


def _num(x: str, places: int) -> str:
    return f"rtrim(rtrim(format('{{:.{places}f}}', round_even({x}, {places})), '0'), '.')"


@query("alert_text", strategy_sql() + f""", p AS (SELECT *, round_even(sl, 2) AS s2, round_even(tp, 2) AS t2 FROM f WHERE approved)
  SELECT symbol, ts AS ts_utc, {_LEAD} || ' SIGNAL' || chr(10) || 'Symbol: ' || symbol || chr(10) || 'Entry Price: ' || {_num('close', 5)} || chr(10) ||
  'Stop Loss: ' || {_num('s2', 5)} || chr(10) || 'Take Profit: ' || {_num('t2', 5)} || chr(10) ||
  'RR Ratio: 1:' || {_num('CASE WHEN abs(close - s2) > 0 THEN abs(t2 - close) / abs(close - s2) ELSE 0 END', 2)} || chr(10) ||
  'Time: ' || strftime(ts, '%d/%m/%Y %H:%M') AS alert FROM p""")
def alerts(spark, root):
    df = run_strategy(bars(spark, root), CLAMP).where("approved").withColumns({
        "signal": F.col("sig_risk"), "sl": F.bround("sl", 2), "tp": F.bround("tp", 2)})
    return df.select("symbol", "ts_utc", alert_text().alias("alert"))


_GL = {k: SMOOTHED[k] for k in ("g", "l")}
_RSI = "CASE WHEN g.n < 13 OR rs.l = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE - 100.0::DOUBLE / (1 + rs.g / rs.l) END"


@query("strategy_slice", f"""{bars_sql(H1, recursive=True)}, si AS MATERIALIZED (SELECT symbol, ts, open, high, low, close, volume,
  row_number() OVER w - 1 AS n, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM b
  WHERE ts BETWEEN TIMESTAMP '2024-01-08 01:00:00' AND TIMESTAMP '2024-01-22 16:00:00' WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  {smooth_sql('r', 'i', {'atr': SMOOTHED['atr']})}, {smooth_sql('rs', 'si', _GL)}, {trigger_sql(H4, 'si')},
  z AS (SELECT g.*, {_RSI} AS rsi, r.atr FROM g JOIN rs USING (symbol, n) JOIN i ON i.symbol = g.symbol AND i.ts = g.ts
    JOIN r ON r.symbol = i.symbol AND r.n = i.n)
  SELECT symbol, ts AS ts_utc, sig AS sig_raw, CASE WHEN atr > 0 AND hour(ts) * 60 + minute(ts) BETWEEN 510 AND 1229
    AND ((sig = 'BUY' AND rsi < 70) OR (sig = 'SELL' AND rsi > 30)) THEN sig END AS sig_risk, {r6('rsi', 'rsi')}, {r6('atr', 'atr')} FROM z""")
def strategy_slice(spark, root):
    df = run_strategy(bars(spark, root), SLICED)
    return show(df, "symbol", "ts_utc", "sig_raw", "sig_risk", rsi="rsi", atr="atr")


@query("strategy_report", None)
def report(spark, root):
    return strategy_report(run_strategy(bars(spark, root), CLAMP), CLAMP).select(
        "symbol", F.to_json(F.struct("settings", "signal_flow", "performance", "theoretical_scenarios",
                                     "buy_samples", "sell_samples")).alias("report"))


@query("indicator_report", None)
def trigger_report(spark, root):
    df = indicator_report(strategy_inputs(bars(spark, root), CLAMP))
    return df.select("symbol", F.to_json(F.struct(*[c for c in df.columns if c != "symbol"])).alias("report"))
