"""Exits, selection, performance, equity and the sweep."""

from pyspark.sql import functions as F

from candlewright.catalog.base import H1, H4, event_bars, query, rounded
from candlewright.catalog.strategy import bars, strategy_sql
from candlewright.operators import outcomes as oc
from candlewright.operators.risk import RiskRules
from candlewright.plans.strategy import Strategy, run_strategy
from candlewright.plans.sweep import best_params, sweep_metrics, sweep_trades
from candlewright.session import stage

CFG = Strategy(htf_seconds=H4, rules=RiskRules(limit_enabled=False))
BASE = strategy_sql(ranged=False)


def _signals(spark, root):
    df = run_strategy(bars(spark, root), CFG).where("approved")
    return df.select("symbol", "bar_no", "ts_utc", "close", "entry", "sl", "tp", F.col("sig_risk").alias("signal"))


def touched(spark, root):
    return oc.first_touch(_signals(spark, root), bars(spark, root))


def opposed(spark, root):
    trades = oc.first_touch(oc.next_opposite(stage(_signals(spark, root), "signals")), bars(spark, root))
    return oc.close_on_opposite(trades)


def kept(spark, root):
    return oc.add_profit(oc.one_position(stage(touched(spark, root), "trades")).where("kept"))


EXITS = """, s AS MATERIALIZED (SELECT symbol, n, ts, close, sig_risk AS signal, sl, tp, sgn FROM f WHERE approved),
hit AS (SELECT s.symbol, s.n, min(b.n) AS exit_no FROM s JOIN i b ON b.symbol = s.symbol AND b.n > s.n
  AND (b.low <= least(sl, tp) OR b.high >= greatest(sl, tp)) GROUP BY 1, 2),
x AS MATERIALIZED (SELECT s.*, h.exit_no, e.ts AS exit_ts, CASE WHEN h.exit_no IS NULL THEN 'open'
  WHEN (sgn > 0 AND e.low <= sl) OR (sgn < 0 AND e.high >= sl) THEN 'sl' ELSE 'tp' END AS exit_reason
  FROM s LEFT JOIN hit h USING (symbol, n) LEFT JOIN i e ON e.symbol = s.symbol AND e.n = h.exit_no),
xp AS MATERIALIZED (SELECT *, CASE exit_reason WHEN 'sl' THEN sl WHEN 'tp' THEN tp END AS exit_price FROM x)"""

OPPOSED = EXITS + """, o AS (SELECT s.symbol, s.n, min(z.n) AS opp_no FROM s JOIN s z ON z.symbol = s.symbol AND z.n > s.n AND z.signal <> s.signal GROUP BY 1, 2),
op AS (SELECT xp.*, o.opp_no, z.ts AS opp_ts, z.close AS opp_close, o.opp_no IS NOT NULL AND (xp.exit_no IS NULL OR o.opp_no < xp.exit_no) AS early
  FROM xp LEFT JOIN o USING (symbol, n) LEFT JOIN s z ON z.symbol = xp.symbol AND z.n = o.opp_no),
oe AS MATERIALIZED (SELECT symbol, n, ts, close, signal, sgn, CASE WHEN early THEN opp_no ELSE exit_no END AS exit_no,
  CASE WHEN early THEN opp_ts ELSE exit_ts END AS exit_ts, CASE WHEN early THEN 'opposite' ELSE exit_reason END AS exit_reason,
  CASE WHEN early THEN opp_close ELSE exit_price END AS exit_price FROM op)"""

KEPT = EXITS + """, kn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n) AS k FROM xp),
kr AS (SELECT symbol, k, n, true AS kept, coalesce(exit_no, 999999999) AS busy FROM kn WHERE k = 1 UNION ALL
  SELECT s.symbol, s.k, s.n, s.n >= r.busy, CASE WHEN s.n >= r.busy THEN coalesce(s.exit_no, 999999999) ELSE r.busy END
  FROM kr r JOIN kn s ON s.symbol = r.symbol AND s.k = r.k + 1),
kk AS MATERIALIZED (SELECT kn.*, kr.kept FROM kn JOIN kr USING (symbol, k))"""


@query("exits", BASE + EXITS + """ SELECT symbol, ts AS ts_utc, signal, n AS bar_no, exit_no, exit_ts, exit_reason,
  round(exit_price, 4) + 0.0 AS exit_price FROM xp""")
def exits(spark, root):
    return touched(spark, root).select("symbol", "ts_utc", "signal", "bar_no", "exit_no", "exit_ts", "exit_reason",
                                       rounded("exit_price", 4).alias("exit_price"))


@query("opposite_exits", BASE + OPPOSED + """ SELECT symbol, ts AS ts_utc, signal, n AS bar_no, exit_no, exit_ts, exit_reason,
  round(exit_price, 4) + 0.0 AS exit_price FROM oe""")
def opposite_exits(spark, root):
    return opposed(spark, root).select("symbol", "ts_utc", "signal", "bar_no", "exit_no", "exit_ts", "exit_reason",
                                       rounded("exit_price", 4).alias("exit_price"))


@query("one_position", BASE + KEPT + " SELECT symbol, ts AS ts_utc, signal, n AS bar_no, exit_no, kept FROM kk")
def one_position(spark, root):
    return oc.one_position(stage(touched(spark, root), "trades")).select(
        "symbol", "ts_utc", "signal", "bar_no", "exit_no", "kept")


PROFIT = """, pf AS MATERIALIZED (SELECT *, sgn * (exit_price - close) - (close + exit_price) * 0.0001::DOUBLE AS profit, exit_no - n AS held,
  (sgn * (exit_price - close) - (close + exit_price) * 0.0001::DOUBLE) / close AS ret,
  CASE WHEN signal = 'BUY' THEN 'LONG' ELSE 'SHORT' END AS sd FROM {source} WHERE exit_price IS NOT NULL{extra})"""
SIDES = " FROM pf GROUP BY GROUPING SETS ((symbol, sd), (symbol))"
SIDE = "CASE WHEN grouping(sd) = 1 THEN 'TOTAL' ELSE sd END AS side"


@query("performance", BASE + KEPT + PROFIT.format(source="kk", extra=" AND kept") + f""", ag AS (SELECT symbol, {SIDE}, count(*) AS trades,
  count(*) FILTER (profit > 0) AS wins, coalesce(sum(profit) FILTER (profit > 0), 0) AS gp, coalesce(-sum(profit) FILTER (profit <= 0), 0) AS gl{SIDES}),
  a2 AS (SELECT *, gp / nullif(wins, 0) AS ap, coalesce(gl / nullif(trades - wins, 0), 0) AS al FROM ag)
  SELECT symbol, side, trades, wins, trades - wins AS losses, round(gp, 4) + 0.0 AS gross_profit, round(gl, 4) + 0.0 AS gross_loss,
  round(wins * 100.0::DOUBLE / trades, 4) + 0.0 AS win_rate, round(gp - gl, 4) + 0.0 AS net_profit,
  round(CASE WHEN gl > 0 THEN gp / gl WHEN gp > 0 THEN 999 ELSE 0 END, 4) + 0.0 AS profit_factor, round(ap, 4) + 0.0 AS avg_profit,
  round(al, 4) + 0.0 AS avg_loss, round(CASE WHEN al > 0 THEN coalesce(ap, 0) / al WHEN ap > 0 THEN 999 ELSE 0 END, 4) + 0.0 AS avg_factor FROM a2""")
def performance(spark, root):
    df = oc.performance(kept(spark, root))
    exact = ["symbol", "side", "trades", "wins", "losses"]
    return df.select(*exact, *(rounded(c, 4).alias(c) for c in df.columns if c not in exact))


@query("durations", BASE + KEPT + PROFIT.format(source="kk", extra=" AND kept") + f""" SELECT symbol, {SIDE}, round(avg(held), 4) + 0.0 AS avg_bars,
  round(coalesce(avg(held) FILTER (profit > 0), 0), 4) + 0.0 AS avg_win_bars, round(coalesce(avg(held) FILTER (profit <= 0), 0), 4) + 0.0 AS avg_loss_bars{SIDES}""")
def durations(spark, root):
    df = oc.durations(kept(spark, root))
    return df.select("symbol", "side", *(rounded(c, 4).alias(c) for c in ("avg_bars", "avg_win_bars", "avg_loss_bars")))


@query("opposite_share", BASE + OPPOSED + PROFIT.format(source="oe", extra="") + f""" SELECT symbol, {SIDE}, count(*) FILTER (exit_reason = 'opposite') AS opposite_closes,
  round(count(*) FILTER (exit_reason = 'opposite') * 100.0::DOUBLE / count(*), 4) + 0.0 AS opposite_pct{SIDES}""")
def opposite_share(spark, root):
    df = oc.opposite_share(oc.add_profit(opposed(spark, root)))
    return df.withColumn("opposite_pct", rounded("opposite_pct", 4))


EQUITY = BASE + KEPT + PROFIT.format(source="kk", extra=" AND kept") + """, e1 AS (SELECT *, 30000.0::DOUBLE * exp(sum(CASE WHEN 1 + ret * 0.05::DOUBLE > 0 THEN ln(1 + ret * 0.05::DOUBLE) ELSE -1e6 END) OVER (PARTITION BY symbol ORDER BY exit_no, n)) AS equity FROM pf),
  e2 AS (SELECT *, greatest(30000.0::DOUBLE, max(equity) OVER (PARTITION BY symbol ORDER BY exit_no, n)) AS peak FROM e1)"""


@query("equity_curve", EQUITY + " SELECT symbol, exit_ts, n AS bar_no, round(equity, 4) + 0.0 AS equity, round(peak - equity, 4) + 0.0 AS drawdown FROM e2")
def equity_curve(spark, root):
    curve = oc.equity_curve(stage(kept(spark, root), "kept"))
    return curve.select("symbol", "exit_ts", "bar_no", rounded("equity", 4).alias("equity"), rounded("drawdown", 4).alias("drawdown"))


@query("equity", EQUITY + """, z AS (SELECT symbol, count(*) AS closed_trades, last(equity ORDER BY exit_no, n) AS eq, max(peak - equity) AS dd FROM e2 GROUP BY 1)
  SELECT symbol, closed_trades, round(eq, 4) + 0.0 AS equity, round(eq - 30000, 4) + 0.0 AS net_profit, round((eq - 30000) / 300, 4) + 0.0 AS total_return_pct,
  round(dd, 4) + 0.0 AS max_drawdown, round(dd / 300, 4) + 0.0 AS max_drawdown_pct FROM z""")
def equity(spark, root):
    df = oc.equity_summary(oc.equity_curve(stage(kept(spark, root), "kept")))
    return df.select("symbol", "closed_trades", *(rounded(c, 4).alias(c) for c in df.columns[2:]))


PARAMS = [{"sl_mult": s, "reward": r} for s in (1.0, 1.4, 2.0) for r in (1.5, 2.0, 3.0)]


_SETS = ", ".join(f"({i}, {p['sl_mult']}::DOUBLE, {p['reward']}::DOUBLE)" for i, p in enumerate(PARAMS))


@query("sweep", BASE + f""", p AS (SELECT * FROM (VALUES {_SETS}) v(param_id, sm, rw)),
  s AS MATERIALIZED (SELECT symbol, param_id, n, close, sgn, close - sgn * (atr * sm) AS sl, close + sgn * (atr * sm * rw) AS tp FROM f, p WHERE sig_rsi IS NOT NULL AND atr > 0),
  hit AS (SELECT s.symbol, s.param_id, s.n, min(b.n) AS exit_no FROM s JOIN i b ON b.symbol = s.symbol AND b.n > s.n
    AND (b.low <= least(sl, tp) OR b.high >= greatest(sl, tp)) GROUP BY 1, 2, 3),
  kn AS MATERIALIZED (SELECT s.*, h.exit_no, CASE WHEN (sgn > 0 AND e.low <= sl) OR (sgn < 0 AND e.high >= sl) THEN sl WHEN h.exit_no IS NOT NULL THEN tp END AS exit_price,
    row_number() OVER (PARTITION BY s.symbol, s.param_id ORDER BY s.n) AS k
    FROM s LEFT JOIN hit h USING (symbol, param_id, n) LEFT JOIN i e ON e.symbol = s.symbol AND e.n = h.exit_no),
  kr AS (SELECT symbol, param_id, k, true AS kept, coalesce(exit_no, 999999999) AS busy FROM kn WHERE k = 1 UNION ALL
    SELECT s.symbol, s.param_id, s.k, s.n >= r.busy, CASE WHEN s.n >= r.busy THEN coalesce(s.exit_no, 999999999) ELSE r.busy END
    FROM kr r JOIN kn s ON s.symbol = r.symbol AND s.param_id = r.param_id AND s.k = r.k + 1),
  a AS (SELECT symbol, param_id, count(*) AS trades, count(*) FILTER (sgn * (exit_price - close) > (close + exit_price) * 0.0001::DOUBLE) AS wins, sum(sgn * (exit_price - close) - (close + exit_price) * 0.0001::DOUBLE) AS net
    FROM kn JOIN kr USING (symbol, param_id, k) WHERE kept AND exit_price IS NOT NULL GROUP BY 1, 2)
  SELECT symbol, param_id, row_number() OVER (PARTITION BY symbol ORDER BY net DESC, param_id) AS rank, trades, wins, round(net, 4) + 0.0 AS net_profit
  FROM a QUALIFY rank <= 3""")
def sweep(spark, root):
    trades = sweep_trades(event_bars(spark, root, H1), PARAMS, CFG)
    return best_params(sweep_metrics(trades)).select(
        "symbol", "param_id", "rank", "trades", "wins", rounded("net_profit", 4).alias("net_profit"))
