"""Stored bars, sinks and run outputs, written and read back."""

import uuid

from pyspark.sql import functions as F

from candlewright.catalog.base import (
    H1, M15, bars_sql, event_bars, gate_sql, query, r6, show, smooth_sql)
from candlewright.catalog.data import BAR
from candlewright.catalog.indicators import I15, KEY, R1H, sma_sql
from candlewright.catalog.strategy import CLAMP, REJECT, funnel_sql, strategy_sql
from candlewright.operators import studies as st
from candlewright.operators.blocks import index_bars
from candlewright.operators.resumed import carry_of, resume_studies
from candlewright.operators.studies import run_studies
from candlewright.operators.summaries import describe_days, rank_error, store_summaries, stored_summaries
from candlewright.plans.outputs import read_output, run_funnel, write_run
from candlewright.plans.strategy import run_strategy
from candlewright.schema import BARS, OHLCV
from candlewright.session import stage, staging_root
from candlewright.sources import bars as sinks
from candlewright.sources.block_store import store_blocks, studies_on_blocks


def _folder(spark, name):
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


_SOME = "symbol IN ('click', 'view') AND ts >= '2024-01-05' AND ts < '2024-01-12'"


@query("bar_store_scan", bars_sql(M15) + f" SELECT symbol, ts AS ts_utc, open, high, low, close, volume FROM b WHERE {_SOME} AND close > 100")
def bar_store_scan(spark, root):
    """Stored by day; a week of two symbols is read back."""
    path = _folder(spark, "bars-by-day")
    sinks.write_bars(event_bars(spark, root), path)
    days = F.col("trade_date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-11").cast("date"))
    return sinks.read_bars(spark, path).where(days & F.col("symbol").isin("click", "view") & (F.col("close") > 100)).select(*BAR)


@query("bar_csv_scan", bars_sql(M15) + """ SELECT symbol, ts AS ts_utc, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low,
  round(close, 6) AS close, round(volume, 6) AS volume FROM b WHERE symbol <> 'error'""")
def bar_csv_scan(spark, root):
    """Six decimals in CSV, a folder for each symbol; one of them is not read back."""
    path = _folder(spark, "bars-csv")
    sinks.write_bars(event_bars(spark, root), path, "csv")
    return sinks.read_bars_csv_folder(spark, path).where("symbol <> 'error'").select(*BAR)


@query("block_store_studies", I15 + f""", m AS (SELECT *, {sma_sql('close', 16)} AS ma, (close - lag(close, 14) OVER w) / nullif(lag(close, 14) OVER w, 0) * 100 AS roc FROM i
  WINDOW w AS (PARTITION BY symbol ORDER BY n)), k AS (SELECT *, lag(ma, 10) OVER (PARTITION BY symbol ORDER BY n) AS mb FROM m)
  SELECT {KEY} {r6('roc', 'roc')}, {gate_sql('ma > mb AND roc > 0.1::DOUBLE', 'ma < mb AND roc < -0.1::DOUBLE')} FROM k WHERE symbol <> 'error' AND ts >= '2024-01-10'""")
def block_store_studies(spark, root):
    """Indicators of stored blocks: no exchange, some symbols, and only bars from a day on."""
    bars = event_bars(spark, root)
    name = f"blocks_{uuid.uuid4().hex}"
    store_blocks(bars, name, _folder(spark, "blocks"), 64, 8)
    symbols = [r.symbol for r in bars.where("symbol <> 'error'").select("symbol").distinct().collect()]
    chosen = [st.ma_slope_gate(10, base=st.moving_average("SMA", 16)), st.roc()]
    df = studies_on_blocks(spark, name, *chosen, symbols=symbols, start="2024-01-10 00:00:00")
    both = {side: F.col(f"{chosen[0].name}_{side}") & F.col(f"{chosen[1].name}_{side}") for side in ("long", "short")}
    return show(df, "symbol", "ts_utc", *(c.alias(k) for k, c in both.items()), roc="roc")


_DAYS = "ts >= '2024-01-05' AND ts < '2024-01-21'"


@query("dq_summaries", bars_sql(M15) + f""", v AS (UNPIVOT (SELECT symbol, ts, open, high, low, close, volume FROM b WHERE {_DAYS}) ON open, high, low, close, volume INTO NAME "column" VALUE value)
  SELECT symbol, "column", count(*) AS count, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std, min(value) AS min, max(value) AS max,
  true AS p25_near, true AS p50_near, true AS p75_near FROM v GROUP BY 1, 2""")
def dq_summaries(spark, root):
    """Sixteen days from stored summaries, which came in two parts; are the quartiles as near the wanted ranks as stated?"""
    bars, path = event_bars(spark, root), _folder(spark, "summaries")
    late = F.dayofmonth("ts_utc") % 3 == 0
    store_summaries(bars.where(~late), path)
    store_summaries(bars.where(late), path)
    days = F.col("trade_date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))
    got = describe_days(stored_summaries(spark, path).where(days))
    values = bars.where(F.to_date("ts_utc").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"))).select(
        "symbol", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in OHLCV))))
    quartiles = got.select("symbol", "column", *(F.col(p).alias(f"_{p}") for p in ("p25", "p50", "p75")))
    n, near = F.count(F.lit(1)), {}
    for p, share in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        below, upto = F.count_if(F.col("value") < F.col(f"_{p}")), F.count_if(F.col("value") <= F.col(f"_{p}"))
        near[f"{p}_near"] = (below <= (share + rank_error()) * n) & (upto >= (share - rank_error()) * n)
    ranks = values.join(quartiles, ["symbol", "column"]).groupBy("symbol", "column").agg(*(c.alias(k) for k, c in near.items()))
    return show(got.join(ranks, ["symbol", "column"]), "symbol", "column", "count", "min", "max", *near, mean="mean", std="std")


_CARRIED = {"atr": ("tr", 1 / 14), "ema": ("close", 2 / 21), "g": ("greatest(coalesce(close - pc, 0), 0)", 1 / 14),
            "l": ("greatest(coalesce(pc - close, 0), 0)", 1 / 14)}


@query("resumed_studies", f"""{R1H}, {smooth_sql('r', 'i', _CARRIED)} SELECT i.symbol, i.ts AS ts_utc, i.n AS bar_no, {r6('r.atr', 'atr')}, {r6('r.ema', 'ema')},
  {r6('CASE WHEN i.n < 13 OR r.l = 0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE - 100.0::DOUBLE / (1 + r.g / r.l) END', 'rsi')}
  FROM i JOIN r USING (symbol, n) WHERE i.ts >= '2024-01-20'""")
def resumed_studies(spark, root):
    """Two parts carried on from the bars before the 20th; only their own bars are read."""
    bars, chosen = event_bars(spark, root, H1), (st.atr(14), st.ema(20), st.rsi(14))
    day = F.dayofmonth("ts_utc")
    plain = bars.select(*BARS.fieldNames())
    history = run_studies(index_bars(stage(plain.where(day < 20), "history")), *chosen)
    first = resume_studies(plain.where(day.between(20, 25)), stage(carry_of(history, *chosen), "carry"), *chosen)
    second = resume_studies(plain.where(day > 25), stage(first.carry, "carry"), *chosen)
    return show(first.bars.unionByName(second.bars), "symbol", "ts_utc", "bar_no", atr="atr", ema="ema", rsi="rsi")


def _written(spark, root, cfg):
    base = _folder(spark, "outputs")
    return base, write_run(run_strategy(event_bars(spark, root, H1), cfg), cfg, base)


@query("signal_sink", strategy_sql() + " SELECT symbol, ts, open, high, low, close, volume, candle_type::BIGINT AS candle_type, we_buy, we_sell FROM f WHERE sig IS NOT NULL")
def signal_sink(spark, root):
    got = read_output(spark, *_written(spark, root, CLAMP), "signals")
    return got.withColumn("candle_type", F.col("candle_type").cast("long"))


@query("trade_sink", strategy_sql() + """ SELECT symbol, ts, sig_risk AS signal, round_even(close, 2) AS entry, round_even(sl, 2) AS sl,
  round_even(tp, 2) AS tp, round_even(abs(close - sl), 2) AS sl_distance, round_even(abs(close - tp), 2) AS tp_distance FROM f WHERE approved""")
def trade_sink(spark, root):
    return read_output(spark, *_written(spark, root, CLAMP), "trades").drop("comment")


_FLOW = "step, stage, buy, sell, total, rejected_buy, rejected_sell, rejected_total, adjusted_buy, adjusted_sell, rejection_pct, overall_rejection_pct"


@query("report_sink", f"{strategy_sql(allow=False)}, w AS ({funnel_sql()}) SELECT symbol, {_FLOW} FROM w")
def report_sink(spark, root):
    """The signal flow in the reports of a run."""
    report = read_output(spark, *_written(spark, root, REJECT), "report")
    return report.select("symbol", F.inline("signal_flow")).select("symbol", *_FLOW.split(", "))


@query("run_funnel", f"{strategy_sql(allow=False).replace('f AS MATERIALIZED', 'f9 AS MATERIALIZED')}, f AS (SELECT 1 AS symbol, * EXCLUDE (symbol) FROM f9), w AS ({funnel_sql()}) SELECT {_FLOW} FROM w")
def whole_run_funnel(spark, root):
    """The signal flow over all symbols, counted while the outputs were written."""
    return run_funnel(spark, *_written(spark, root, REJECT))
