"""Parameter sweep over the same bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.columns import minute_of_day
from candlewright.operators.outcomes import add_profit, first_touch, one_position, performance
from candlewright.operators.risk import RiskRules, price_signals
from candlewright.plans.strategy import Strategy, strategy_inputs
from candlewright.session import stage

DEFAULTS = {
    "sl_mult": 1.4, "reward": 2.0, "limit": 1.0, "overbought": 70.0, "oversold": 30.0,
    "session_start": 510.0, "session_end": 1230.0,
}
KEYS = ("symbol", "param_id")


def with_params(signals: DataFrame, params: Sequence[dict[str, float]]) -> DataFrame:
    """Each signal once per parameter set, numbered from 0 as ``param_id``."""
    unknown = {k for p in params for k in p} - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    sets = F.array(*(
        F.struct(F.lit(i).alias("param_id"),
                 *(F.lit(float({**DEFAULTS, **p}[k])).alias(k) for k in DEFAULTS))
        for i, p in enumerate(params)))
    return signals.select("*", F.inline(sets))


def sweep_trades(bars: DataFrame, params: Sequence[dict[str, float]], cfg: Strategy = Strategy()) -> DataFrame:
    """Priced, resolved and de-overlapped trades of every parameter set.

    Indicators and the trigger do not depend on the parameters and run once; only
    the bars with a signal are multiplied.
    """
    inputs = strategy_inputs(bars, cfg)
    signals = stage(inputs.where(F.col("sig_raw").isNotNull()).select(
        "symbol", "bar_no", "ts_utc", "ts", "close", "atr", "annual_range", "rsi", "sig_raw"), "signals")
    df = with_params(signals, params)
    minute = minute_of_day("ts")
    buy = F.col("sig_raw") == "BUY"
    passes = (
        (minute >= F.col("session_start")) & (minute < F.col("session_end"))
        & F.when(buy, F.col("rsi") < F.col("overbought")).otherwise(F.col("rsi") > F.col("oversold")))
    rules = RiskRules(sl_mult=F.col("sl_mult"), reward=F.col("reward"), limit=F.col("limit"),
                      limit_enabled=cfg.rules.limit_enabled, allow_exceed=cfg.rules.allow_exceed)
    priced = price_signals(df.where(passes).withColumn("signal", F.col("sig_raw")), rules)
    trades = first_touch(priced.where("approved"), bars)
    kept = one_position(stage(trades, "trades"), KEYS).where("kept")
    return add_profit(kept)


def sweep_metrics(trades: DataFrame) -> DataFrame:
    return performance(trades, KEYS)


def best_params(metrics: DataFrame, metric: str = "net_profit", k: int = 3) -> DataFrame:
    """Top ``k`` parameter sets per symbol by a metric of the totals."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(metric), "param_id"))
    return metrics.where(F.col("side") == "TOTAL").withColumn("rank", rank).where(F.col("rank") <= k)
