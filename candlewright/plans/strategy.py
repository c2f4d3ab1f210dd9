"""The whole strategy: indicators, trigger, filters, pricing, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.operators import funnel
from candlewright.operators.blocks import index_bars
from candlewright.operators.candles import add_trigger, signal_label
from candlewright.operators.risk import (
    RiskRules, add_annual_range, add_monthly_range, price_signals, trade_records)
from candlewright.operators.sessions import Session, between, in_session
from candlewright.operators.studies import atr, rsi, run_studies
from candlewright.session import stage


@dataclass(frozen=True)
class Strategy:
    """Parameters of one run; the defaults are the usual ones of the trigger strategy."""

    htf_seconds: int = 3600
    start: str | None = None
    end: str | None = None
    session: Session = field(default_factory=Session)
    rsi_length: int = 14
    overbought: float = 70
    oversold: float = 30
    rsi_enabled: bool = True
    atr_length: int = 14
    rules: RiskRules = field(default_factory=RiskRules)
    lookahead: bool = True
    range_months: int | None = None


def strategy_inputs(bars: DataFrame, cfg: Strategy) -> DataFrame:
    """Stored, indexed bars with ATR, range, RSI and trigger columns.

    ATR and range see the full history. Trigger and RSI start anew at the date
    slice, which is therefore stored and numbered again.
    """
    def with_range(df: DataFrame) -> DataFrame:
        if cfg.range_months:
            return add_monthly_range(df, cfg.range_months)
        return add_annual_range(df)

    atr_study = atr(cfg.atr_length)
    rsi_study = rsi(cfg.rsi_length, cfg.overbought, cfg.oversold, cfg.rsi_enabled)
    if cfg.start is None and cfg.end is None:
        df = with_range(run_studies(bars, atr_study, rsi_study))
    else:
        full = with_range(run_studies(bars, atr_study))
        cut = full.where(between(cfg.start or "0001-01-01", cfg.end or "9999-12-31"))
        df = run_studies(index_bars(stage(cut, "slice")), rsi_study)
    return add_trigger(df, cfg.htf_seconds, cfg.lookahead).withColumn("sig_raw", signal_label())


def run_strategy(bars: DataFrame, cfg: Strategy) -> DataFrame:
    """Every bar with its signal at each stage (``sig_raw`` to ``sig_risk``) and its pricing."""
    df = strategy_inputs(bars, cfg)
    flagged = funnel.funnel_flags(df, in_session(cfg.session), F.col("rsi_long"), F.col("rsi_short"))
    priced = price_signals(flagged, cfg.rules, "sig_rsi")
    return priced.withColumn("sig_risk", F.when(F.col("approved"), F.col("sig_rsi")))


def trades_of(frame: DataFrame, *keep: str) -> DataFrame:
    return trade_records(frame.withColumn("signal", F.col("sig_risk")), *keep)


def strategy_report(frame: DataFrame, cfg: Strategy, samples: int = 10) -> DataFrame:
    """One nested row per symbol: settings, signal flow, distances, expectancy, samples."""
    frame = stage(frame, "strategy")
    trades = trades_of(frame, "ts_utc")
    stats = funnel.distance_stats(trades)
    flow = funnel.signal_funnel(frame)
    steps = [c for c in flow.columns if c not in ("symbol", "step")]
    flow = flow.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("step", *steps))).alias("signal_flow"))
    expected = funnel.expectancy(stats, cfg.rules.reward)
    scenario = [c for c in expected.columns if c != "symbol"]
    expected = expected.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct(*scenario))).alias("theoretical_scenarios"))
    numbers = [c for c in stats.columns if c != "symbol"]
    stats = stats.select("symbol", F.struct(*(
        F.bround(c, 2).alias(c) if c.endswith("distance") else F.col(c) for c in numbers
    )).alias("performance"))
    picked = funnel.sample_signals(trades, samples)
    row = F.struct("sample_no", *[c for c in trades.columns if c != "symbol"])
    picked = picked.groupBy("symbol").agg(*(
        F.sort_array(F.collect_list(F.when(F.col("signal") == side, row))).alias(name)
        for side, name in (("BUY", "buy_samples"), ("SELL", "sell_samples"))))
    rules = cfg.rules
    settings = F.struct(
        F.lit(cfg.htf_seconds).alias("htf_seconds"),
        F.lit(cfg.start).alias("start"), F.lit(cfg.end).alias("end"),
        F.lit(f"{cfg.session.start_text}-{cfg.session.end_text}" if cfg.session.enabled else None).alias("session"),
        F.lit(cfg.rsi_length).alias("rsi_length"),
        F.lit(cfg.atr_length).alias("atr_length"),
        F.lit(float(rules.sl_mult)).alias("sl_multiplier"),
        F.lit(float(rules.reward)).alias("risk_to_reward"),
        F.lit(float(rules.limit)).alias("max_risk_percentile"),
        F.lit(rules.allow_exceed).alias("allow_exceed_limit"),
    )
    out = flow
    for part in (stats, expected, picked):
        out = out.join(part, "symbol", "left")
    return out.withColumn("settings", settings)


def indicator_report(bars: DataFrame, samples: int = 5) -> DataFrame:
    """One nested row per symbol on the trigger alone; ``bars`` carry the trigger columns."""
    bars = stage(bars, "trigger")
    parts = {
        "execution": funnel.run_statistics_columns(),
        "signal_analysis": funnel.signal_analysis_columns(),
        "candle_distribution": funnel.candle_distribution_columns(),
        "htf_analysis": funnel.htf_distribution_columns(),
        "reversal_patterns": funnel.reversal_conversion_columns(),
    }
    out = bars.groupBy("symbol").agg(*(F.struct(*columns).alias(name) for name, columns in parts.items()))
    rows = funnel.sample_signals(bars.withColumn("signal", signal_label()), samples)
    row = F.struct("signal", "sample_no", "ts", "open", "high", "low", "close", "volume", "candle_type")
    picked = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(row)).alias("sample_signals"))
    return out.join(picked, "symbol", "left")
