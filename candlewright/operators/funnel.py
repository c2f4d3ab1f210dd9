"""Signal reports: distributions, funnel, distances, expectancy, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.columns import percent, ratio

STAGES = ["raw", "time", "rsi", "risk"]


def signal_analysis_columns() -> list[Column]:
    n, buy, sell = F.count(F.lit(1)), F.count_if("we_buy"), F.count_if("we_sell")
    return [
        n.alias("total_bars"),
        buy.alias("buy"), percent(buy, n).alias("buy_pct"),
        sell.alias("sell"), percent(sell, n).alias("sell_pct"),
        (buy + sell).alias("total"), percent(buy + sell, n).alias("total_pct"),
    ]


def run_statistics_columns() -> list[Column]:
    buy, sell = F.count_if("we_buy"), F.count_if("we_sell")
    return [
        F.count(F.lit(1)).alias("total_bars"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        buy.alias("buy"), sell.alias("sell"), (buy + sell).alias("total"),
    ]


def candle_distribution_columns() -> list[Column]:
    """Count and share of every candle type; shares are of classified bars."""
    kind, n, known = F.col("candle_type"), F.count(F.lit(1)), F.count("candle_type")
    columns = [n.alias("total_bars"), known.alias("classified"), (n - known).alias("unclassified"),
               percent(known, n).alias("classification_rate")]
    for name, code in (("inside", 1), ("up", 2), ("down", -2), ("outside", 3)):
        hits = F.count_if(kind == code)
        columns += [hits.alias(name), percent(hits, known).alias(f"{name}_pct")]
    return columns


def htf_distribution_columns() -> list[Column]:
    n, bull, bear = F.count(F.lit(1)), F.count_if("htf_bull"), F.count_if("htf_bear")
    columns = []
    for name, hits in (("bull", bull), ("bear", bear), ("neutral", n - bull - bear)):
        columns += [hits.alias(name), percent(hits, n).alias(f"{name}_pct")]
    return columns


def reversal_conversion_columns() -> list[Column]:
    columns = []
    for pattern, signal in (("rev_up", "we_buy"), ("rev_down", "we_sell")):
        found, used = F.count_if(pattern), F.count_if(signal)
        columns += [found.alias(f"{pattern}_count"), used.alias(f"{pattern}_converted"),
                    percent(used, found).alias(f"{pattern}_rate")]
    return columns


def signal_analysis(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(*signal_analysis_columns())


def run_statistics(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(*run_statistics_columns())


def candle_distribution(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(*candle_distribution_columns())


def htf_distribution(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(*htf_distribution_columns())


def reversal_conversion(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(*reversal_conversion_columns())


def sample_signals(df: DataFrame, n: int = 5, order: str = "ts_utc",
                   keys: tuple[str, ...] = ("symbol", "signal")) -> DataFrame:
    """First ``n`` rows of every signal kind; Spark limits each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.where(F.col("signal").isNotNull()).withColumn("sample_no", rank).where(F.col("sample_no") <= n)


def funnel_flags(df: DataFrame, session: Column, rsi_long: Column, rsi_short: Column) -> DataFrame:
    """Signal surviving each stage before pricing: ``sig_raw``, ``sig_time``, ``sig_rsi``."""
    raw = F.col("sig_raw")
    out = df.withColumn("sig_time", F.when(session, raw))
    passes = F.when(F.col("sig_time") == "BUY", rsi_long).when(F.col("sig_time") == "SELL", rsi_short)
    return out.withColumn("sig_rsi", F.when(F.coalesce(passes, F.lit(False)), F.col("sig_time")))


def flow_columns() -> list[Column]:
    """Signals of each side at each stage, and the adjusted ones."""
    columns = []
    for stage in STAGES:
        for side in ("BUY", "SELL"):
            columns.append(F.count_if(F.col(f"sig_{stage}") == side).alias(f"{stage}_{side.lower()}"))
    for side in ("BUY", "SELL"):
        columns.append(F.count_if(F.col("adjusted") & (F.col("sig_risk") == side)).alias(f"adj_{side.lower()}"))
    return columns


def flow_names() -> list[str]:
    return [f"{stage}_{side}" for stage in (*STAGES, "adj") for side in ("buy", "sell")]


def signal_funnel(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row per stage from one pass over the flags ``sig_<stage>`` and ``adjusted``."""
    return flow_rows(df.groupBy(*keys).agg(*flow_columns()), keys)


def flow_rows(wide: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows (step, stage, counts, shares) of counts named as ``flow_names`` has them."""
    entries = []
    for i, stage in enumerate(STAGES):
        before = STAGES[max(i - 1, 0)]
        buy, sell = F.col(f"{stage}_buy"), F.col(f"{stage}_sell")
        lost_buy, lost_sell = F.col(f"{before}_buy") - buy, F.col(f"{before}_sell") - sell
        was = F.col(f"{before}_buy") + F.col(f"{before}_sell")
        last = stage == STAGES[-1]
        raw = F.col("raw_buy") + F.col("raw_sell")
        entries.append(F.struct(
            F.lit(i + 1).alias("step"), F.lit(stage).alias("stage"),
            buy.alias("buy"), sell.alias("sell"), (buy + sell).alias("total"),
            lost_buy.alias("rejected_buy"), lost_sell.alias("rejected_sell"),
            (lost_buy + lost_sell).alias("rejected_total"),
            (F.col("adj_buy") if last else F.lit(0).cast("long")).alias("adjusted_buy"),
            (F.col("adj_sell") if last else F.lit(0).cast("long")).alias("adjusted_sell"),
            percent(lost_buy + lost_sell, was, 2).alias("rejection_pct"),
            percent(raw - buy - sell, raw, 2).alias("overall_rejection_pct"),
        ))
    return wide.select(*keys, F.inline(F.array(*entries)))


def distance_stats(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Trade counts and distances over the already rounded records."""
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(F.col("signal") == "BUY").alias("buy_trades"),
        F.count_if(F.col("signal") == "SELL").alias("sell_trades"),
        F.avg("sl_distance").alias("avg_sl_distance"),
        F.avg("tp_distance").alias("avg_tp_distance"),
        F.max("sl_distance").alias("max_sl_distance"),
        F.min("sl_distance").alias("min_sl_distance"),
    )


WIN_RATES = (0.30, 0.40, 0.50, 0.60)


def expectancy(stats: DataFrame, reward: float, win_rates=WIN_RATES,
               keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Expected result per assumed win rate, from :func:`distance_stats`."""
    rates = F.explode(F.array(*(F.lit(float(w)) for w in win_rates)))
    expected = F.col("win_rate") * reward - (1 - F.col("win_rate"))
    return stats.withColumn("win_rate", rates).select(
        *keys, "win_rate",
        F.bround(expected, 3).alias("expected_r"),
        F.bround(expected * F.col("avg_sl_distance"), 2).alias("expected_points"),
        F.bround(expected * F.col("total_trades"), 2).alias("total_r"),
        F.bround(ratio(F.lit(1.0), F.lit(1.0 + reward)), 3).alias("breakeven_win_rate"),
    )
