"""Candle types, reversals, higher-time-frame bias and the trigger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.columns import bucket_start
from candlewright.operators.blocks import lag, over_blocks

INSIDE, OUTSIDE, UP, DOWN = 1, 3, 2, -2


def candle_type() -> Column:
    """Type against the previous bar of an indexed series; NULL for the first bar."""
    h, l, ph, pl = F.col("high"), F.col("low"), F.col("prev_high"), F.col("prev_low")
    return (
        F.when((h <= ph) & (l >= pl), INSIDE)
        .when((h > ph) & (l < pl), OUTSIDE)
        .when((h > ph) & (l >= pl), UP)
        .when((l < pl) & (h <= ph), DOWN)
    )


def add_reversals(bars: DataFrame) -> DataFrame:
    """``candle_type`` and the two reversal flags; needs indexed bars."""
    before, now = lag("candle_type"), F.col("candle_type")
    return over_blocks(
        bars.withColumn("candle_type", candle_type()), 1,
        [{
            "rev_up": F.coalesce((before == DOWN) & (now == UP), F.lit(False)),
            "rev_down": F.coalesce((before == UP) & (now == DOWN), F.lit(False)),
        }],
    )


def add_bias(bars: DataFrame, htf_seconds: int) -> DataFrame:
    """Direction of each bar's own higher-time-frame bucket, its later bars included.

    A group holds the bars of one bucket, so its size is set by the two widths.
    """
    bucket = Window.partitionBy("symbol", "htf_ts")
    opened = F.min_by("open", "ts_utc").over(bucket)
    closed = F.max_by("close", "ts_utc").over(bucket)
    return (
        bars.withColumn("htf_ts", bucket_start("ts", htf_seconds))
        .withColumns({"htf_open": opened, "htf_close": closed})
        .withColumns({
            "htf_bull": F.coalesce(F.col("htf_close") > F.col("htf_open"), F.lit(False)),
            "htf_bear": F.coalesce(F.col("htf_close") < F.col("htf_open"), F.lit(False)),
        })
        .drop("htf_open", "htf_close")
    )


def add_trigger(bars: DataFrame, htf_seconds: int, lookahead: bool = True) -> DataFrame:
    """Reversal in the direction of the higher time frame: ``we_buy`` / ``we_sell``.

    ``lookahead=False`` uses the last completed bucket in place of the own one.
    """
    if lookahead:
        biased = add_bias(add_reversals(bars), htf_seconds)
    else:
        from candlewright.operators.htf import add_completed_bias
        biased = add_completed_bias(add_reversals(bars), htf_seconds)
    return biased.withColumns({
        "we_buy": F.col("rev_up") & F.col("htf_bull"),
        "we_sell": F.col("rev_down") & F.col("htf_bear"),
    })


def signal_label() -> Column:
    return F.when(F.col("we_sell"), "SELL").when(F.col("we_buy"), "BUY")
