"""Supertrend and zig-zag structure: the two order-dependent indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.operators.chained import CHAIN_ROWS, run_chained
from candlewright.operators.studies import Study, atr, run_studies
from candlewright.session import stage


def _supertrend_kernel(rows, state):
    started, upper, lower, prev_close, falling = state
    lines, directions = [], []
    for base_up, base_low, close in zip(
            rows["st_up"].tolist(), rows["st_low"].tolist(), rows["close"].tolist()):
        if not started and base_up != base_up:
            lines.append(None)
            directions.append(None)
            continue
        if base_up != base_up or close != close:    # no bar to go by: the line stays
            pass
        elif not started:
            started, upper, lower, falling = 1.0, base_up, base_low, 1.0
        else:
            if base_up < upper or prev_close > upper:
                upper = base_up
            if base_low > lower or prev_close < lower:
                lower = base_low
            if falling:
                falling = 0.0 if close > upper else 1.0
            else:
                falling = 1.0 if close < lower else 0.0
        if close == close:
            prev_close = close
        lines.append(upper if falling else lower)
        directions.append(1 if falling else -1)
    return {"supertrend": lines, "st_direction": directions}, [started, upper, lower, prev_close, falling]


def add_supertrend(bars: DataFrame, n: int = 10, factor: float = 3.0, seed: str = "first",
                   block_rows: int = CHAIN_ROWS) -> DataFrame:
    """Trailing ATR band: one active line, direction 1 below it and -1 above it.

    It starts at the first bar with an ATR and is NULL before; a bar without prices keeps the line.

    Gates: long above the line, short below it.
    """
    mid = (F.col("high") + F.col("low")) / 2
    banded = run_studies(bars, atr(n, seed, "st_atr"), gates=False).withColumns({
        "st_up": mid + factor * F.col("st_atr"),
        "st_low": mid - factor * F.col("st_atr"),
    })
    out = run_chained(
        stage(banded, "bands"), _supertrend_kernel, [0.0] * 5,
        "supertrend double, st_direction int",
        inputs=("st_up", "st_low", "close"), block_rows=block_rows)
    return out.withColumns({
        "supt_long": F.coalesce(F.col("close") > F.col("supertrend"), F.lit(False)),
        "supt_short": F.coalesce(F.col("close") < F.col("supertrend"), F.lit(False)),
    })


def supertrend_bars_kernel(n: int, factor: float):
    """The supertrend rule from bars themselves: carries the range average and the close before; and its first state.

    A bar without a true range lets the average stand, and the next one weighs more the longer the gap was.
    """
    alpha = 1.0 / n

    def kernel(rows, state):
        *own, average, weight, close_before = state
        ups, lows = [], []
        for high, low, close in zip(rows["high"].tolist(), rows["low"].tolist(), rows["close"].tolist()):
            sizes = [x for x in (high - low, abs(high - close_before), abs(low - close_before)) if x == x]
            reach = max(sizes, default=float("nan"))
            weight *= 1 - alpha
            if reach == reach:
                average = reach if average != average else (weight * average + alpha * reach) / (weight + alpha)
                weight = 1.0
            close_before = close
            ups.append((high + low) / 2 + factor * average)
            lows.append((high + low) / 2 - factor * average)
        columns, own = _supertrend_kernel(rows.assign(st_up=ups, st_low=lows), own)
        return columns, [*own, average, weight, close_before]

    nan = float("nan")
    return kernel, [0.0] * 5 + [nan, 1.0, nan]


def zigzag_kernel(pct: float):
    share = pct / 100

    def kernel(rows, state):
        trend, high_leg, low_leg, last_high, last_low, bias = state
        trends, biases = [], []
        for high, low, close in zip(
                rows["high"].tolist(), rows["low"].tolist(), rows["close"].tolist()):
            threshold = close * share
            if trend == 0.0:
                trend, high_leg, low_leg = 1.0, high, low
            if trend == 1.0:
                if high > high_leg:
                    high_leg = high
                elif low < high_leg - threshold:
                    last_high, low_leg, trend = high_leg, low, -1.0
                    bias = _step(low, last_low)
            elif low < low_leg:
                low_leg = low
            elif high > low_leg + threshold:
                last_low, high_leg, trend = low_leg, high, 1.0
                bias = _step(high, last_high)
            trends.append(int(trend))
            biases.append(int(bias))
        return ({"zz_trend": trends, "zz_bias": biases},
                [trend, high_leg, low_leg, last_high, last_low, bias])

    return kernel


def _step(now: float, before: float) -> float:
    """Sign of the move against the last confirmed extreme, 0 while there is none."""
    if before <= 0 or now == before:
        return 0.0
    return 1.0 if now > before else -1.0


def add_zigzag(bars: DataFrame, pct: float = 0.2, block_rows: int = CHAIN_ROWS) -> DataFrame:
    """Percent-reversal legs: ``zz_trend`` and structure ``zz_bias`` in {1, 0, -1}."""
    return run_chained(
        bars, zigzag_kernel(pct), [0.0] * 6,
        "zz_trend int, zz_bias int", inputs=("high", "low", "close"), block_rows=block_rows)


def pivot_gate(bias: str = "zz_bias") -> Study:
    return Study("pivot", F.col(bias) == 1, F.col(bias) == -1)
