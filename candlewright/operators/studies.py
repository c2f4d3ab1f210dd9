"""Indicators and the gates built on them.

A :class:`Study` states what it needs: smoothed columns, columns smoothed from
those, running day columns, and windowed steps with a lookback. :func:`run_studies`
merges any number of them so that they share scans and shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.columns import as_col, ratio
from candlewright.operators.blocks import BLOCK_ROWS, frame, full, lag, over_blocks
from candlewright.operators.smoothing import Smooth, smooth

C = F.col


@dataclass(frozen=True)
class Study:
    name: str
    long: Column | None = None
    short: Column | None = None
    smooth: Mapping[str, Smooth] = field(default_factory=dict)
    nested: Mapping[str, Smooth] = field(default_factory=dict)
    daily: Mapping[str, Column] = field(default_factory=dict)
    lookback: int = 0
    steps: tuple[Mapping[str, Column], ...] = ()


def run_studies(bars: DataFrame, *studies: Study, gates: bool = True,
                block_rows: int = BLOCK_ROWS, smooth_rows: int | None = None) -> DataFrame:
    """Add all study columns, and ``<name>_long`` / ``<name>_short`` gates, to indexed bars."""
    first = {k: v for s in studies for k, v in s.smooth.items()}
    second = {k: v for s in studies for k, v in s.nested.items()}
    daily = {k: v for s in studies for k, v in s.daily.items()}
    depth = max((len(s.steps) for s in studies), default=0)
    steps = [
        {k: v for s in studies if i < len(s.steps) for k, v in s.steps[i].items()}
        for i in range(depth)
    ]
    out = smooth(bars, first, smooth_rows) if first else bars
    if second:
        # its totals need few columns, so no staging; a NULL first value counts as 0 in every nested input
        out = smooth(out, second, smooth_rows, gaps=False)
    if daily:
        out = out.withColumn("trade_date", F.to_date("ts")).withColumns(daily)
    if steps:
        out = over_blocks(out, max(s.lookback for s in studies), steps, block_rows)
    return study_gates(out, studies) if gates else out


def study_gates(df: DataFrame, studies: Sequence[Study]) -> DataFrame:
    """Add ``<name>_long`` and ``<name>_short`` of studies whose columns are there; undecided is false."""
    return df.withColumns({
        f"{s.name}_{side}": F.coalesce(gate, F.lit(False))
        for s in studies for side, gate in (("long", s.long), ("short", s.short))
        if gate is not None
    })


# --- values -----------------------------------------------------------------

def true_range() -> Column:
    h, l, pc = C("high"), C("low"), C("prev_close")
    return F.greatest(h - l, F.abs(h - pc), F.abs(l - pc))


def atr(n: int = 14, seed: str = "first", name: str = "atr") -> Study:
    return Study(name, smooth={name: Smooth(true_range(), n, seed=seed)})


def ema(n: int, x: Column | str = "close", seed: str = "first", name: str = "ema") -> Study:
    return Study(name, smooth={name: Smooth(x, n, "ema", seed)})


def sma_col(x: Column | str, n: int) -> Column:
    x = as_col(x)
    return full(x, F.avg(x).over(frame(n)), n)


def wma_col(x: Column | str, n: int) -> Column:
    """Weights 1..n, newest heaviest, from two framed sums."""
    x, no = as_col(x), C("_rel")
    weighted = F.sum(x * no).over(frame(n)) - (no - n) * F.sum(x).over(frame(n))
    return full(x, weighted / (n * (n + 1) / 2), n)


def row_in_block(block_rows: int = BLOCK_ROWS) -> Column:
    """Small row number for regressions and weights; negative on halo rows."""
    return (C("bar_no") - C("_blk") * block_rows).cast("double")


def rsi_value(n: int) -> Column:
    """RSI from the smoothed gain and loss: 100 in warm-up and when there was no loss."""
    gain, loss = C("avg_gain"), C("avg_loss")
    value = 100 - ratio(F.lit(100.0), 1 + ratio(gain, loss))
    return F.when(C("bar_no") < n - 1, 100.0).otherwise(F.coalesce(value, F.lit(100.0)))


def rsi(n: int = 14, overbought: float = 70, oversold: float = 30,
        enabled: bool = True, seed: str = "first", x: Column | str = "close") -> Study:
    if not enabled:
        return Study("rsi", F.lit(True), F.lit(True))
    delta = C("close") - C("prev_close") if x == "close" else as_col(x)
    return Study(
        "rsi", C("rsi") < overbought, C("rsi") > oversold,
        smooth={
            "avg_gain": Smooth(F.when(delta > 0, delta).otherwise(0.0), n, seed=seed),
            "avg_loss": Smooth(F.when(delta < 0, -delta).otherwise(0.0), n, seed=seed),
        },
        steps=({"rsi": rsi_value(n)},),
    )


# --- gates ------------------------------------------------------------------

def macd_values(fast: int = 12, slow: int = 26, signal: int = 9, seed: str = "first") -> Study:
    line = C("macd_fast") - C("macd_slow")
    start = slow - 1 if seed == "sma" else 0
    return Study(
        "macd_values",
        smooth={"macd_fast": Smooth("close", fast, "ema", seed),
                "macd_slow": Smooth("close", slow, "ema", seed)},
        nested={"macd_signal": Smooth(F.coalesce(line, F.lit(0.0)), signal, "ema", seed, start)},
        steps=({"macd_hist": line - C("macd_signal")},),
    )


def macd_gate(mode: str = "classic", slope: int = 3, norm: int = 50, hist: str = "macd_hist") -> Study:
    """Gate on the histogram column; slope is in chart bars, also for attached HTF values."""
    h = C(hist)
    up, down = h > 0, h < 0
    rising, falling = C("macd_slope") > 0, C("macd_slope") < 0
    sides = {"classic": (up, down), "slope": (rising, falling),
             "strict": (up & rising, down & falling)}
    if mode not in sides:
        raise ValueError(f"unknown MACD mode {mode!r}")
    sigma = full(h, F.stddev_pop(h).over(frame(norm)), norm)
    return Study("macd", *sides[mode], lookback=max(slope, norm - 1),
                 steps=({}, {"macd_slope": ratio(h - lag(h, slope), sigma)}))


def moving_average(kind: str, n: int, seed: str = "first") -> Study:
    """Column ``ma`` of the given kind: SMA, EMA, WMA or HMA."""
    rel = {"_rel": row_in_block()}
    if kind == "EMA":
        return ema(n, seed=seed, name="ma")
    if kind == "SMA":
        return Study("ma", lookback=n - 1, steps=({"ma": sma_col("close", n)},))
    if kind == "WMA":
        return Study("ma", lookback=n - 1, steps=(rel, {"ma": wma_col("close", n)}))
    if kind == "HMA":
        half, root = max(1, n // 2), max(1, int(n ** 0.5))
        raw = 2 * wma_col("close", half) - wma_col("close", n)
        return Study("ma", lookback=n + root - 2,
                     steps=(rel, {"ma_raw": raw}, {"ma": wma_col("ma_raw", root)}))
    raise ValueError(f"unknown moving average {kind!r}")


def ma_slope_gate(slope: int = 10, ma: str = "ma", base: Study | None = None) -> Study:
    """Moving average against its value ``slope`` chart bars ago."""
    steps = (*(base.steps if base else ()), {"ma_before": lag(ma, slope)})
    return Study("ma_slope", C(ma) > C("ma_before"), C(ma) < C("ma_before"),
                 smooth=base.smooth if base else {},
                 lookback=slope + (base.lookback if base else 0), steps=steps)


def vwap(buffer_pct: float = 0.0) -> Study:
    """Day-anchored volume-weighted price with a percentage buffer either side."""
    day = (Window.partitionBy("symbol", "trade_date").orderBy("bar_no")
           .rowsBetween(Window.unboundedPreceding, 0))
    typical = (C("high") + C("low") + C("close")) / 3
    value = ratio(F.sum(typical * C("volume")).over(day), F.sum("volume").over(day))
    return Study("vwap",
                 C("close") > C("vwap") * (1 + buffer_pct / 100),
                 C("close") < C("vwap") * (1 - buffer_pct / 100),
                 daily={"vwap": value})


def choppiness(n: int = 14, threshold: float = 61.8) -> Study:
    span = F.max("high").over(frame(n)) - F.min("low").over(frame(n))
    moved = F.sum(true_range()).over(frame(n))
    index = F.when(span > 0, 100 * F.log10(ratio(moved, span)) / F.log10(F.lit(float(n)))).otherwise(100.0)
    gate = C("chop") < threshold
    return Study("chop", gate, gate, lookback=n - 1,
                 steps=({"chop": full(C("close"), index, n)},))


def adx(di: int = 10, n: int = 14, threshold: float = 18.0, seed: str = "first") -> Study:
    up, down = C("high") - C("prev_high"), C("prev_low") - C("low")
    plus = F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0))
    minus = F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0))
    spread = ratio(F.abs(C("dm_plus") - C("dm_minus")), C("dm_plus") + C("dm_minus"))
    gate = C("adx") > threshold
    return Study(
        "adx", gate, gate,
        smooth={"dm_plus": Smooth(plus, di, seed=seed), "dm_minus": Smooth(minus, di, seed=seed),
                "tr_smooth": Smooth(true_range(), di, seed=seed)},
        nested={"adx": Smooth(100 * F.coalesce(spread, F.lit(0.0)), n, seed=seed,
                              start=di - 1 if seed == "sma" else 0)},
        steps=({"di_plus": 100 * ratio(C("dm_plus"), C("tr_smooth")),
                "di_minus": 100 * ratio(C("dm_minus"), C("tr_smooth"))},),
    )


def roc(n: int = 14, threshold: float = 0.1) -> Study:
    before = lag("close", n)
    return Study("roc", C("roc") > threshold, C("roc") < -threshold, lookback=n,
                 steps=({"roc": ratio(C("close") - before, before) * 100},))


def volume(ma: int = 20, atr_len: int = 14, seed: str = "first") -> Study:
    gate = C("vol_norm") > C("vol_norm_ma")
    return Study(
        "vol", gate, gate, lookback=ma - 1,
        smooth={"vol_atr": Smooth(true_range(), atr_len, seed=seed)},
        steps=({"vol_norm": C("volume") / F.greatest(C("vol_atr"), F.lit(1e-10))},
               {"vol_norm_ma": sma_col("vol_norm", ma)}),
    )


def bollinger_width(n: int = 14, ma: int = 30, mult: float = 0.5, sigmas: float = 2.0) -> Study:
    close = C("close")
    basis, sigma = F.avg(close).over(frame(n)), F.stddev_pop(close).over(frame(n))
    gate = C("bbw") > C("bbw_ma") * mult
    return Study("bbw", gate, gate, lookback=n + ma - 2, steps=(
        {"bbw": full(close, ratio(2 * sigmas * sigma, basis), n)},
        {"bbw_ma": sma_col("bbw", ma)},
    ))


def keltner(n: int = 20, mult: float = 1.5, atr_len: int = 10, seed: str = "first") -> Study:
    return Study(
        "kc", C("close") < C("kc_upper"), C("close") > C("kc_lower"),
        smooth={"kc_basis": Smooth("close", n, "ema", seed),
                "kc_atr": Smooth(true_range(), atr_len, seed=seed)},
        steps=({"kc_upper": C("kc_basis") + C("kc_atr") * mult,
                "kc_lower": C("kc_basis") - C("kc_atr") * mult},),
    )


def dpo(n: int = 20, smoothing: int = 3, threshold: float = 0.2) -> Study:
    value = C("dpo")
    return Study("dpo", (value < 0) & (value > -threshold), (value > 0) & (value < threshold),
                 lookback=n + smoothing - 2, steps=(
        {"dpo_raw": C("close") - sma_col("close", n)},
        {"dpo": ratio(sma_col("dpo_raw", smoothing), C("close")) * 100},
    ))


def cci(n: int = 20, overbought: float = 100, oversold: float = -100) -> Study:
    close = C("close")
    mean = C("cci_mean")
    spread = F.aggregate(C("cci_window"), F.lit(0.0), lambda acc, x: acc + F.abs(x - mean)) / n
    value = ratio(close - mean, 0.015 * spread)
    return Study("cci", C("cci") < overbought, C("cci") > oversold, lookback=n - 1, steps=(
        {"cci_mean": sma_col(close, n), "cci_window": F.collect_list(close).over(frame(n))},
        {"cci": value},
        {"cci_window": F.lit(None).cast("array<double>")},
    ))


def local_angle(n: int = 10, minimum: float = 0.15) -> Study:
    close, x = C("close"), C("_rel")
    at_end = F.regr_intercept(close, x).over(frame(n)) + F.regr_slope(close, x).over(frame(n)) * x
    sigma = F.stddev_pop(close).over(frame(n))
    turn = ratio(C("linreg") - lag("linreg", n),
                 F.greatest(C("angle_sigma"), close * 0.0001))
    return Study("angle", C("angle") > minimum, C("angle") < -minimum, lookback=2 * n - 1, steps=(
        {"_rel": row_in_block()},
        {"linreg": full(close, at_end, n), "angle_sigma": full(close, sigma, n)},
        {"angle": F.atan(turn)},
    ))


def edge_trigger(first: Column | str, second: Column | str | None = None, name: str = "edge") -> Study:
    """Fires when a source turns positive after being exactly zero."""
    fires = F.lit(False)
    for source in (first, second):
        if source is not None:
            x = as_col(source)
            fires = fires | F.coalesce((x > 0) & (lag(x) == 0), F.lit(False))
    return Study(name, lookback=1, steps=({name: fires},))
