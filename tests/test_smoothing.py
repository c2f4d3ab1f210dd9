import numpy as np
import pandas as pd
import pytest
from conftest import indexed, rows, walk
from pyspark.sql import functions as F

from candlewright.operators import studies as st
from candlewright.operators.smoothing import Smooth, smooth
from candlewright.operators.structure import add_supertrend


@pytest.fixture(scope="module")
def data():
    return walk("A", 300, seed=7), walk("B", 1, seed=8), walk("C", 45, seed=9)


@pytest.fixture(scope="module")
def bars(spark, data):
    return indexed(spark, *data)


@pytest.mark.parametrize("size", [4, 16, None])
def test_equals_the_recurrence(bars, data, size):
    specs = {"w": Smooth("close", 14), "e": Smooth("close", 3, "ema"), "slow": Smooth("close", 200, "ema"),
             "same": Smooth("close", 1), "signed": Smooth(F.col("close") - F.col("open"), 5)}
    got = rows(smooth(bars, specs, size))
    for pdf in data:
        mine = got[got["symbol"] == pdf["symbol"].iloc[0]].reset_index(drop=True)
        for name, x, alpha in (("w", pdf["close"], 1 / 14), ("e", pdf["close"], 0.5), ("slow", pdf["close"], 2 / 201),
                               ("same", pdf["close"], 1.0), ("signed", pdf["close"] - pdf["open"], 0.2)):
            want = x.ewm(alpha=alpha, adjust=False).mean()
            np.testing.assert_allclose(mine[name], want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("size", [4, None])
def test_mean_seed_and_late_start(bars, data, size):
    got = rows(smooth(bars, {"y": Smooth("close", 10, seed="sma", start=3)}, size))
    x = data[0]["close"].to_numpy()
    want = np.full(len(x), np.nan)
    want[12] = x[3:13].mean()
    for t in range(13, len(x)):
        want[t] = want[t - 1] * 0.9 + x[t] * 0.1
    mine = got[got["symbol"] == "A"]["y"].to_numpy()
    np.testing.assert_allclose(mine, want, rtol=1e-12)


@pytest.mark.parametrize("size", [4, 16, None])
def test_nulls_are_carried_as_pandas_does(spark, data, size):
    pdf = data[0].copy()
    rng = np.random.default_rng(4)
    pdf.loc[rng.random(len(pdf)) < 0.2, "close"] = np.nan
    pdf.loc[[0, 1, 15, 16, 31], "close"] = np.nan
    pdf.loc[40:75, "close"] = np.nan                        # whole blocks
    short = data[2].assign(close=np.where(np.arange(45) < 44, np.nan, 7.0))
    none = data[1].assign(close=np.nan)
    specs = {"w": Smooth("close", 14), "e": Smooth("close", 3, "ema"), "same": Smooth("close", 1), "late": Smooth("close", 5, start=4),
             "seeded": Smooth("close", 20, seed="sma")}
    got = rows(smooth(indexed(spark, pdf, short, none), specs, size))
    for frame_ in (pdf, short, none):
        x = frame_["close"].reset_index(drop=True)
        mine = got[got["symbol"] == frame_["symbol"].iloc[0]].reset_index(drop=True)
        seeded, valid = x.copy(), x.dropna()
        seeded[:] = np.nan
        if len(valid) >= 20:
            at = valid.index[19]
            seeded[at], seeded[at + 1:] = valid.iloc[:20].mean(), x[at + 1:]
        for name, series, alpha in (("w", x, 1 / 14), ("e", x, 0.5), ("same", x, 1.0), ("late", x.where(x.index >= 4), 0.2), ("seeded", seeded, 1 / 20)):
            np.testing.assert_allclose(mine[name], series.ewm(alpha=alpha, adjust=False).mean(), rtol=1e-11, err_msg=name)


def test_one_null_close_in_an_ema(spark, data):
    pdf = data[0].head(5).assign(close=[100, 101, np.nan, 102, 103])
    got = rows(st.run_studies(indexed(spark, pdf), st.ema(4), gates=False))["ema"]
    np.testing.assert_allclose(got, [100, 100.4, 100.4, 101.242105263, 101.945263158])


def test_supertrend_starts_at_the_first_seeded_atr(spark, data):
    got = rows(add_supertrend(indexed(spark, data[0]), 10, 3.0, seed="sma", block_rows=32))
    assert got["supertrend"].head(9).isna().all() and got["supertrend"].iloc[9:].notna().all()
    whole = rows(add_supertrend(indexed(spark, data[0]), 10, 3.0, seed="sma"))
    pd.testing.assert_frame_equal(got[["bar_no", "supertrend", "st_direction"]], whole[["bar_no", "supertrend", "st_direction"]])


def test_atr_counts_from_the_first_bar(bars, data):
    pdf = data[2]
    pc = pdf["close"].shift()
    tr = pd.concat([pdf["high"] - pdf["low"], (pdf["high"] - pc).abs(), (pdf["low"] - pc).abs()], axis=1).max(axis=1)
    got = rows(st.run_studies(bars, st.atr(14), gates=False, smooth_rows=8))
    np.testing.assert_allclose(got[got["symbol"] == "C"]["atr"], tr.ewm(alpha=1 / 14, adjust=False).mean(), rtol=1e-12)


def rsi_twin(close, n):
    delta = close.diff()
    up = delta.where(delta > 0, 0.0).ewm(alpha=1 / n, min_periods=n, adjust=False).mean()
    down = (-delta.where(delta < 0, 0.0)).ewm(alpha=1 / n, min_periods=n, adjust=False).mean()
    return (100 - 100 / (1 + up / down)).fillna(100)


def test_rsi(spark):
    flat, rising = walk("F", 30), walk("R", 30)
    flat["close"], rising["close"] = 5.0, np.arange(30.0)
    sine = walk("S", 200)
    sine["close"] = 100 + 10 * np.sin(np.arange(200) / 10)
    short = walk("T", 6)
    parts = [flat, rising, sine, short]
    got = rows(st.run_studies(indexed(spark, *parts), st.rsi(14), smooth_rows=16))
    for pdf in parts:
        mine = got[got["symbol"] == pdf["symbol"].iloc[0]].reset_index(drop=True)
        np.testing.assert_allclose(mine["rsi"], rsi_twin(pdf["close"], 14), rtol=1e-9)
    warm = got[got["bar_no"] < 13]
    assert not warm["rsi_long"].any() and warm["rsi_short"].all()


def test_symbols_do_not_touch_each_other(spark, data, bars):
    together = rows(st.run_studies(bars, st.keltner(), st.bollinger_width(), gates=False))
    alone = rows(st.run_studies(indexed(spark, data[2]), st.keltner(), st.bollinger_width(), gates=False))
    mine = together[together["symbol"] == "C"].reset_index(drop=True)
    for c in ("kc_upper", "kc_lower", "bbw", "bbw_ma"):
        pd.testing.assert_series_equal(mine[c], alone[c])


def test_studies_share_a_run(bars):
    many = [st.choppiness(), st.roc(), st.dpo(), st.cci(), st.local_angle(), st.volume(), st.adx(),
            st.macd_values(), st.macd_gate("strict")]
    together = rows(st.run_studies(bars, *many, block_rows=64))
    for study, column in ((many[0], "chop"), (many[2], "dpo"), (many[3], "cci"), (many[4], "angle"), (many[6], "adx")):
        alone = rows(st.run_studies(bars, study))
        np.testing.assert_allclose(together[column].to_numpy(float), alone[column].to_numpy(float), rtol=1e-9, atol=1e-9)


def test_weighted_averages(bars, data):
    def wma(x, n):
        w = np.arange(1, n + 1)
        return x.rolling(n).apply(lambda v: (v * w).sum() / w.sum(), raw=True)
    close = data[0]["close"]
    for kind, want in (("WMA", wma(close, 9)), ("HMA", wma(2 * wma(close, 4) - wma(close, 9), 3)), ("SMA", close.rolling(9).mean())):
        got = rows(st.run_studies(bars, st.moving_average(kind, 9), gates=False))
        np.testing.assert_allclose(got[got["symbol"] == "A"]["ma"], want, rtol=1e-9)


def test_vwap_without_volume_is_undecided(spark):
    pdf = walk(n=5)
    pdf["volume"] = 0.0
    got = rows(st.run_studies(indexed(spark, pdf), st.vwap()))
    assert got["vwap"].isna().all() and not got["vwap_long"].any()
