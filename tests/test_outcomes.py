import numpy as np
import pandas as pd
import pytest
from conftest import indexed, rows, walk
from pyspark.errors import PySparkException

from candlewright.operators import outcomes as oc
from candlewright.operators.structure import add_supertrend, add_zigzag
from candlewright.session import stage

SCHEMA = ("symbol string, bar_no long, ts_utc timestamp_ntz, signal string, close double, entry double, sl double, tp double")


def signals_for(pdf, width, every=3, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for no in range(0, len(pdf), every):
        side = 1 if rng.random() < 0.5 else -1
        c = pdf["close"].iloc[no]
        out.append((pdf["symbol"].iloc[0], no, pdf["ts_utc"].iloc[no], "BUY" if side > 0 else "SELL", c, c,
                    c - side * width, c + 2 * side * width))
    return pd.DataFrame(out, columns=["symbol", "bar_no", "ts_utc", "signal", "close", "entry", "sl", "tp"])


def brute_exit(pdf, s):
    lo, hi = min(s.sl, s.tp), max(s.sl, s.tp)
    for no in range(s.bar_no + 1, len(pdf)):
        low, high = pdf["low"].iloc[no], pdf["high"].iloc[no]
        if low <= lo or high >= hi:
            stop = low <= s.sl if s.signal == "BUY" else high >= s.sl
            return no, "sl" if stop else "tp"
    return None, "open"


@pytest.mark.parametrize("fanout, levels", [(4, 5), (6, None), (128, None), (512, None)])
def test_first_touch_equals_brute_force(spark, fanout, levels):
    parts = [walk(name, 400, seed=11) for name in "ABC"]
    sigs = [signals_for(pdf, width) for pdf, width in zip(parts, (0.5, 3.0, 12.0))]
    got = rows(oc.first_touch(spark.createDataFrame(pd.concat(sigs), SCHEMA), indexed(spark, *parts), fanout, levels))
    want = [brute_exit(pdf, s) for pdf, sig in zip(parts, sigs) for s in sig.itertuples()]
    assert [None if pd.isna(x) else int(x) for x in got["exit_no"]] == [w[0] for w in want]
    assert got["exit_reason"].tolist() == [w[1] for w in want]


def test_bar_reaching_both_counts_as_stopped_and_own_bar_is_skipped(spark):
    pdf = walk("A", 4)
    pdf[["high", "low"]] = [[200.0, 1.0], [101.0, 99.0], [200.0, 1.0], [101.0, 99.0]]
    sig = pd.DataFrame([("A", 0, pdf["ts_utc"][0], "BUY", 100.0, 100.0, 90.0, 120.0),
                        ("A", 3, pdf["ts_utc"][3], "SELL", 100.0, 100.0, 110.0, 80.0)],
                       columns=["symbol", "bar_no", "ts_utc", "signal", "close", "entry", "sl", "tp"])
    got = rows(oc.first_touch(spark.createDataFrame(sig, SCHEMA), indexed(spark, pdf)))
    assert got["exit_reason"].tolist() == ["sl", "open"] and got["exit_price"].iloc[0] == 90.0
    assert got["exit_no"].iloc[0] == 2


def test_too_long_a_series_is_an_error_not_a_wrong_answer(spark):
    pdf = walk("A", 70)
    with pytest.raises(PySparkException):
        oc.first_touch(spark.createDataFrame(signals_for(pdf, 1.0), SCHEMA), indexed(spark, pdf), 4, 3).collect()


def test_opposite_exit(spark):
    pdf = walk("A", 200, seed=4)
    sig = signals_for(pdf, 6.0, every=7, seed=2)
    df = spark.createDataFrame(sig, SCHEMA)
    got = rows(oc.close_on_opposite(oc.first_touch(oc.next_opposite(df), indexed(spark, pdf))))
    for s, g in zip(sig.itertuples(), got.itertuples()):
        hit, why = brute_exit(pdf, s)
        later = sig[(sig["bar_no"] > s.bar_no) & (sig["signal"] != s.signal)]["bar_no"]
        opp = later.min() if len(later) else None
        want = (opp, "opposite") if opp is not None and (hit is None or opp < hit) else (hit, why)
        assert (None if pd.isna(g.exit_no) else int(g.exit_no), g.exit_reason) == want


@pytest.mark.parametrize("block", [8, 64, 65_536])
def test_one_position_equals_a_walk(spark, block):
    pdf = walk("A", 600, seed=21)
    sig = signals_for(pdf, 4.0, every=2, seed=6)
    exits = oc.first_touch(spark.createDataFrame(sig, SCHEMA), indexed(spark, pdf))
    trades = stage(exits, "trades")
    got = rows(oc.one_position(trades, block_rows=block))
    busy, want = 0.0, []
    for no, leave in zip(got["bar_no"], got["exit_no"]):
        take = no >= busy
        want.append(take)
        if take:
            busy = float("inf") if pd.isna(leave) else leave
    assert got["kept"].tolist() == want and 1 < sum(want) < len(want)


def test_an_open_trade_blocks_the_rest_in_one_round(spark, monkeypatch):
    """A state that many blocks only hand on does not cost a round per block."""
    from candlewright.operators import chained
    pdf = walk("A", 400, seed=5)
    sig = signals_for(pdf, 3.0, every=2, seed=1)
    sig.loc[0, ["signal", "sl", "tp"]] = ["BUY", -1e9, 1e9]
    trades = stage(oc.first_touch(spark.createDataFrame(sig, SCHEMA), indexed(spark, pdf)), "trades")
    stages = []
    monkeypatch.setattr(chained, "stage", lambda df, name: (stages.append(name), stage(df, name))[1])
    got = rows(oc.one_position(trades, block_rows=16))
    assert got["kept"].tolist() == [True] + [False] * (len(got) - 1)
    assert stages.count("walked") == 1


def supertrend_twin(pdf, n, factor):
    pc = pdf["close"].shift()
    tr = pd.concat([pdf["high"] - pdf["low"], (pdf["high"] - pc).abs(), (pdf["low"] - pc).abs()], axis=1).max(axis=1)
    atr = tr.ewm(alpha=1 / n, adjust=False).mean()
    mid = (pdf["high"] + pdf["low"]) / 2
    up, low = (mid + factor * atr).tolist(), (mid - factor * atr).tolist()
    line, direction = [up[0]], [1]
    for t in range(1, len(pdf)):
        c, c1 = pdf["close"][t], pdf["close"][t - 1]
        up[t] = up[t] if up[t] < up[t - 1] or c1 > up[t - 1] else up[t - 1]
        low[t] = low[t] if low[t] > low[t - 1] or c1 < low[t - 1] else low[t - 1]
        d = direction[-1]
        d = (-1 if c > up[t] else 1) if d == 1 else (1 if c < low[t] else -1)
        direction.append(d)
        line.append(up[t] if d == 1 else low[t])
    return line, direction


@pytest.mark.parametrize("block", [10, 65_536])
def test_supertrend(spark, block):
    a, b = walk("A", 150, seed=3), walk("B", 35, seed=4)
    got = rows(add_supertrend(indexed(spark, a, b), 5, 1.5, block_rows=block))
    for pdf in (a, b):
        mine = got[got["symbol"] == pdf["symbol"].iloc[0]]
        line, direction = supertrend_twin(pdf, 5, 1.5)
        np.testing.assert_allclose(mine["supertrend"], line, rtol=1e-12)
        assert mine["st_direction"].tolist() == direction
    assert set(got["st_direction"]) == {1, -1}


def zigzag_twin(pdf, pct):
    trend, zh, zl, lh, ll, bias, out = 1, pdf["high"][0], pdf["low"][0], 0.0, 0.0, 0, []
    for h, l, c in zip(pdf["high"], pdf["low"], pdf["close"]):
        th = c * pct / 100
        if trend == 1:
            if h > zh:
                zh = h
            elif l < zh - th:
                lh, zl, trend = zh, l, -1
                bias = int(np.sign(zl - ll)) if ll > 0 else 0
        else:
            if l < zl:
                zl = l
            elif h > zl + th:
                ll, zh, trend = zl, h, 1
                bias = int(np.sign(zh - lh)) if lh > 0 else 0
        out.append((trend, bias))
    return out


@pytest.mark.parametrize("block", [7, 65_536])
def test_zigzag(spark, block):
    pdf = walk("A", 200, seed=13)
    got = rows(add_zigzag(indexed(spark, pdf), 2.0, block_rows=block))
    assert list(zip(got["zz_trend"], got["zz_bias"])) == zigzag_twin(pdf, 2.0)
    assert set(got["zz_bias"]) == {-1, 0, 1}


def trades(spark, data):
    schema = ("symbol string, bar_no long, signal string, entry double, exit_no long, exit_ts timestamp_ntz, "
              "exit_reason string, exit_price double")
    ts = pd.Timestamp("2024-01-01")
    return spark.createDataFrame(pd.DataFrame(
        [("A", no, side, entry, out, None if out is None else ts + pd.Timedelta(hours=out), why, price)
         for no, side, entry, out, why, price in data],
        columns=["symbol", "bar_no", "signal", "entry", "exit_no", "exit_ts", "exit_reason", "exit_price"]), schema)


BOOK = [(0, "BUY", 100.0, 5, "tp", 110.0), (6, "BUY", 100.0, 30, "sl", 95.0), (31, "SELL", 100.0, 33, "opposite", 90.0),
        (40, "BUY", 100.0, 70, "tp", 104.0), (71, "BUY", 100.0, None, "open", None)]


def test_performance_by_side(spark):
    df = oc.add_profit(trades(spark, BOOK), commission_pct=0.0)
    got = oc.performance(df).toPandas().set_index("side")
    assert got.loc["LONG", ["trades", "wins", "gross_profit", "gross_loss", "profit_factor", "avg_profit"]].tolist() == [3, 2, 14.0, 5.0, 2.8, 7.0]
    assert got.loc["SHORT", ["profit_factor", "avg_loss", "avg_factor", "win_rate"]].tolist() == [999.0, 0.0, 999.0, 100.0]
    assert got.loc["TOTAL", ["trades", "net_profit"]].tolist() == [4, 19.0]
    held = oc.durations(df).toPandas().set_index("side")
    assert held.loc["LONG"].tolist()[1:] == [(5 + 24 + 30) / 3, 17.5, 24.0]
    share = oc.opposite_share(df).toPandas().set_index("side")
    assert share.loc["TOTAL", ["opposite_closes", "opposite_pct"]].tolist() == [1, 25.0]


def test_no_wins_gives_no_average(spark):
    df = oc.add_profit(trades(spark, [BOOK[1]]))
    row = oc.performance(df).where("side = 'LONG'").first()
    assert row.avg_profit is None and row.profit_factor == 0.0 and row.avg_factor == 0.0


def test_equity_across_days(spark):
    df = stage(oc.add_profit(trades(spark, BOOK), commission_pct=0.0), "book")
    curve = oc.equity_curve(df, 1000.0, 50.0).toPandas().sort_values("exit_no")
    want = 1000 * np.cumprod([1.05, 0.975, 1.05, 1.02])
    np.testing.assert_allclose(curve["equity"], want)
    np.testing.assert_allclose(curve["drawdown"], np.maximum.accumulate(want) - want, atol=1e-9)


def test_ruin_is_final(spark):
    book = [(0, "BUY", 100.0, 1, "sl", -200.0), (2, "BUY", 100.0, 3, "tp", 400.0)]
    curve = oc.equity_curve(stage(oc.add_profit(trades(spark, book)), "book"), 1000.0, 50.0)
    assert curve.toPandas()["equity"].tolist() == [0.0, 0.0]
    assert oc.equity_summary(curve, 1000.0).first().max_drawdown == 1000.0
