import numpy as np
import pytest
from conftest import indexed, rows, walk
from test_smoothing import rsi_twin

from candlewright.functions.text import alert_text
from candlewright.operators import outcomes as oc
from candlewright.operators.funnel import expectancy, signal_funnel
from candlewright.operators.risk import RiskRules
from candlewright.operators.sessions import Session
from candlewright.plans.strategy import Strategy, run_strategy
from candlewright.plans.sweep import best_params, sweep_metrics, sweep_trades, with_params
from candlewright.session import stage


@pytest.fixture(scope="module")
def bars(spark):
    return indexed(spark, walk("A", 24 * 60, seed=31), walk("B", 24 * 45, seed=32))


def test_slice_restarts_trigger_and_rsi_but_not_atr(bars):
    cfg = Strategy(htf_seconds=14400)
    cut = Strategy(htf_seconds=14400, start="2024-01-20 05:00:00", end="2024-02-10 16:00:00")
    full = rows(run_strategy(bars, cfg), "symbol", "ts_utc")
    part = rows(run_strategy(bars, cut), "symbol", "ts_utc")
    same = full[(full["ts"] >= "2024-01-20 05:00:00") & (full["ts"] <= "2024-02-10 16:00:00")].reset_index(drop=True)
    np.testing.assert_allclose(part["atr"], same["atr"], rtol=1e-12)
    np.testing.assert_array_equal(part["annual_range"], same["annual_range"])
    for symbol in ("A", "B"):
        mine = part[part["symbol"] == symbol].reset_index(drop=True)
        assert mine["bar_no"].tolist() == list(range(len(mine)))
        assert mine["candle_type"].isna().tolist() == [True] + [False] * (len(mine) - 1)
        np.testing.assert_allclose(mine["rsi"], rsi_twin(mine["close"], 14), rtol=1e-9)


def test_funnel_adds_up(bars):
    cfg = Strategy(htf_seconds=14400, session=Session.at("06:00", "18:00"), rules=RiskRules(limit=0.05))
    frame = rows(run_strategy(bars, cfg), "symbol", "ts_utc")
    got = rows(signal_funnel(run_strategy(bars, cfg)), "symbol", "step")
    for symbol, part in frame.groupby("symbol"):
        mine = got[got["symbol"] == symbol].set_index("stage")
        for name in ("raw", "time", "rsi", "risk"):
            assert mine.loc[name, "total"] == part[f"sig_{name}"].notna().sum()
            assert mine.loc[name, "buy"] == (part[f"sig_{name}"] == "BUY").sum()
        assert mine.loc["risk", "rejected_total"] == mine.loc["rsi", "total"] - mine.loc["risk", "total"] > 0


def test_disabled_rsi_lets_all_through(bars):
    frame = rows(run_strategy(bars, Strategy(htf_seconds=14400, rsi_enabled=False)), "symbol", "ts_utc")
    assert frame["sig_time"].equals(frame["sig_rsi"])


def test_expectancy(spark):
    stats = spark.createDataFrame([("A", 10, 20.0)], "symbol string, total_trades long, avg_sl_distance double")
    row = expectancy(stats, 2.0).where("win_rate = 0.4").first()
    assert (row.expected_r, row.expected_points, row.total_r, row.breakeven_win_rate) == (0.2, 4.0, 2.0, 0.333)


def test_alert(spark):
    df = spark.sql("SELECT 'EURUSD' symbol, timestamp_ntz'2024-03-01 09:05:00' ts, 'BUY' signal, 1.5D entry, 1.25D sl, 2.0D tp, 1.5D flat")
    text = df.select(alert_text()).first()[0]
    assert "BUY SIGNAL\nSymbol: EURUSD\nEntry Price: 1.5\nStop Loss: 1.25\nTake Profit: 2\nRR Ratio: 1:2\nTime: 01/03/2024 09:05" in text
    assert "RR Ratio: 1:0\n" in df.select(alert_text(sl="flat")).first()[0]


def test_sweep_equals_single_runs(bars):
    params = [{"sl_mult": 1.0, "reward": 1.5}, {"sl_mult": 2.0, "overbought": 60.0, "limit": 0.2}]
    metrics = rows(sweep_metrics(sweep_trades(bars, params, Strategy(htf_seconds=14400))), "symbol", "param_id", "side")
    for i, p in enumerate(params):
        cfg = Strategy(htf_seconds=14400, overbought=p.get("overbought", 70),
                       rules=RiskRules(p["sl_mult"], p.get("reward", 2.0), limit=p.get("limit", 1.0)))
        sig = run_strategy(bars, cfg).where("approved").withColumnRenamed("sig_risk", "signal")
        kept = oc.one_position(stage(oc.first_touch(sig, bars), "one")).where("kept")
        single = rows(oc.performance(oc.add_profit(kept)), "symbol", "side")
        mine = metrics[metrics["param_id"] == i].drop(columns="param_id").reset_index(drop=True)
        assert mine["trades"].tolist() == single["trades"].tolist() and len(mine) == 6
        np.testing.assert_allclose(mine["net_profit"], single["net_profit"], atol=1e-9)


def test_best_params_rank(spark):
    df = spark.createDataFrame([("A", i, "TOTAL", float(v)) for i, v in enumerate([3, 9, 9, 1])], "symbol string, param_id int, side string, net_profit double")
    assert [r.param_id for r in best_params(df, k=2).orderBy("rank").collect()] == [1, 2]


def test_unknown_parameter(bars):
    with pytest.raises(ValueError):
        with_params(bars, [{"nope": 1.0}])
