import numpy as np
import pandas as pd
import pytest
from conftest import frame, indexed, rows, walk

from candlewright.operators import studies as st
from candlewright.operators.risk import RiskRules, add_annual_range, add_monthly_range, price_signals, trade_records


def test_range_needs_twenty_past_days(spark):
    pdf = walk(n=25, minutes=1440)
    got = rows(add_annual_range(frame(spark, pdf)), "ts")
    assert got["annual_range"].isna().tolist() == [True] * 20 + [False] * 5
    assert got["annual_range"].iloc[20] == pdf["high"][:20].max() - pdf["low"][:20].min()


def test_a_spike_counts_from_the_next_day_and_for_252_days(spark):
    pdf = walk(n=300, minutes=1440)
    calm = rows(add_annual_range(frame(spark, pdf)), "ts")["annual_range"]
    pdf.loc[30, "high"] = 1000.0
    spiked = rows(add_annual_range(frame(spark, pdf)), "ts")["annual_range"]
    differs = (calm != spiked) & calm.notna()
    assert differs[differs].index.tolist() == list(range(31, 283))


def test_monthly_range_waits_for_twelve_months(spark):
    pdf = walk(n=430, minutes=1440)
    got = rows(add_monthly_range(frame(spark, pdf)), "ts")
    first = got["annual_range"].first_valid_index()
    assert str(got.loc[first, "ts"].date()) == "2025-01-01"
    assert got.loc[first, "annual_range"] == pdf["high"][:366].max() - pdf["low"][:366].min()


def priced(spark, rules, **columns):
    base = {"symbol": "A", "ts": pd.Timestamp("2024-01-01"), "signal": "BUY", "close": 100.0, "atr": 10.0, "annual_range": 500.0}
    schema = "symbol string, ts timestamp_ntz, signal string, close double, atr double, annual_range double"
    pdf = pd.DataFrame([{**base, **columns}])
    return price_signals(spark.createDataFrame(pdf, schema), rules)


def test_plain_pricing(spark):
    row = priced(spark, RiskRules()).first()
    assert (row.entry, row.sl, row.tp, row.approved, row.adjusted) == (100.0, 86.0, 128.0, True, False)
    assert row.comment == "Risk: 2.80% (Limit: 100.00%)"
    row = priced(spark, RiskRules(), signal="SELL").first()
    assert (row.sl, row.tp) == (114.0, 72.0)


def test_over_the_limit(spark):
    row = priced(spark, RiskRules(limit=0.02, allow_exceed=True)).first()
    assert (row.sl, row.tp, row.adjusted, row.comment) == (90.0, 120.0, True, "SL Adjusted: 2.80% -> 2.00%")
    row = priced(spark, RiskRules(limit=0.02)).first()
    assert (row.sl, row.approved, row.comment) == (None, False, "Risk Rejected: 2.80% > 2.00%")


@pytest.mark.parametrize("rules, columns, approved, comment", [
    (RiskRules(limit=0.01), {"annual_range": None}, True, "History insufficient for range calc"),
    (RiskRules(limit=0.01), {"annual_range": 0.0}, True, "History insufficient for range calc"),
    (RiskRules(limit=0.01, limit_enabled=False), {}, True, "Risk mgmt disabled"),
    (RiskRules(), {"atr": 0.0}, False, None),
    (RiskRules(), {"atr": None}, False, None),
    (RiskRules(), {"signal": None}, False, None),
    (RiskRules(sl_tp_enabled=False), {}, False, None),
])
def test_edges(spark, rules, columns, approved, comment):
    row = priced(spark, rules, **columns).first()
    assert (row.approved, row.comment) == (approved, comment)


def test_own_target_multiple_keeps_its_ratio_when_clamped(spark):
    rules = RiskRules(sl_mult=2.0, tp_mult=3.0, limit=0.02, allow_exceed=True)
    assert priced(spark, rules).first().tp == 115.0
    assert priced(spark, RiskRules(sl_mult=2.0, tp_mult=3.0)).first().tp == 130.0


def test_records_round_ties_to_even(spark):
    row = trade_records(priced(spark, RiskRules(sl_mult=1.0, reward=1.0), close=100.125, atr=0.25)).first()
    assert (row.entry, row.sl) == (100.12, 99.88)


def test_thousand_point_stop_on_two_years_of_hours(spark):
    """Synthetic two-year series: a far stop under a 2 % cap is pulled in."""
    pdf = walk(n=17_545, minutes=60, seed=42, start="2023-01-01")
    bars = indexed(spark, pdf)
    got = rows(add_annual_range(st.run_studies(bars, st.atr(14), gates=False)))
    mid, last = got["annual_range"].iloc[len(got) // 2], got["annual_range"].iloc[-1]
    assert mid != last and got["annual_range"].notna().sum() > 16_000
    probe = got.iloc[-10]
    row = priced(spark, RiskRules(limit=0.02, allow_exceed=True), close=float(probe["close"]),
                 atr=1000 / 1.4, annual_range=float(probe["annual_range"])).first()
    assert row.adjusted and np.isclose(row.entry - row.sl, 0.02 * probe["annual_range"])
