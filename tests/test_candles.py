import pandas as pd
from conftest import indexed, rows, walk

from candlewright.operators.candles import add_bias, add_reversals, add_trigger, candle_type


def bars_from(highs_lows, symbol="A", minutes=15):
    pdf = walk(symbol, len(highs_lows), minutes)
    pdf["high"], pdf["low"] = zip(*[(float(h), float(l)) for h, l in highs_lows])
    return pdf


def test_types_and_order_of_rules(spark):
    pdf = bars_from([(10, 5), (10, 5), (11, 4), (12, 4), (11, 3), (11, 3)])
    got = rows(indexed(spark, pdf, bars_from([(1, 0)], "B")).withColumn("candle_type", candle_type()))
    assert got[got["symbol"] == "A"]["candle_type"].tolist()[1:] == [1, 3, 2, -2, 1]
    assert got["candle_type"].isna().sum() == 2


def test_reversals(spark):
    got = rows(add_reversals(indexed(spark, bars_from([(10, 5), (9, 4), (10, 5), (9, 4)]))))
    assert got["rev_up"].tolist() == [False, False, True, False]
    assert got["rev_down"].tolist() == [False, False, False, True]


def test_bias_looks_ahead_inside_its_bucket_only(spark):
    pdf = walk(n=32, minutes=15)
    base = rows(add_bias(indexed(spark, pdf), 3600))
    late = pdf.copy()
    late.loc[3, "close"] = base.loc[0, "open"] + (-50 if base.loc[0, "htf_bull"] else 50)
    changed = rows(add_bias(indexed(spark, late), 3600))
    assert base.loc[0, "htf_bull"] != changed.loc[0, "htf_bull"]
    pd.testing.assert_frame_equal(base.loc[4:, ["htf_bull", "htf_bear"]], changed.loc[4:, ["htf_bull", "htf_bear"]])


def test_completed_bias_never_looks_ahead(spark):
    pdf = walk(n=64, minutes=15)
    base = rows(add_trigger(indexed(spark, pdf), 3600, lookahead=False))
    late = pdf.copy()
    late.loc[40:, ["open", "high", "low", "close"]] += 30.0
    late.loc[43, "close"] += 500
    changed = rows(add_trigger(indexed(spark, late), 3600, lookahead=False))
    cut = ["htf_bull", "htf_bear", "rev_up", "we_buy", "we_sell"]
    pd.testing.assert_frame_equal(base.loc[:39, cut], changed.loc[:39, cut])
    own = rows(add_bias(indexed(spark, pdf), 3600))
    assert base["htf_bull"].tolist() == [False] * 4 + own["htf_bull"].tolist()[:-4]
