import numpy as np
import pandas as pd
import pytest
from conftest import frame, indexed, rows, walk
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from candlewright.operators import studies as st
from candlewright.operators.quality import describe
from candlewright.operators.resumed import carry_of, resume_studies
from candlewright.operators.summaries import day_summaries, describe_days, rank_error, store_summaries, stored_summaries
from candlewright.session import stage


def chosen():
    return [st.atr(5), st.ema(7), st.rsi(6)]


VALUES = ["atr", "ema", "avg_gain", "avg_loss", "rsi"]


@pytest.mark.parametrize("gaps", [False, True])
def test_history_and_days_equal_one_run(spark, gaps):
    whole = pd.concat([walk("A", 300, seed=1), walk("B", 200, seed=2), walk("C", 30, seed=3, start="2024-01-09"),
                       walk("D", 20, seed=4)], ignore_index=True)
    if gaps:                                                        # also at the ends of parts and at the start of a series
        whole.loc[[0, 1, 60, 118, 119, 120, 121, 122, 143, 144, 305, 419, 500, 501], ["high", "low", "close"]] = None
    cuts = [pd.Timestamp("2024-01-06"), pd.Timestamp("2024-01-07"), pd.Timestamp("2024-01-10")]
    parts = [whole[(whole["ts_utc"] >= a) & (whole["ts_utc"] < b)] for a, b in zip([pd.Timestamp.min, *cuts], [*cuts, pd.Timestamp.max])]
    history = stage(st.run_studies(indexed(spark, parts[0]), *chosen()), "history")
    carry, got = stage(carry_of(history, *chosen()), "carry"), [history]
    for part in parts[1:]:
        bars, carry = resume_studies(frame(spark, part), carry, *chosen())
        carry = stage(carry, "carry")
        got.append(bars)
        assert not any("history" in f or "/indexed" in f for f in bars.inputFiles())
    want = rows(st.run_studies(indexed(spark, whole), *chosen()))
    got = pd.concat([rows(g.select(want.columns.tolist())) for g in got]).sort_values(["symbol", "bar_no"], ignore_index=True)
    keys = ["symbol", "bar_no", "ts_utc", "prev_ts_utc", "prev_close", "rsi_long", "rsi_short"]
    pd.testing.assert_frame_equal(got[keys], want[keys], check_dtype=False)
    for c in VALUES:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-12, atol=1e-12)
    assert rows(carry, "symbol")["last_no"].tolist() == [299, 199, 29, 19]


def test_nested_smoothing_is_carried_on(spark):
    whole, study = walk("A", 200, seed=9), st.macd_values(4, 9, 3)
    history = stage(st.run_studies(indexed(spark, whole.head(150)), study), "history")
    bars, _ = resume_studies(frame(spark, whole.tail(50)), stage(carry_of(history, study), "carry"), study)
    want = rows(st.run_studies(indexed(spark, whole), study)).tail(50)
    for c in ("macd_signal", "macd_hist"):
        np.testing.assert_allclose(rows(bars)[c], want[c], rtol=1e-12, atol=1e-12)


def test_what_a_carry_cannot_do_is_refused(spark):
    history = stage(st.run_studies(indexed(spark, walk("A", 50)), st.atr(5)), "history")
    carry = stage(carry_of(history, st.atr(5)), "carry")
    with pytest.raises(ValueError):
        carry_of(history, st.roc())
    with pytest.raises(ValueError):
        carry_of(history, st.atr(5, seed="sma"))
    with pytest.raises(PySparkException, match="not later"):
        resume_studies(frame(spark, walk("A", 60).tail(20)), carry, st.atr(5)).bars.count()


def test_day_summaries_merge_to_any_range(spark, tmp_path):
    bars = pd.concat([walk("A", 2000, minutes=15, seed=1), walk("B", 90, minutes=15, seed=2)], ignore_index=True)
    bars["volume"] = 1e9 + bars["volume"] / 1e3                      # a small spread far from zero
    bars.loc[3, "close"], bars.loc[4, "close"] = None, float("nan")
    path, size = str(tmp_path / "days"), 200
    days = bars["ts_utc"].dt.date
    store_summaries(frame(spark, bars[days < pd.Timestamp("2024-01-09").date()]), path, size=size)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "days").rglob("*.parquet")}
    changed = bars.copy()
    changed.loc[days == pd.Timestamp("2024-01-05").date(), "close"] += 5
    for day in ("2024-01-05", "2024-01-09", "2024-01-10"):
        store_summaries(frame(spark, changed[days == pd.Timestamp(day).date()]), path, size=size)
    kept = [f for f, t in before.items() if f.exists() and f.stat().st_mtime_ns == t]
    assert 0 < len(kept) < len(before) and not any("2024-01-05" in str(f) for f in kept)
    summaries = stored_summaries(spark, path)
    for first, last in (("2024-01-01", "2024-01-10"), ("2024-01-04", "2024-01-09"), ("2024-01-05", "2024-01-05")):
        some = summaries.where(F.col("trade_date").between(first, last))
        assert "PartitionFilters: [isnotnull(trade_date" in some._jdf.queryExecution().executedPlan().toString()
        got = rows(describe_days(some), "symbol", "column")
        part = changed[(days >= pd.Timestamp(first).date()) & (days <= pd.Timestamp(last).date())].replace({float("nan"): None})
        want = rows(describe(frame(spark, part)), "symbol", "column")
        assert got[["symbol", "column", "count"]].equals(want[["symbol", "column", "count"]])
        for c in ("mean", "min", "max"):
            np.testing.assert_allclose(got[c], want[c], rtol=1e-14)
        np.testing.assert_allclose(got["std"], want["std"], rtol=1e-6)
        for row in got.itertuples():
            values = np.sort(part[part["symbol"] == row.symbol][row.column].dropna().astype(float).to_numpy())
            for p, q in ((0.25, row.p25), (0.5, row.p50), (0.75, row.p75)):
                low, high = (np.searchsorted(values, q, side) / len(values) for side in ("left", "right"))
                assert low - rank_error(size) <= p <= high + rank_error(size)


def test_summaries_of_nothing(spark):
    empty = frame(spark, walk("A", 2)).where("false")
    assert describe_days(day_summaries(empty)).collect() == []
    one = describe_days(day_summaries(frame(spark, walk("A", 1)))).where("column = 'close'").first()
    assert one["count"] == 1 and one.std is None and one.p50 == one.min == one.max
