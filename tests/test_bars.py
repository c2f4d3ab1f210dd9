import pandas as pd
from conftest import frame, indexed, rows, walk
from pyspark.sql import functions as F

from candlewright.operators.bars import daily_range, rollup_calendar, rollup_htf, ticks_to_bars
from candlewright.operators.blocks import lag, over_blocks
from candlewright.operators.htf import attach_asof
from candlewright.schema import TICKS


def ticks(spark, data):
    pdf = pd.DataFrame(data, columns=["symbol", "ts", "seq", "price", "volume"])
    pdf["ts"] = pd.to_datetime(pdf["ts"])
    return spark.createDataFrame(pdf.sample(frac=1, random_state=3), TICKS)


def test_last_duplicate_wins_and_ties_follow_file_order(spark):
    df = ticks(spark, [
        ("A", "2024-01-01 00:00:01", 0, 5.0, 1.0),
        ("A", "2024-01-01 00:00:01", 1, 7.0, 2.0),
        ("A", "2024-01-01 00:00:01", 2, 5.0, 10.0),      # same (ts, price) as seq 0
        ("A", "2024-01-01 00:00:59", 3, 6.0, 1.0),
        ("A", "2024-01-01 00:00:59", 4, 4.0, 1.0),
        ("A", "2024-01-01 00:05:00", 5, 9.0, 3.0),
    ])
    got = rows(ticks_to_bars(df, 60), "ts_utc")
    assert len(got) == 2
    assert got.loc[0, ["open", "high", "low", "close", "volume"]].tolist() == [7.0, 7.0, 4.0, 4.0, 14.0]


def test_rollups(spark):
    pdf = walk(n=24 * 40)
    df = frame(spark, pdf)
    for unit, freq in (("day", "D"), ("week", "W-SUN"), ("month", "M")):
        want = pdf.groupby(pdf["ts_utc"].dt.to_period(freq).dt.start_time).agg(
            open=("open", "first"), high=("high", "max"), low=("low", "min"), close=("close", "last"), volume=("volume", "sum"))
        got = rows(rollup_calendar(df, unit), "ts_utc").set_index("ts_utc")
        pd.testing.assert_frame_equal(got[want.columns], want, check_names=False, check_freq=False, check_index_type=False)
    htf = rows(rollup_htf(df, 14400), "htf_ts")
    assert len(htf) == 240 and htf["high"].tolist() == pdf["high"].groupby(pdf.index // 4).max().tolist()
    assert rows(daily_range(df), "trade_date")["low"].tolist() == pdf.groupby(pdf["ts"].dt.date)["low"].min().tolist()


def test_numbering_across_days_and_symbols(spark):
    a, b = walk("A", 100), walk("B", 60, seed=2)
    b = b[(b.index < 5) | (b.index == 30) | (b.index > 50)]          # single-bar and missing days
    got = rows(indexed(spark, a, b))
    for name, part in (("A", a), ("B", b)):
        mine = got[got["symbol"] == name].reset_index(drop=True)
        part = part.reset_index(drop=True)
        assert mine["bar_no"].tolist() == list(range(len(part)))
        for c in ("high", "low", "close", "ts_utc"):
            pd.testing.assert_series_equal(mine[f"prev_{c}"], part[c].shift(), check_names=False)


def test_windows_do_not_depend_on_block_length(spark):
    pdf = walk(n=97)
    bars = indexed(spark, pdf, walk("B", 3))
    for size in (4, 16, 4096):
        got = rows(over_blocks(bars, 11, [{"far": lag("close", 11)}], size))
        mine = got[got["symbol"] == "A"]
        pd.testing.assert_series_equal(mine["far"], pdf["close"].shift(11), check_names=False)
        assert len(got) == 100


def test_asof_matches_merge_asof(spark):
    left, right = walk(n=200, minutes=37), walk(n=20, minutes=601, seed=5, start="2024-01-01 07:00")
    got = rows(attach_asof(frame(spark, left).select("symbol", "ts_utc"),
                           frame(spark, right).select("symbol", "ts_utc", F.col("close").alias("v")), ["v"]), "ts_utc")
    want = pd.merge_asof(left[["ts_utc"]], right[["ts_utc", "close"]], on="ts_utc")
    pd.testing.assert_series_equal(got["v"], want["close"], check_names=False)
